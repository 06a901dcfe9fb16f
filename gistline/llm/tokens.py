"""Token ids of many texts, equal to those of the ``tokenizers`` library.

Byte-level BPE first cuts a text into pre-tokens (a word with the blank before it, a run of digits,
of signs, of white space) and merges inside each of them. The cutting is done here on whole batches
as arrays; each distinct pre-token is given to the library once and its ids are remembered, since
encoding every occurrence would take several times as long. Other kinds of tokenizer files, and
texts that hold the name of a special token, go to the library as they are.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np

from gistline.llm.words import BYTE, mix, powers

CACHE = 600_000  #: Pre-tokens remembered by one worker; beyond it the memory starts anew.
SLOTS = 1 << 21
_LETTER, _NUMBER, _SPACE = 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, or 0."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a:b + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def _printed() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


_PRINTED = _printed()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins (one entry more than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def pre_token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts begin (ascending positions)."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)
    head[first] = True
    new_run = head[:-1].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    space, blank = kind == _SPACE, cp == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~head[1:-1]
    starts = new_run & (space | ~after_blank)
    # The last of several white-space characters before a word stands for itself or leads the word.
    starts[:-1] |= space[:-1] & ~space[1:] & ~head[1:-1]
    # 's 't 're 've 'm 'll 'd, where the apostrophe begins a pre-token.
    at = np.flatnonzero(starts[:-1] & (cp[:-1] == 0x27) & ~head[1:-1])
    if len(at):
        ends = first[np.searchsorted(first, at, side="right")]
        one = cp[at + 1]
        two = np.where(at + 2 < ends, cp[np.minimum(at + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        at, size, ends = at[size > 0], size[size > 0], ends[size > 0]
        starts[at + 1] = False
        nxt = at + 1 + size
        starts[nxt[nxt < ends]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Encodes lists of texts; ids come as one array with the number of ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and spec["model"]["type"] == "BPE")
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        """Empty the memory: a table of keys by their low bits, and the ids of each remembered part."""
        self.slot_key = np.zeros(SLOTS, np.uint64)
        self.slot_part = np.full(SLOTS, -1, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(CACHE + 1, np.int64)
        self.parts = 0

    def _merge(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_PRINTED))]

    def _learn(self, parts: list[str]) -> None:
        got = list(map(self._merge, parts))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum()))
        used = int(self.begin[self.parts])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[used:used + len(flat)] = flat
        if self.parts + len(parts) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(parts) + CACHE, np.int64)])
        self.begin[self.parts + 1:self.parts + 1 + len(parts)] = used + np.cumsum(sizes)
        self.parts += len(parts)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        odd = [i for i, t in enumerate(texts) if not self.by_parts or any(s in t for s in self.special)]
        if not odd:
            return self.encode_by_parts(texts)
        rest, whole = [t for t in texts], [texts[i] for i in odd]
        for i in odd:
            rest[i] = ""
        flat, counts = self.encode_by_parts(rest) if self.by_parts else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        own, sizes = self.plain(whole)
        pieces = np.split(flat, np.cumsum(counts)[:-1])
        for i, ids in zip(odd, np.split(own, np.cumsum(sizes)[:-1])):
            pieces[i] = ids
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))

    def encode_by_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, first = code_points(texts)
        starts = pre_token_starts(cp, first)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        which = self.indices(cp, starts, "".join(texts))
        begin = self.begin[which]
        sizes = self.begin[which + 1] - begin
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(begin - before, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, first)]
        return self.ids[at], np.diff(upto)

    def indices(self, cp: np.ndarray, starts: np.ndarray, whole: str) -> np.ndarray:
        """The remembered number of each pre-token."""
        lengths = np.append(starts[1:], len(cp)) - starts
        within = np.arange(len(cp), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        with np.errstate(over="ignore"):
            value = (cp + BYTE[5]) * powers(int(lengths.max()) + 1)[within]
            key = mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * BYTE[9])
        if self.parts > CACHE:
            self._forget()
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        found = np.where(self.slot_key[slot] == key, self.slot_part[slot], -1)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at, back = np.unique(key[missing], return_index=True, return_inverse=True)
            spots = missing[at]
            base = self.parts
            self._learn([whole[a:b] for a, b in zip(starts[spots].tolist(), (starts[spots] + lengths[spots]).tolist())])
            number = base + np.arange(len(new), dtype=np.int32)
            # Where two new parts share a slot, the table keeps the later one; this batch knows both.
            self.slot_key[slot[spots]] = new
            self.slot_part[slot[spots]] = number
            found[missing] = number[back]
        return found


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
