import random

import numpy as np
import pyarrow as pa

from gistline.llm import words
from gistline.llm.tokens import default_path, encoder

PARTS = ["a", "Bc", "é", "ß", "1", "٣", "²", " ", "  ", "\n", "\t", "\r\n", " ", "　", "'", "'s", "'ll", "'re", "don't", "\x1c", "\x85", "😀", "中", "_", "-", "!!",
         "<|", "|>", "​", "é", "ſ", "'S", "'d", "'ve'm"]


def test_ids_equal_those_of_the_library():
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>b", " <|endoftext|>", "x" * 5000, "\n" * 300]
    enc = encoder(default_path())
    got, want = enc.encode(texts), enc.plain(texts)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_memory_starts_anew(monkeypatch):
    from gistline.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 20)
    enc = tokens.Encoder(default_path())
    for k in range(5):
        texts = [f"word{k}{i} other{i}" for i in range(50)]
        assert np.array_equal(enc.encode(texts)[0], enc.plain(texts)[0])


def test_words_and_grams_against_split():
    texts = ["Ab  cd\tAB", "", None, "x", "a b c d e f", "  ", "é É\x0b\x0cq"]
    raw, offsets = words.text_bytes(pa.array(texts))
    starts, stops, first = words.word_spans(raw, offsets)
    got = [[bytes(raw[a:z]) for a, z in zip(starts[f:g], stops[f:g])] for f, g in zip(first[:-1], first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h = words.word_hashes(raw, starts, stops)
    assert h[0] == h[2] and len(set(h.tolist())) == len({w.lower() for t in got for w in t})
    g, before = words.grams(h, first, 3)
    assert np.diff(before).tolist() == [1, 0, 0, 1, 4, 0, 1]


def test_slices_keep_every_row():
    from gistline.llm.common import slices

    b = pa.record_batch({"doc_id": list(range(9)), "text": ["x" * n if n is not None else None for n in (3, 50, 0, None, 9, 9, 9, 100, 1)]})
    parts = list(slices([b.slice(1), b.slice(0, 0)], "text", 20))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(1, 9))
    assert max(p.num_rows for p in parts) <= 5
