"""Token counts that follow edits.

A document's pre-tokens are grouped into leaves; a segment tree over the leaves holds token counts,
so the count of a document is its root. An edit touches a few leaves. Only their text, plus one leaf
before and after as context, is cut and encoded again; the leaves' counts change and the sums on the
way to the root with them. If the cut after the edit does not meet an old leaf border, the region
grows leaf by leaf until it does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as ST

from gistline.llm.common import batch, slices
from gistline.llm.tokens import Encoder, code_points, default_path, encoder, pre_token_starts

LEAF = 64  #: Pre-tokens in a leaf.


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: node i has children 2i+1 and 2i+2; the last level has the leaves and zeros."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    level = np.zeros(width, np.int64)
    level[:len(leaves)] = leaves
    levels = [level]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
    return np.concatenate(levels)


def update_tree(tree: np.ndarray, first: int, counts: np.ndarray) -> None:
    """Put new counts in the leaves from ``first`` on and renew the sums above them, and no others."""
    base = len(tree) // 2
    nodes = np.arange(base + first, base + first + len(counts))
    tree[nodes] = counts
    while len(nodes) and nodes[0]:
        nodes = np.unique((nodes - 1) // 2)
        tree[nodes] = tree[2 * nodes + 1] + tree[2 * nodes + 2]


def part_counts(enc: Encoder, text: str, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Token count of each pre-token."""
    which = enc.indices(cp, starts, text)
    return enc.begin[which + 1] - enc.begin[which]


def build(enc: Encoder, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: code points in each leaf, and the tree."""
    cp, first = code_points(texts)
    starts = pre_token_starts(cp, first)
    sizes = part_counts(enc, "".join(texts), cp, starts) if len(starts) else np.zeros(0, np.int64)
    cut = np.searchsorted(starts, first)
    out = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if a == b:
            out.append((np.zeros(0, np.int64), np.zeros(1, np.int64)))
            continue
        heads = np.arange(a, b, LEAF)
        borders = np.append(starts[heads], first[i + 1])
        out.append((np.diff(borders), tree_of(np.add.reduceat(sizes[a:b], heads - a))))
    return out


def apply_edit(enc: Encoder, text: str, chars: np.ndarray, tree: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray, np.ndarray, int]:
    """The edited text with its leaves and tree, and how many code points were encoded again."""
    edited = text[:start] + new + text[stop:]
    n = len(chars)
    borders = np.concatenate([[0], np.cumsum(chars)])
    lo = max(0, int(np.searchsorted(borders, start, side="right")) - 2)  # one leaf of context
    while lo and start - borders[lo] < 3:  # room for an apostrophe and two letters
        lo -= 1
    hi = min(n, int(np.searchsorted(borders, stop, side="left")) + 1)
    shift = len(edited) - len(text)
    while True:
        a, b = int(borders[lo]), int(borders[hi]) + shift
        ahead = len(edited) if hi == n else min(len(edited), b + 8)
        part = edited[a:ahead]
        cp, first = code_points([part])
        starts = pre_token_starts(cp, first)
        if hi == n or b - a in starts:
            break
        hi += 1
    inside = starts[starts < b - a]
    encoded = b - a
    region = edited[a:b]
    cp = cp[:b - a]
    counts = part_counts(enc, region, cp, inside) if len(inside) else np.zeros(0, np.int64)
    slots = hi - lo
    if lo == 0 and hi == n:
        heads = np.arange(0, len(inside), LEAF)
    else:  # the same number of leaves, so that the rest of the tree stays as it is
        heads = np.unique(np.linspace(0, len(inside), slots, endpoint=False).astype(np.int64)) if len(inside) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(inside[heads], b - a)) if len(heads) else np.zeros(0, np.int64)
    if lo == 0 and hi == n:
        return edited, sizes, tree_of(sums) if len(sums) else np.zeros(1, np.int64), encoded
    pad = slots - len(heads)
    tree = tree.copy()
    update_tree(tree, lo, np.append(sums, np.zeros(pad, np.int64)))
    return edited, np.concatenate([chars[:lo], sizes, np.zeros(pad, np.int64), chars[hi:]]), tree, encoded


_STATE = [("leaf_chars", pa.list_(pa.int32())), ("tree", pa.list_(pa.int64()))]


def count_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``leaf_chars`` and ``tree`` of each text; the first entry of ``tree`` is the token count."""
    path = path or default_path()
    plain = docs.drop("leaf_chars", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if not enc.by_parts:
            raise ValueError("edit-aware counting needs a byte-level BPE vocabulary")
        for b in slices(batches, "text"):
            states = build(enc, [t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array([s[k] for s in states], kind) for k, (_, kind) in enumerate(_STATE)]],
                names=[*b.schema.names, *[name for name, _ in _STATE]])

    state = [ST.StructField("leaf_chars", ST.ArrayType(ST.IntegerType())), ST.StructField("tree", ST.ArrayType(ST.LongType()))]
    return plain.mapInArrow(run, ST.StructType([*plain.schema.fields, *state]))


_COUNTS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("edited_chars", pa.int64()), ("edited_tokens", pa.int64()),
    ("encoded_chars", pa.int64()), ("leaves", pa.int64())])


def recount(states: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts before and after one edit of each row of :func:`count_trees`.

    In: doc_id, text, leaf_chars, tree, edit_start, edit_stop (code points, from 0), edit_text. Out:
    doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars (read again by the edit),
    leaves. Null texts and edit texts are empty, null or outlying places are moved to the text's
    ends; a null doc_id stays null; repeated rows are counted each; an empty table gives no rows.
    Names of special tokens in a text are counted as ordinary text.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            rows = b.to_pydict()
            out = {f.name: [] for f in _COUNTS}
            for i, text in enumerate(rows["text"]):
                text, new = text or "", rows["edit_text"][i] or ""
                start = min(max(rows["edit_start"][i] or 0, 0), len(text))
                stop = min(max(rows["edit_stop"][i] or 0, start), len(text))
                tree = np.array(rows["tree"][i], np.int64)
                edited, chars, after, encoded = apply_edit(enc, text, np.array(rows["leaf_chars"][i], np.int64), tree, start, stop, new)
                for name, value in zip(_COUNTS.names, (rows["doc_id"][i], len(text), int(tree[0]), len(edited), int(after[0]), encoded, len(chars))):
                    out[name].append(value)
            yield batch(_COUNTS, **out)

    return states.select(F.col("doc_id").cast("long"), "text", "leaf_chars", "tree", "edit_start", "edit_stop", "edit_text").mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long, leaves long")


def own_edits(docs: DataFrame, deleted: int = 24, inserted: int = 30) -> DataFrame:
    """One edit per document, made of its own text: at a place that the checksum of its text gives,
    ``deleted`` characters give way to its first ``inserted``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.floor(F.char_length(text) * ((F.crc32(F.encode(text, "UTF-8")) % 1000) / 1000.0)).cast("long")
    return docs.select(
        "doc_id", "text", at.alias("edit_start"), (at + deleted).alias("edit_stop"), F.substring(text, 1, inserted).alias("edit_text"))
