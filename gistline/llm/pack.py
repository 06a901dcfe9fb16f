"""Packing by shortest pack first over the length histogram.

Documents become token ids and are cut into pieces of at most one sequence. Only the histogram of
piece lengths (one row per length, so at most ``size`` rows) comes to the driver. There lengths are
placed longest first: all pieces of a length go, by count, into the packing patterns that are
shortest so far and still have room, and what finds no room opens new patterns. Patterns and their
counts then tell, for each length, which ranks go to which sequence and offset; pieces are ranked
within their length and look up their place.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import batch, number_rows, slices, stage
from gistline.llm.tokens import default_path, encoder

SIZE = 2048
BUCKET_ROWS = 100_000

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Pieces of the token ids of every document, each at most ``size`` long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            flat, counts = enc.encode(texts)
            ends = np.cumsum(counts)
            docs_at, starts, lengths, crcs, totals = [], [], [], [], []
            for i, (to, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                ids = np.append(flat[to - n:to], np.uint32(end_id)).astype("<u4")
                for at in range(0, n + 1, size):
                    part = ids[at:at + size]
                    docs_at.append(i)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
                    totals.append(n + 1)
            yield batch(_PIECES, doc_id=b.column("doc_id").take(pa.array(docs_at)), start=starts, length=lengths, ids_crc32=crcs, doc_tokens=totals)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths in order) that hold every piece of the histogram once."""
    room: dict[int, list[list]] = {}  # by free room: [count, pattern]
    free: list[int] = []  # ascending
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(left: int, count: int, pattern: tuple[int, ...]) -> None:
        if not left:
            done.append((count, pattern))
            return
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and free and free[-1] >= length:
            most = free[-1]
            count, pattern = room[most].pop()
            if not room[most]:
                del room[most]
                free.pop()
            used = min(left, count)
            if used < count:
                put(most, count - used, pattern)
            put(most - length, used, (*pattern, length))
            left -= used
        if left:
            # New packs hold as many pieces of this length as fit.
            fit = size // length
            full, rest = divmod(left, fit)
            if full:
                put(size - fit * length, full, (length,) * fit)
            if rest:
                put(size - rest * length, 1, (length,) * rest)
    return done + [(c, p) for left in free for c, p in room[left]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ascending by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        sequence += count
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """All documents in sequences of at most ``size`` tokens.

    In: doc_id, text (more columns are ignored). Out: one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the end id alone; repeated
    rows are packed each; an empty table gives no rows.
    """
    pieces = stage(cut(docs, path or default_path(), end_id, size))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(shortest_pack_first(histogram, size))
    buckets = max([1, *(-(-n // BUCKET_ROWS) for n in histogram.values())])
    ranked = number_rows(pieces, ["length"], ["doc_id", "start"], "rank", buckets)
    step = np.int64(1) << 44  # more ranks than any length has
    keys = where[:, 0] * step + where[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy().astype(np.int64) * step + rank, side="right") - 1
            row = where[at]
            yield batch(
                _PLACED, **{f.name: b.column(f.name) for f in _PIECES},
                sequence_id=row[:, 2] + rank - row[:, 1], offset=row[:, 3])

    return ranked.select(*[f.name for f in _PIECES], F.col("rank").cast("long").alias("rank")).mapInArrow(
        run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ).withColumn("length", F.col("length").cast("long"))
