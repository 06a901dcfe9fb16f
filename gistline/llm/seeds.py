"""Benchmark decontamination by spaced seeds.

A mask picks some of the word positions of a window and ignores the others, so that a window whose
ignored words were exchanged still has the same hash. Windows of the benchmark and of all documents
are joined on the hash of each mask; around the hits the words are compared place by place, and an
overlap counts if enough words agree.

Document windows that cannot meet a benchmark window are dropped in the map task by a bit filter of
fixed size; a larger benchmark only makes it let more windows through to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import batch, slices, stage
from gistline.llm.words import mix, powers, text_bytes, word_hashes, word_spans

#: In 14 words or more, some mask keeps a seed whichever two words are exchanged.
MASKS = ("111100010011", "101011110001", "100010101111")
SPAN = len(MASKS[0])
FILTER_BITS = 24  #: The filter has 2^24 bits (2 MiB); a hash is looked up by its top and by its low bits.
REACH = 128  #: Words kept on either side of the hits of a region.
MIN_WORDS = 12  #: Equal words that an overlap needs (or all words of a shorter item).
MISMATCH = 4  #: A differing word weighs so many equal ones: about four in five must agree.


def seed_hashes(words: np.ndarray, first: np.ndarray, picks: tuple[int, ...], span: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every window of ``span`` words that lies inside one text."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    at = at[at + span <= first[np.searchsorted(first, at, side="right")]]
    p = powers(span + 2)
    with np.errstate(over="ignore"):
        h = np.full(len(at), np.uint64(tag) * p[1], np.uint64)
        for k in picks:
            h += words[at + k] * p[k + 2]
        return mix(h), at


def _windows(words: np.ndarray, first: np.ndarray, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for m, mask in enumerate(MASKS):
        yield (m, *seed_hashes(words, first, tuple(i for i, c in enumerate(mask) if c == "1"), SPAN, m + 1))
    for n in short:  # items too short for a mask: all their words
        yield (100 + n, *seed_hashes(words, first, tuple(range(n)), n, 100 + n))


_ITEMS = pa.schema([("item_id", pa.int64()), ("item_words", pa.list_(pa.int64())), ("n_item", pa.int32())])
_SEEDS = pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("item_at", pa.int32())])


def item_words(benchmark: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, offsets = text_bytes(b.column("text"))
            starts, stops, first = word_spans(raw, offsets)
            words = pa.array(word_hashes(raw, starts, stops).view(np.int64))
            yield batch(_ITEMS, item_id=b.column("item_id"), item_words=pa.ListArray.from_arrays(pa.array(first, pa.int32()), words), n_item=np.diff(first))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, item_words array<long>, n_item int")


def item_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, own in zip(b.column("item_id").to_pylist(), b.column("item_words").to_pylist()):
                words = np.array(own, np.int64).view(np.uint64)
                first = np.array([0, len(words)])
                for _, h, at in _windows(words, first, [len(words)] if 0 < len(words) < SPAN else []):
                    yield batch(_SEEDS, seed=h.view(np.int64), item_id=np.full(len(h), item), item_at=at.astype(np.int32))

    return items.filter("item_id is not null").mapInArrow(run, "seed long, item_id long, item_at int")


def bit_filter(seeds: DataFrame) -> np.ndarray:
    """Which hashes, by their top and by their low bits, occur in the benchmark: at most 2^18 words come to the driver."""
    probes = F.explode(F.array(F.shiftrightunsigned("seed", 64 - FILTER_BITS), F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))))
    words = seeds.select(probes.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.collect():
        out[r["w"]] = r["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


_REGIONS = pa.schema([
    ("doc_id", pa.int64()), ("region_at", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def regions(docs: DataFrame, keep: np.ndarray, short: list[int]) -> DataFrame:
    """Stretches of each document around windows that the filter lets through, with those windows."""
    packed = np.packbits(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(packed).astype(bool)
        for b in slices(batches, "text"):
            raw, offsets = text_bytes(b.column("text"))
            starts, stops, first = word_spans(raw, offsets)
            words = word_hashes(raw, starts, stops)
            hashes, places = [], []
            for _, h, at in _windows(words, first, short):
                hit = seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                hit &= seen[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                hashes.append(h[hit])
                places.append(at[hit])
            h, at = np.concatenate(hashes), np.concatenate(places)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            doc = np.searchsorted(first, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) > REACH)
            cuts = np.append(np.flatnonzero(new), len(at))
            out = {f.name: [] for f in _REGIONS}
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                d = doc[a]
                lo, hi = max(first[d], at[a] - REACH), min(first[d + 1], at[z - 1] + SPAN + REACH)
                out["doc_id"].append(d)
                out["region_at"].append(lo - first[d])
                out["words"].append(words[lo:hi].view(np.int64))
                out["seeds"].append(h[a:z].view(np.int64))
                out["places"].append(at[a:z] - lo)
            out["doc_id"] = b.column("doc_id").take(pa.array(out["doc_id"]))
            yield batch(_REGIONS, **out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, region_at long, words array<long>, seeds array<long>, places array<long>")


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> tuple[int, int, int] | None:
    """First place in ``item``, length and equal words of the best stretch of ``item`` against ``doc[shift:]``.

    Of all stretches with at most one differing word for ``MISMATCH`` equal ones, the one with most equal words; of
    these the shortest, then the first.
    """
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if z - a < min(least, len(item)):
        return None
    same = doc[a + shift:z + shift] == item[a:z]
    at = np.flatnonzero(same)
    if len(at) < min(least, len(item)) or not len(at):
        return None
    # Such a stretch begins and ends with equal words i and j, and (MISMATCH + 1) * (j - i + 1) >= MISMATCH * its length.
    level = (MISMATCH + 1) * np.arange(len(at)) - MISMATCH * at
    low = np.minimum.accumulate(level)
    begin = np.searchsorted(-low, -(level + 1))  # the first equal word from which the stretch may run to each
    equal = np.arange(len(at)) - begin + 1
    most = np.flatnonzero(equal == equal.max())
    end = int(most[np.argmin(at[most] - at[begin[most]])])
    first, n = int(at[begin[end]]), int(equal[end])
    return (a + first, int(at[end]) - first + 1, n) if n >= min(least, len(item)) else None


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())])


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The best overlap of each document with each benchmark item it holds.

    In: doc_id, text and item_id, text (more columns are ignored). Out: doc_id, item_id, doc_word and
    item_word (first words of the overlap, from 0), n_words, n_equal. Null and empty texts and null
    item ids overlap with nothing; rows with equal doc_id or item_id give one row, the longest and
    then first overlap; ties go to the earliest place; a null doc_id stays null; empty tables give no rows.
    """
    items = stage(item_words(benchmark))
    seeds = stage(item_seeds(items))
    short = sorted(r["n_item"] for r in items.filter(F.col("n_item").between(1, SPAN - 1)).select("n_item").distinct().collect())
    found = stage(regions(docs, bit_filter(seeds), short))
    hits = found.select("doc_id", "region_at", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "doc_id", "region_at", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    lined = hits.join(seeds, "seed").select(
        "doc_id", "region_at", "item_id", (F.col("at") - F.col("item_at")).cast("int").alias("shift")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            out = {f.name: [] for f in _FOUND}
            for i, shift in enumerate(rows["shift"]):
                got = best_overlap(np.array(rows["words"][i]), np.array(rows["item_words"][i]), shift, min_words)
                if got:
                    place = rows["region_at"][i] + shift + got[0]
                    for name, value in zip(_FOUND.names, (rows["doc_id"][i], rows["item_id"][i], place, *got)):
                        out[name].append(value)
            yield batch(_FOUND, **out)

    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.region_at") == F.col("r.region_at"))
    checked = (
        lined.alias("l").join(found.select("doc_id", "region_at", "words").alias("r"), same)
        .select("l.doc_id", "l.region_at", "item_id", "shift", "words").join(items, "item_id")
        .select("doc_id", "region_at", "item_id", "shift", "words", "item_words")
        .mapInArrow(run, "doc_id long, item_id long, doc_word long, item_word int, n_words int, n_equal int"))
    best = F.max(F.struct("n_equal", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"), "n_words")).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"), "b.n_words", "b.n_equal")
