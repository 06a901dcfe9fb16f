"""Removal of byte strings that occur twice, by a distributed suffix array.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else.

*Phrases.* In every window of ``w`` short byte grams the one with the least hash (the last of equals)
is a sample. Equal strings have equal samples inside, so texts are read as strings of phrases between
samples, about one symbol per ``w / 2`` bytes, and two whole phrases always lie in a match behind its
first sample. Samples whose right context occurs nowhere else (a count over the whole corpus) cannot
be in a match and are dropped. Equal texts are one text here; all their bytes go.

*Suffix array* of the phrase strings by difference cover: positions i with i mod 3 in {1, 2} are
sampled, their triples are sorted and named, the strings of names are solved by recursion until every name that is shared
covers ``length`` bytes (the last 2^16 symbols are ranked by one task), and the
suffixes at i mod 3 = 0 are merged in by two sorted counts. Adjacent suffixes are compared, and where
they agree for ``length`` bytes, both are marked.

*Byte ends.* A match begins and ends inside phrases. Byte positions before a sample whose windows are
not marked yet are merged in as (bytes up to the sample, class of the sample's right context): first
in blocks of 16 starts, whose common part and whole span are compared, then byte by byte in those
blocks where one differs and the other does not.

All sorts are range partitions of rows; no text, string class or group passes through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as ST

from gistline.llm.common import batch, free, give_back, ship, slices, small, stage
from gistline.sources.staging import staged_tables
from gistline.llm.words import BYTE, mix, powers, text_bytes, word_spans

LENGTH = 400
BLOCK = 16  #: Starts in a block; fewer for short strings.
FEW = 1 << 16  #: Strings with so many symbols in all end the recursion.
HALO = 1 << 16  #: Suffixes that one task compares with their neighbours.
_END = -(1 << 63)  #: Sorts before every symbol.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def shape(length: int) -> tuple[int, int]:
    """Bytes in a gram and grams in a window, so that three windows fit into a match."""
    gram = max(1, min(16, length // 8))
    return gram, max(1, (length - gram) // 3)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(gram)
    table = BYTE[raw]
    have, h = 1, table
    with np.errstate(over="ignore"):
        while have * 2 <= gram:
            h = h[:-have] * p[have] + h[have:]
            have *= 2
        for k in range(have, gram):
            h = h[:n + gram - k - 1] * p[1] + table[k:k + len(h) - 1]
        return mix(h[:n])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` hashes the place of the least, the last of equals; hashes count by their top bits.

    Minima from the beginning and from the end of blocks of ``w`` give those of all windows.
    """
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(24, n.bit_length()))  # the same for all but texts over 16 MB, so that equal strings agree
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n - w + 1], ahead[w - 1:n])
    return (mask - (least & mask)).astype(np.int64)


def samples(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of its text, place, and the first and last window start that can begin a match, of each sample of
    the texts that ``offsets`` cut ``raw`` into; places count from the beginning of ``raw``."""
    gram, w = shape(length)
    sizes, stops = np.diff(offsets), offsets[1:]
    windows = np.where(sizes >= length, sizes - (w + gram - 2), 0)
    text, start = _ranges(offsets[:-1], windows)
    at = window_minima(gram_hashes(raw, gram), w)[start]  # never goes back inside a text
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], start[first], np.minimum(start[last], stops[text[first]] - length)


def _ranges(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges that begin at ``begin`` and have ``n`` entries, one after the other: whose they are, and they themselves."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) + (begin - (np.cumsum(n) - n))[own]


class Prefix:
    """Hashes of any substring, by two polynomials, from sums over the text."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, {}

    def of(self, a: np.ndarray, z: np.ndarray, k: int = 0) -> np.ndarray:
        n = len(self.raw)
        with np.errstate(over="ignore"):
            if k not in self.sums:
                value = _BYTES[k][self.raw] * _power_table(_BASES[k], n + 1)[:n]
                self.sums[k] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            down = _power_table(pow(_BASES[k], -1, 1 << 64), n + 1)
            return mix((self.sums[k][z] - self.sums[k][a]) * down[a] + (z - a).astype(np.uint64) * BYTE[3]).view(np.int64)


_BYTES = [BYTE, np.roll(BYTE, 101)]
_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done, step = 1, np.uint64(base)
        with np.errstate(over="ignore"):
            while done < size:
                out[done:2 * done] = out[:done] * step
                step = step * step
                done *= 2
        have = out
        if size <= 1 << 21:  # the tables of very long texts are not kept
            _POWERS[base] = out
    return have[:n]


def _texts(b: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    for i, t in enumerate(b.column(name).cast(pa.large_binary())):
        yield i, np.frombuffer(t.as_py() or b"", np.uint8)


_TEXT = 1 << 17  #: Bytes of text whose samples, blocks or starts are made at once.
_SAMPLES = pa.schema([(c, pa.int64()) for c in ("tid", "core", "symbol")] + [(c, pa.int32()) for c in ("idx", "pos", "size", "lo", "hi")])


def sample_rows(texts: DataFrame, length: int) -> DataFrame:
    """Samples of each text: number, place, phrase behind it (name and bytes), key of its right context."""
    gram, w = shape(length)
    right = length - w + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text", _TEXT):
            raw, offsets = text_bytes(b.column("text"))
            text, pos, lo, hi = samples(raw, offsets, length)
            before, stop = offsets[text], offsets[text + 1]
            idx = np.arange(len(text)) - np.searchsorted(text, text)
            ends = np.append(pos[1:], len(raw))
            ends = np.where(np.append(text[1:] == text[:-1], False)[:len(text)], ends[:len(text)], stop)
            keep = np.flatnonzero(pos + right <= stop)
            h, p = Prefix(raw), pos[keep]
            cols = {"tid": b.column("tid").to_numpy()[text[keep]], "core": h.of(p, p + right), "symbol": np.maximum(h.of(p, ends[keep]), _END + 1),
                    "idx": idx[keep], "pos": p - before[keep], "size": ends[keep] - p, "lo": (lo - before)[keep], "hi": (hi - before)[keep]}
            yield batch(_SAMPLES, **{f.name: cols[f.name].astype(f.type.to_pandas_dtype()) for f in _SAMPLES})

    return texts.select("tid", "text").mapInArrow(run, "tid long, core long, symbol long, idx int, pos int, size int, lo int, hi int")


def number_sorted(df: DataFrame, keys: list[str], name: str, weight: str | None = None) -> DataFrame:
    """``df`` written in the order of ``keys``, each row with its place in it as ``name``.

    With ``weight``, the place is the sum of the weights before the row. Range partitions are numbered
    each; their row counts, one row per partition, make the offsets.
    """
    fields = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            own = b.column(weight).to_numpy() if weight else np.ones(b.num_rows, np.int64)
            upto = at + np.cumsum(own)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(upto - own, pa.int64())],
                names=[*b.schema.names, "_part", "_at"])
            at = upto[-1] if len(upto) else at

    schema = ST.StructType([*fields, ST.StructField("_part", ST.IntegerType()), ST.StructField("_at", ST.LongType())])
    rows = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.sum(weight if weight else F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def _arrays(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    col = b.column(name)
    begin, values = col.offsets.to_numpy(), col.values.to_numpy()
    return [values[begin[i]:begin[i + 1]] for i in range(len(col))]


def _at(values: np.ndarray, i: np.ndarray, beyond: int) -> np.ndarray:
    return np.append(values, beyond)[np.minimum(i, len(values))]


def _rows(schema: pa.Schema, parts: list[tuple]) -> pa.RecordBatch:
    """Rows from tuples of arrays; a single number stands for all rows of its tuple."""
    out = []
    for k, f in enumerate(schema):
        cols = [np.broadcast_to(p[k], len(p[1])) for p in parts]
        out.append(pa.array(np.concatenate(cols).astype(f.type.to_pandas_dtype()) if cols else np.zeros(0, f.type.to_pandas_dtype()), f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


_TRIPLES = pa.schema([(c, pa.int64()) for c in ("sid", "i", "a", "b", "c", "bytes")])
_WHOLE = 1 << 40  #: Bytes of what reaches the end of its string.
_KEYED = pa.schema([(c, pa.int64()) for c in ("sid", "i", "kind", "c", "c2", "r1", "r2", "own")])


def _child(r: int) -> Column:
    return F.col("sid") * 2 + (r - 1)


def local_ranks(strings: list[np.ndarray]) -> list[np.ndarray]:
    """Ranks of all suffixes of a few strings, by doubling the compared length."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    flat = np.concatenate([*strings, np.zeros(0, np.int64)])
    n, step = len(flat), 1
    _, rank = np.unique(flat, return_inverse=True)
    while n and step < sizes.max() and rank.max() + 1 < n:
        after = np.arange(n) + step
        second = np.where(after < ends, rank[np.minimum(after, n - 1)] + 1, 0)
        _, rank = np.unique(rank * (n + 1) + second, return_inverse=True)
        step *= 2
    place = np.empty(n, np.int64)
    place[np.argsort(rank, kind="stable")] = np.arange(n)
    return np.split(place, np.cumsum(sizes)[:-1]) if len(strings) else []


_RANKS = pa.schema([("sid", pa.int64()), ("ranks", pa.list_(pa.int64()))])


def _few_ranks(strings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, syms = [], []
        for b in batches:
            sids += b.column("sid").to_pylist()
            syms += _arrays(b, "syms")
        yield batch(_RANKS, sid=sids, ranks=local_ranks(syms))

    return strings.select("sid", "syms").coalesce(1).mapInArrow(run, "sid long, ranks array<long>")


_PARTS = pa.schema([("child", pa.int64()), ("q0", pa.int32()), ("syms", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _open_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of open names of each string, each with the name behind it, at which comparisons end."""
    for b in batches:
        rows = {c: [np.zeros(0, np.int64)] for c in ("child", "q0", "n", "syms", "sizes")}
        for child, name, size, vague in zip(b.column("child").to_pylist(), *[_arrays(b, c) for c in ("name", "bytes", "open")]):
            before = np.append(0, vague[:-1])
            kept = np.flatnonzero(vague | before)
            first = np.flatnonzero((vague > 0) & (before == 0))
            n = np.diff(np.append(np.searchsorted(kept, first), len(kept)))
            for c, v in (("child", np.full(len(first), child)), ("q0", first), ("n", n), ("syms", name[kept]), ("sizes", size[kept])):
                rows[c].append(v)
        x = {c: np.concatenate(v) for c, v in rows.items()}
        cuts = pa.array(np.append(0, np.cumsum(x["n"])), pa.int32())
        yield batch(_PARTS, child=x["child"], q0=x["q0"].astype(np.int32), **{c: pa.ListArray.from_arrays(cuts, pa.array(x[c], pa.int64())) for c in ("syms", "sizes")})


def difference_cover(strings: DataFrame, length: int = _WHOLE) -> DataFrame:
    """Ranks of all suffixes of all strings, as far as ``length`` bytes tell them apart.

    In: sid, syms (array of symbols above the least long), sizes (bytes of each). Out: sid, ranks: for
    each suffix a number, smaller for smaller suffixes; a suffix that ends comes before its
    continuations; numbers of suffixes that agree so far lie together, in any order.
    """
    with staged_tables(strings.sparkSession) as keep:
        return keep(_ranks(strings, length))


def _ranks(strings: DataFrame, length: int) -> DataFrame:
    if (strings.agg(F.sum(F.size("syms"))).first()[0] or 0) <= FEW:
        return _few_ranks(strings)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for sid, s, sizes in zip(b.column("sid").to_pylist(), _arrays(b, "syms"), _arrays(b, "sizes")):
                i = np.arange(len(s))
                i = i[i % 3 > 0]
                size = np.minimum(sizes[i] + _at(sizes, i + 1, _WHOLE) + _at(sizes, i + 2, _WHOLE), _WHOLE)
                parts.append((sid, i, s[i], _at(s, i + 1, _END), _at(s, i + 2, _END), size))
            yield _rows(_TRIPLES, parts)

    sampled = stage(strings.mapInArrow(triples, "sid long, i long, a long, b long, c long, bytes long"))
    if not sampled.isEmpty():
        # A name is how many triples are less; equal triples share it.
        named = number_sorted(sampled.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes")), ["a", "b", "c"], "name", "n")
        # Open names are shared and too short; all others settle the order of whatever they differ in or agree on.
        vague = (F.col("n") > 1) & (F.col("bytes") < length)
        names = sampled.select("sid", "i", "a", "b", "c").join(named.withColumn("open", vague).drop("n"), ["a", "b", "c"]).select("sid", "i", "name", "bytes", "open")
        if named.filter(vague).isEmpty():
            ranked = names.withColumn("r", F.col("name"))
        else:
            reduced = stage(names.withColumn("child", F.when(F.col("i") % 3 == 1, _child(1)).otherwise(_child(2))).withColumn("q", F.floor(F.col("i") / 3).cast("int")))
            listed = reduced.groupBy("child").agg(F.sort_array(F.collect_list(F.struct("q", "name", "bytes", F.col("open").cast("long").alias("open")))).alias("s")).select(
                "child", *[F.col(f"s.{c}").alias(c) for c in ("name", "bytes", "open")])
            parts = stage(listed.mapInArrow(_open_parts, "child long, q0 int, syms array<long>, sizes array<long>").withColumn("sid", F.monotonically_increasing_id()))
            solved = difference_cover(parts.select("sid", "syms", "sizes"), length)
            inner = parts.select("sid", "child", "q0").join(solved, "sid").select("child", "q0", F.posexplode("ranks").alias("at", "inner")).select(
                "child", (F.col("q0") + F.col("at")).alias("q"), "inner")
            undecided = stage(reduced.filter("open").select("sid", "i", "child", "q", "name").join(inner, ["child", "q"]).select("sid", "i", "name", "inner"))
            # Parts that begin with one name lie together in their order.
            least = small(stage(undecided.groupBy("name").agg(F.min("inner").alias("least"))), 16)
            decided = undecided.join(least, "name").select("sid", "i", (F.col("name") + F.col("inner") - F.col("least")).alias("r"))
            ranked = reduced.filter("not open").select("sid", "i", F.col("name").alias("r")).unionByName(decided)
        ranks = ranked.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("s")).select(
            "sid", F.col("s.i").alias("at"), F.col("s.r").alias("ranks"))
        known = strings.join(ranks, "sid", "left")
    else:
        known = strings.withColumn("at", F.lit(None).cast("array<bigint>")).withColumn("ranks", F.lit(None).cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    known = known.select("sid", "syms", F.coalesce("at", none).alias("at"), F.coalesce("ranks", none).alias("ranks"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for sid, s, at, own in zip(b.column("sid").to_pylist(), _arrays(b, "syms"), _arrays(b, "at"), _arrays(b, "ranks")):
                r = np.full(len(s), -1, np.int64)
                r[at] = own
                i = np.arange(len(s))
                parts.append((sid, i, i % 3, s, _at(s, i + 1, _END), _at(r, i + 1, -1), _at(r, i + 2, -1), r))
            yield _rows(_KEYED, parts)

    rows = stage(known.mapInArrow(keyed, "sid long, i long, kind long, c long, c2 long, r1 long, r2 long, own long"))
    one = _merge_counts(rows.filter("kind in (0, 1)").select("sid", "i", "kind", "c", "r1"), ["c", "r1"])
    two = _merge_counts(rows.filter("kind in (0, 2)").select("sid", "i", "kind", "c", "c2", "r2"), ["c", "c2", "r2"])
    # What stands before a suffix: of its own kind in the first place, then of the others.
    parts = (
        rows.filter("kind > 0").select("sid", "i", F.col("own").alias("n"))
        .unionByName(one.select("sid", "i", F.when(F.col("kind") == 0, F.col("zeros") + F.col("others")).otherwise(F.col("zeros")).alias("n")))
        .unionByName(two.select("sid", "i", F.when(F.col("kind") == 0, F.col("others")).otherwise(F.col("zeros")).alias("n"))))
    listed = parts.groupBy("sid").agg(F.collect_list(F.struct("i", "n")).alias("s")).select("sid", F.col("s.i").alias("i"), F.col("s.n").alias("n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [np.bincount(i, n).astype(np.int64) for i, n in zip(_arrays(b, "i"), _arrays(b, "n"))]
            yield batch(_RANKS, sid=b.column("sid"), ranks=sums)

    return listed.mapInArrow(add, "sid long, ranks array<long>")


def _merge_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each row, how many rows of kind 0 and of the other kind come before it in the order of ``keys``."""
    own = number_sorted(rows, keys, "place")
    block = (F.col("place") / HALO).cast("long")
    inside = Window.partitionBy(block).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    per_block = own.groupBy(block.alias("block")).agg(F.count_if(F.col("kind") == 0).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = per_block.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        own.withColumn("block", block)
        .withColumn("inside", F.coalesce(F.count_if(F.col("kind") == 0).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "block")
        .withColumn("zeros", F.col("inside") + F.col("offset")).withColumn("others", F.col("place") - F.col("zeros")))


_SUFFIXES = pa.schema([(c, pa.int64()) for c in ("rank", "tid", "pos", "bytes")] + [("syms", pa.list_(pa.int64()))])
_AGREE = pa.schema([(c, pa.int64()) for c in ("tid", "pos", "same")] + [("part", pa.int32()), ("edge", pa.int32()), ("syms", pa.list_(pa.int64()))])
_STEP = 1 << 17  #: Symbols that one batch of suffixes holds.


def _lists(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists that begin at ``begin`` and have ``n`` entries each, one after the other, and their offsets."""
    return values[_ranges(begin, n)[1]], np.append(0, np.cumsum(n))


def agreements(strings: DataFrame, length: int) -> DataFrame:
    """(tid, pos, same): the samples whose suffix agrees with a neighbour in the suffix array for ``length``
    bytes, and the bytes ``same`` of as many whole phrases (two rows a sample at most)."""
    ranks = difference_cover(strings.select("sid", "syms", "sizes"), length)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, have = [], 0
            for tid, s, sizes, pos, r in zip(b.column("tid").to_pylist(), *[_arrays(b, c) for c in ("syms", "sizes", "pos", "ranks")]):
                ends = np.cumsum(sizes)
                last = np.searchsorted(ends, ends - sizes + length, side="left")
                i = np.flatnonzero(last < len(s))  # what ends before agrees for less
                n = last[i] + 1 - i
                for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(n) // _STEP)) + 1):
                    rows.append((r[i[k]], np.full(len(k), tid), pos[i[k]].astype(np.int64), ends[last[i[k]]] - (ends - sizes)[i[k]], n[k], _lists(s, i[k], n[k])[0]))
                    have += len(rows[-1][-1])
                    if have >= _STEP:
                        yield suffixes(rows)
                        rows, have = [], 0
            if rows:
                yield suffixes(rows)

    def suffixes(rows: list[tuple]) -> pa.RecordBatch:
        rank, tid, pos, size, n, syms = map(np.concatenate, zip(*rows))
        cuts = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        return batch(_SUFFIXES, rank=rank, tid=tid, pos=pos, bytes=size, syms=pa.ListArray.from_arrays(cuts, pa.array(syms, pa.int64())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if last is None:
                yield edge(b.slice(0, 1), part, 0)
            else:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            tid, pos, size = (b.column(c).to_numpy() for c in ("tid", "pos", "bytes"))
            col = b.column("syms")
            cuts, flat = col.offsets.to_numpy().astype(np.int64), col.values.to_numpy()
            n = np.diff(cuts)
            k = np.flatnonzero((n[:-1] == n[1:]) & (size[:-1] == size[1:]))
            if len(k):
                one, first = _lists(flat, cuts[k], n[k])
                k = k[np.logical_and.reduceat(one == _lists(flat, cuts[k + 1], n[k])[0], first[:-1])]
            k = np.union1d(k, k + 1)
            yield batch(_AGREE, tid=tid[k], pos=pos[k], same=size[k], part=np.full(len(k), part), edge=np.full(len(k), -1), syms=pa.nulls(len(k), pa.list_(pa.int64())))
            last = b.slice(b.num_rows - 1, 1)
        if last is not None:
            yield edge(last, part, 1)

    def edge(row: pa.RecordBatch, part: int, which: int) -> pa.RecordBatch:
        return batch(_AGREE, tid=row.column("tid").to_numpy(), pos=row.column("pos").to_numpy(), same=row.column("bytes").to_numpy(),
                     part=[part], edge=[which], syms=pa.array(row.column("syms").to_pylist(), pa.list_(pa.int64())))

    suffix = stage(strings.join(ranks, "sid").mapInArrow(spread, "rank long, tid long, pos long, bytes long, syms array<long>"))
    order = ["rank", "tid", "pos"]  # equal ranks, too, go to many tasks
    compared = stage(suffix.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        compare, "tid long, pos long, same long, part int, edge int, syms array<long>"))
    # The last suffix of a task has its neighbour in the next one; two rows a task.
    one = F.struct("tid", "pos", "same")
    beyond = Window.orderBy("part", "edge")
    borders = compared.filter("edge >= 0").select(
        "edge", "syms", one.alias("one"), F.lead("syms").over(beyond).alias("next_syms"), F.lead(one).over(beyond).alias("next")).filter(
        (F.col("edge") == 1) & (F.col("syms") == F.col("next_syms"))).select(F.explode(F.array("one", "next")).alias("x")).select("x.*")
    return compared.filter("edge < 0").select("tid", "pos", "same").unionByName(borders)


_BLOCKS = pa.schema([(c, pa.int64()) for c in ("core", "s1", "s2", "tid", "lo", "hi")])
_STARTS = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "tid", "lo", "many")])


def _chosen(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The number of the text of each packed triple in ``samples``, and its three numbers."""
    raw, offsets = text_bytes(b.column("samples"))
    yield np.repeat(np.arange(b.num_rows), np.diff(offsets) // 12)
    yield from np.frombuffer(raw.tobytes(), np.int32).astype(np.int64).reshape(-1, 3).T


def block_rows(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of match starts before given samples (``samples``: pos, lo, hi): key of what all their
    matches share, and of all they cover together (null where that leaves the text)."""
    block = max(1, min(BLOCK, length // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text", _TEXT):
            raw, offsets = text_bytes(b.column("text"))
            text, pos, lo, hi = _chosen(b)
            j0, j1 = (pos - hi) // block, (pos - lo) // block
            at, j = _ranges(j0, np.where(hi >= lo, j1 - j0 + 1, 0))
            text, before = text[at], offsets[text[at]]
            last = pos[at] - block * j  # the last start of the block
            first = last - block + 1
            a, z = np.maximum(first, lo[at]), np.minimum(last, hi[at])
            whole = (first >= 0) & (before + last + length <= offsets[text + 1])
            fa, fz = np.where(whole, before + first, 0), np.where(whole, before + last + length, 0)
            h = Prefix(raw)
            yield batch(
                _BLOCKS, core=h.of(before + last, before + first + length) + j, tid=b.column("tid").to_numpy()[text], lo=a, hi=z,
                s1=pa.array(h.of(fa, fz), mask=~whole), s2=pa.array(h.of(fa, fz, 1), mask=~whole))

    return texts.select("tid", "text", "samples").mapInArrow(run, "core long, s1 long, s2 long, tid long, lo long, hi long")


def start_rows(texts: DataFrame, length: int) -> DataFrame:
    """Every match start of given blocks (``samples``: lo, hi, many) with the key of its string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text", _TEXT):
            raw, offsets = text_bytes(b.column("text"))
            text, lo, hi, many = _chosen(b)
            own, at = _ranges(lo, hi - lo + 1)
            h, from_, tids = Prefix(raw), at + offsets[text[own]], b.column("tid").to_numpy()
            yield batch(_STARTS, w1=h.of(from_, from_ + length), w2=h.of(from_, from_ + length, 1), tid=tids[text[own]], lo=at, many=many[own])

    return texts.select("tid", "text", "samples").mapInArrow(run, "w1 long, w2 long, tid long, lo long, many long")


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges (tid, lo, hi) of starts whose string of ``length`` bytes starts elsewhere too; texts differ from each other."""
    with staged_tables(texts.sparkSession) as keep:
        return keep(_repeated_starts(texts, length))


def _repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    rows = stage(sample_rows(texts, length))
    often = stage(rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    kept = stage(rows.join(small(often, 8), "core"))
    by_text = Window.partitionBy("tid").orderBy("idx")
    runs = kept.withColumn("run", F.col("idx") - F.row_number().over(by_text))  # samples in a row share it
    strings = stage(
        runs.groupBy("tid", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "symbol", "size", "pos"))).alias("s"))
        .select(F.monotonically_increasing_id().alias("sid"), "tid", F.col("s.symbol").alias("syms"), F.col("s.size").cast("array<bigint>").alias("sizes"), F.col("s.pos").alias("pos")))
    marked = agreements(strings, length).select("tid", F.col("pos").alias("lo"), (F.col("pos") + F.col("same") - length).alias("hi"))

    # Samples with starts that are not marked, and all samples that share a right context with them.
    spans = marked.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def open_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cores = [np.zeros(0, np.int64)]
            for core, lo, hi, first, last in zip(*[_arrays(b, c) for c in ("core", "lo", "hi", "first", "last")]):
                edges = union_ranges(np.stack([first, last + 1], axis=1).astype(np.int64))
                k = np.searchsorted(edges[:, 0], lo, side="right") - 1
                inside = (edges[np.maximum(k, 0), 1] > hi) & (k >= 0) if len(edges) else np.zeros(len(lo), bool)
                cores.append(core[(hi >= lo) & ~inside])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cores), pa.int64())], names=["core"])

    none = F.array().cast("array<bigint>")
    grouped = kept.groupBy("tid").agg(F.collect_list(F.struct("core", "lo", "hi")).alias("own")).join(spans, "tid", "left").select(
        F.col("own.core").alias("core"), F.col("own.lo").alias("lo"), F.col("own.hi").alias("hi"),
        F.coalesce("marks.lo", none).alias("first"), F.coalesce("marks.hi", none).alias("last"))
    open_cores = stage(grouped.mapInArrow(open_ones, "core long").distinct())
    wanted = _per_text(kept.join(open_cores, "core"), "pos", "lo", "hi")

    def picked(chosen: DataFrame) -> DataFrame:
        return texts.join(small(chosen, F.octet_length("samples") + 64), texts.tid == chosen["_tid"]).drop("_tid")

    blocks = stage(block_rows(picked(wanted), length))
    spans_of = stage(blocks.groupBy("core", "s1", "s2").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("tid", "lo", "hi")).alias("one")))
    whole = blocks.join(spans_of.filter("many > 1 and s1 is not null").select("core", "s1", "s2"), ["core", "s1", "s2"]).select("tid", "lo", "hi")
    mixed = spans_of.groupBy("core").agg(F.count(F.lit(1)).alias("spans"), F.bool_or(F.col("s1").isNull()).alias("cut")).filter("spans > 1 or cut")
    # Of equal spans one stands for all; blocks at the end of a text stand for themselves.
    single = spans_of.filter("s1 is not null").join(mixed, "core").select("one.tid", "one.lo", "one.hi", "many")
    cut = blocks.filter("s1 is null").select("tid", "lo", "hi", F.lit(1).cast("long").alias("many"))
    again = _per_text(single.unionByName(cut).withColumn("many", F.least("many", F.lit(2))), "lo", "hi", "many")
    starts = stage(start_rows(picked(again), length))
    twice = starts.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = starts.filter("many = 1").join(twice, ["w1", "w2"]).select("tid", "lo", F.col("lo").alias("hi"))
    return marked.unionByName(whole).unionByName(found)


_PACKED = pa.schema([("_tid", pa.int64()), ("samples", pa.binary())])


def _per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """(_tid, samples): the columns' numbers of all rows of a text, as packed 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [_arrays(b, c) for c in columns]
            yield batch(_PACKED, _tid=b.column("tid"), samples=[np.stack(x, axis=1).astype(np.int32).tobytes() for x in zip(*cols)])

    listed = rows.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("s")).select("tid", *[F.col(f"s.{c}").alias(c) for c in columns])
    return stage(listed.mapInArrow(run, "_tid long, samples binary"))


def _merged(ranges: DataFrame, name: str, length: int) -> DataFrame:
    """Ranges of starts (tid, lo, hi) by text, those whose strings touch joined, as packed pairs of removed bytes."""
    packed = pa.schema([("tid", pa.int64()), (name, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [union_ranges(np.stack([lo, hi + length], axis=1)).astype(np.int64).tobytes() for lo, hi in zip(_arrays(b, "lo"), _arrays(b, "hi"))]
            yield batch(packed, **{"tid": b.column("tid"), name: gone})

    listed = ranges.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select("tid", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    return listed.mapInArrow(run, f"tid long, `{name}` binary")


def union_ranges(ranges: np.ndarray) -> np.ndarray:
    """Half-open ranges, joined where they touch, ascending."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > ends[:-1])
    heads = np.flatnonzero(new)
    return np.stack([ranges[heads, 0], ends[np.append(heads[1:] - 1, len(ranges) - 1)]], axis=1)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def removal_ranges(docs: DataFrame, length: int = LENGTH, name: str = "ranges") -> DataFrame:
    """``docs`` with a column ``name``: removed ranges of bytes (packed pairs of 64-bit numbers), null where there are none."""
    ship(docs.sparkSession)
    mark = free(docs, "_tid")
    docs = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    long_ones = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(mark).alias("tid")).filter(F.octet_length("text") >= length)
    ids = stage(long_ones.select("tid", "doc_id", F.octet_length("text").cast("long").alias("n")))
    equal = stage(ids.groupBy("tid").agg(F.count(F.lit(1)).alias("many"), F.min("doc_id").alias("first"), F.max("n").alias("n")).filter("many > 1"))
    extra = ids.join(equal.select("tid", "first"), "tid").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("tid").alias("_tid"), F.col("doc_id").alias("_id"))
    extra = small(stage(extra), 16)
    texts = long_ones.join(extra, (long_ones.tid == extra["_tid"]) & long_ones.doc_id.eqNullSafe(extra["_id"]), "left_anti").select("tid", "text")
    starts = repeated_starts(texts, length)
    whole = equal.select("tid", F.lit(0).cast("long").alias("lo"), (F.col("n") - length).alias("hi"))
    ranges = stage(_merged(starts.join(equal.select("tid"), "tid", "left_anti").unionByName(whole), name, length).withColumnRenamed("tid", mark))
    return docs.join(small(ranges, F.octet_length(name) + 64), mark, "left").drop(mark)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Every document without the bytes of strings that occur twice.

    In: doc_id, text (more columns are ignored). Out: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and ``kept`` (bytes) if asked for. Null texts are empty; equal texts, repeated rows
    too, lose everything if they have ``length`` bytes; texts are told apart by 64-bit hashes, strings
    by 128 bits; a null doc_id stays null; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text"):
            out = {f.name: [] for f in _RESULT}
            for (i, raw), ranges in zip(_texts(b), b.column("ranges").to_pylist()):
                gone = np.frombuffer(ranges or b"", np.int64).reshape(-1, 2)
                data = raw.tobytes()
                kept = b"".join(data[a:z] for a, z in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(data)]))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
            out["doc_id"] = b.column("doc_id")
            yield batch(_RESULT, **out)

    done = removal_ranges(docs.select(F.col("doc_id").cast("long"), "text"), length).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")


_CORES = pa.schema([(c, pa.int64()) for c in ("tid", "lo", "h", "g")])


def least_bytes(min_words: int) -> int:
    """Bytes that so many words have at least: one each, and a blank between two."""
    return max(1, 2 * min_words - 1)


def _repeating_runs(marked: DataFrame, name: str, min_words: int) -> DataFrame:
    """tid and ``los``, the beginnings of those ranges that hold a string of ``min_words`` words that is in ranges twice.

    Any such string holds one from the last byte of a word to the first byte of the last of ``min_words`` words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text"):
            tids, ranges = b.column("tid").to_numpy(), b.column(name).to_pylist()
            for i, raw in _texts(b):
                runs = np.frombuffer(ranges[i], np.int64).reshape(-1, 2)
                starts, stops, _ = word_spans(raw, np.array([0, len(raw)]))
                if len(starts) < min_words:
                    continue
                a, z = stops[:len(stops) - min_words + 1] - 1, starts[min_words - 1:] + 1
                own = np.searchsorted(runs[:, 0], a, side="right") - 1
                inside = (own >= 0) & (z <= runs[own, 1])
                a, z, own, h = a[inside], z[inside], own[inside], Prefix(raw)
                if len(a):
                    yield batch(_CORES, tid=np.full(len(a), tids[i]), lo=runs[own, 0], h=h.of(a, z), g=h.of(a, z, 1))

    cores = stage(marked.select("tid", "text", name).filter(F.col(name).isNotNull()).mapInArrow(run, "tid long, lo long, h long, g long"))
    twice = stage(cores.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("_h"), F.col("g").alias("_g")))
    twice = small(twice, 16)
    held = cores.join(twice, (cores.h == twice["_h"]) & (cores.g == twice["_g"]), "left_semi")
    return stage(held.groupBy("tid").agg(F.collect_set("lo").alias("los")))


def without_passages(docs: DataFrame, length: int, min_words: int) -> DataFrame:
    """``docs`` (with all its columns) without passages of ``min_words`` words or more that repeat.

    A passage is a maximal run of bytes covered by strings of ``length`` bytes that start elsewhere
    too, and holds a string of ``min_words`` words that does; several shorter repeats side by side are
    none. With ``least_bytes(min_words)`` as ``length`` the words alone decide. Bytes of characters that a passage cuts through go with it. Rows that lose all their text are
    dropped; ``n_chars``, where there is such a column, is renewed.
    """
    ship(docs.sparkSession)
    name = free(docs, "_ranges")
    tid, los = free(docs, "_run_tid"), free(docs, "_run_los")
    found = removal_ranges(docs, length, name).withColumn(tid, F.xxhash64(F.coalesce("text", F.lit(""))))
    held = _repeating_runs(found.select(F.col(tid).alias("tid"), F.col("text").alias("text"), name), name, min_words)
    held = small(held.select(F.col("tid").alias(tid), F.col("los").alias(los)), F.size(los) * 8 + 64)
    found = found.join(held, tid, "left").select(*docs.columns, name, los)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches, "text"):
            texts, keep = [], []
            for (i, raw), ranges, held_los in zip(_texts(b), b.column(name).to_pylist(), b.column(los).to_pylist()):
                old = b.column("text")[i].as_py()
                if not ranges or not held_los:
                    texts.append(old)
                    keep.append(i)
                    continue
                data, begins = raw.tobytes(), set(held_los)
                gone = [(a, z) for a, z in np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist() if a in begins]
                kept = b"".join(data[a:z] for a, z in zip([0, *[z for _, z in gone]], [*[a for a, _ in gone], len(data)])).decode("utf-8", "ignore")
                if kept.strip() or not gone:
                    texts.append(kept if gone else old)
                    keep.append(i)
            part = b.drop_columns([name, los]).take(pa.array(keep, pa.int64()))
            part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield part

    done = found.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in done.columns else done
