"""Token-id files coded with a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all blocks. A block holds whole documents in
ascending doc_id order and is decoded without any other block. Inside it, ids are dealt over lanes
that are coded in step, so that a step is a few array operations; at fixed steps a checkpoint keeps
the lane states and the place in the coded words, from where decoding can start. Checksums cover the
coded bytes and the ids.

A file set is a Parquet folder, so that writing is atomic per task and works on any store Spark
reaches; its ``block`` column has the bytes of the format:

    "RNS1", ids, documents, lanes, bits, steps between checkpoints, words, crc32 of the table, crc32 of the ids
    doc_id and number of ids of each document
    place in the words at each checkpoint, lane states at each checkpoint
    words
    crc32 of everything before
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gistline.llm.common import batch, new_folder, slices, stage
from gistline.llm.tokens import default_path, encoder

LANES = 512
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 18
MAX_BITS = 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sQIIIIQII")


class Table:
    """Frequencies scaled to a power of two; every id that occurs keeps at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols = symbols[order].astype(np.uint32)
        counts = counts[order].astype(np.int64)
        n = max(len(self.symbols), 1)
        self.bits = min(MAX_BITS, max(14, (n - 1).bit_length() + 4))
        assert n <= 1 << self.bits, "more distinct ids than the table has slots"
        total, slots = max(int(counts.sum()), 1), 1 << self.bits
        freq = np.maximum(1, (counts.astype(np.float64) * slots / total).astype(np.int64))
        over = int(freq.sum()) - slots
        if over <= 0:
            if len(freq):
                freq[np.argmax(freq)] -= over
        else:  # take back from the largest
            for i in np.argsort(-freq, kind="stable"):
                take = min(over, max(0, int(freq[i]) - max(1, int(freq[i] * 0.5))))
                freq[i] -= take
                over -= take
                if not over:
                    break
            while over:  # many ids with one slot each
                big = np.flatnonzero(freq > 1)[:over]
                freq[big] -= 1
                over -= len(big)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.crc = zlib.crc32(self.symbols.tobytes() + self.freq.tobytes())
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    index = np.searchsorted(table.symbols, ids)
    freq, cum = table.freq[index], table.cum[index]
    bits = np.uint64(table.bits)
    limit = freq << np.uint64(63 - table.bits)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    kept: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[:b - a]
        full = x >= limit[a:b]
        if full.any():
            words[t] = x[full].astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
        f = freq[a:b]
        q = x // f
        state[:b - a] = (q << bits) + (x - q * f) + cum[a:b]
        if t % CHECKPOINT_STEPS == 0:
            kept[t] = state.copy()
    sizes = np.fromiter(map(len, words), np.int64, steps)
    before = np.cumsum(sizes) - sizes
    marks = sorted(kept)
    body = b"".join([
        _HEAD.pack(b"RNS1", n, len(doc_ids), lanes, table.bits, CHECKPOINT_STEPS, int(sizes.sum()), table.crc, zlib.crc32(ids.astype("<u4").tobytes())),
        doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
        before[marks].astype("<u8").tobytes(), np.concatenate([kept[t] for t in marks]).astype("<u8").tobytes() if marks else b"",
        np.concatenate(words).astype("<u4").tobytes() if steps else b""])
    return body + struct.pack("<I", zlib.crc32(body))


def parts_of(block: bytes) -> dict:
    """The fields of a block, after its checksum is tested."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's bytes are damaged")
    magic, n, docs, lanes, bits, every, n_words, table_crc, ids_crc = _HEAD.unpack_from(block)
    if magic != b"RNS1":
        raise ValueError("not a block of token ids")
    marks = -(-(-(-n // lanes)) // every)
    at, out = _HEAD.size, {"n": n, "lanes": lanes, "bits": bits, "every": every, "table_crc": table_crc, "ids_crc": ids_crc}
    for name, kind, size in (("doc_ids", "<i8", docs), ("counts", "<u4", docs), ("places", "<u8", marks), ("states", "<u8", marks * lanes), ("words", "<u4", n_words)):
        out[name] = np.frombuffer(block, kind, size, at)
        at += out[name].nbytes
    return out


def decode_from(p: dict, mark: int, table: Table, steps: int | None = None) -> np.ndarray:
    """Ids from a checkpoint on: up to the next checkpoint, or ``steps`` steps."""
    lanes, n = p["lanes"], p["n"]
    state = p["states"][mark * lanes:(mark + 1) * lanes].astype(np.uint64)
    at, words = int(p["places"][mark]), p["words"]
    first = mark * p["every"]
    last = min(-(-n // lanes), first + (steps or p["every"]))
    slots, mask, bits = table.slots(), np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    for t in range(first, last):
        m = min(n, (t + 1) * lanes) - t * lanes
        x = state[:m]
        low = x & mask
        s = slots[low]
        out[(t - first) * lanes:(t - first) * lanes + m] = s
        x = table.freq[s] * (x >> bits) + low - table.cum[s]
        short = x < _LOW
        k = int(short.sum())
        if k:
            x[short] = (x[short] << np.uint64(32)) | words[at:at + k]
            at += k
        state[:m] = x
    return table.symbols[out]


def decode_block(block: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids; both checksums are tested."""
    p = parts_of(block)
    if p["table_crc"] != table.crc:
        raise ValueError("a block was written with another frequency table")
    ids = decode_from(p, 0, table, -(-p["n"] // p["lanes"])) if p["n"] else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != p["ids_crc"]:
        raise ValueError("decoded ids differ from the written ones")
    return p["doc_ids"], p["counts"], ids


_IDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of each document, as compressed 32-bit or 16-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zip_ = encoder(path), zstandard.ZstdCompressor(3)
        for b in slices(batches, "text"):
            flat, counts = enc.encode([t or "" for t in b.column("text").to_pylist()])
            rows = []
            for to, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                rows.append(_pack(np.append(flat[to - n:to], np.uint32(end_id)), zip_))
            yield batch(_IDS, doc_id=b.column("doc_id"), n=counts + 1, ids=rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, ids binary")


def _pack(ids: np.ndarray, zip_: zstandard.ZstdCompressor) -> bytes:
    wide = int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + zip_.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def _unpack(data: bytes, unzip: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unzip.decompress(data[1:]), "<u4" if data[0] == 4 else "<u2").astype(np.uint32)


def count_ids(ids: DataFrame) -> DataFrame:
    """How often each id occurs, over all documents."""
    out = pa.schema([("symbol", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, total = zstandard.ZstdDecompressor(), np.zeros(1, np.int64)
        for b in batches:
            for data in b.column("ids"):
                seen = np.bincount(_unpack(data.as_py(), unzip))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[:len(seen)] += seen
        at = np.flatnonzero(total)
        yield batch(out, symbol=at, n=total[at])

    return ids.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


_BLOCKS = pa.schema([("part", pa.int32()), ("block_no", pa.int32()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("block", pa.binary())])


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Write the token ids of all documents to ``folder``, in ascending doc_id order."""
    spark = docs.sparkSession
    ids = stage(token_ids(docs, path, end_id))
    freq = count_ids(ids)
    freq.write.parquet(f"{folder}/table")  # at most one row per id of the vocabulary
    table = read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, part, no = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0
        own: list[np.ndarray] = []
        names: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            counts = np.fromiter(map(len, own), np.int64, len(own))
            block = encode_block(np.concatenate(own), np.array(names, np.int64), counts, table)
            return batch(_BLOCKS, part=[part], block_no=[no], first_doc=[names[0]], docs=[len(names)], ids=[int(counts.sum())], block=[block])

        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                own.append(_unpack(data.as_py(), unzip))
                names.append(-1 if doc is None else doc)
                held += len(own[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    no, own, names, held = no + 1, [], [], 0
        if own:
            yield flush()

    (ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", "ids")
        .mapInArrow(run, "part int, block_no int, first_doc long, docs long, ids long, block binary")
        .write.option("compression", "none").parquet(f"{folder}/blocks"))


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.parquet(f"{folder}/table").toPandas()
    return Table(rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where the ids of each block begin: (part, block_no, block_start)."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block_no", "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written file
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "block_no", (F.col("part_start") + F.col("inside")).alias("block_start"))


_DOCS = pa.schema([("part", pa.int32()), ("block_no", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""
    table = read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, no, data in zip(b.column("part").to_pylist(), b.column("block_no").to_pylist(), b.column("block")):
                docs, counts, ids = decode_block(data.as_py(), table)
                ends = np.cumsum(counts.astype(np.int64))
                raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - counts
                yield batch(
                    _DOCS, part=np.full(len(docs), part), block_no=np.full(len(docs), no), doc_id=docs, inside=starts,
                    n_tokens=counts.astype(np.int64), ids_crc32=[zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), ends.tolist())])

    rows = spark.read.parquet(f"{folder}/blocks").select("part", "block_no", "block").mapInArrow(
        run, "part int, block_no int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(read_index(spark, folder), ["part", "block_no"]).select(
        "doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents' ids and read them back.

    In: doc_id, text (more columns are ignored). Out: doc_id, start, n_tokens, ids_crc32, taken from
    the files. A null or empty text has the end id alone; rows with equal doc_id follow each other in
    any order; a null doc_id is written as -1, before all others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    write_ids(docs, folder, path or default_path(), end_id)
    return read_documents(spark, folder)
