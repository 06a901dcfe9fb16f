"""What several operators need: tables, slices of batches, gapless numbers, sizes of small tables."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gistline.sources.staging import new_folder, stage

__all__ = ["stage", "new_folder", "table", "slices", "number_rows", "number_in_order", "small", "free", "batch", "TEXT_BYTES", "BROADCAST_BYTES"]

TEXT_BYTES = 1 << 20  #: Text that one step of a Python task handles at once; a longer text comes alone.
BROADCAST_BYTES = 32 << 20  #: Tables up to this size may be copied to every executor.


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as Spark does with --py-files."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import gistline

    root = next(iter(gistline.__path__))
    name = os.path.join(tempfile.mkdtemp(prefix="gistline-code-"), "gistline.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("gistline", os.path.relpath(os.path.join(folder, f), root)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def give_back() -> None:
    """Inside a task: hand memory that earlier tasks left in this worker back to the system.

    Spark keeps Python workers for later stages; what they remember of the last one counts there too.
    """
    tokens = sys.modules.get("gistline.llm.tokens")
    if tokens:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have about ``limit`` bytes; every row comes in one part."""
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column(b.schema.get_field_index(column)).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = max(at + 1, min(to, b.num_rows))
            yield b.slice(at, to - at)
            at = to


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with these columns, in the order and of the types of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def number_rows(df: DataFrame, by: list[str], key: list[str], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column ``name``.

    A group may hold most of the rows, so it is dealt into ``buckets`` by a hash of ``key``: rows are
    counted per bucket, the counts are summed up over the few buckets, and each bucket numbers its
    own rows. ``key`` must determine the bucket alike in both readings of ``df``.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"),
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        if by else None)
    own = Window.partitionBy(*by, "_bucket").orderBy(*key)
    numbered = dealt.withColumn("_row", F.row_number().over(own) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_bucket") == F.col("_at")]
    on: Column = same[0]
    for cond in same[1:]:
        on = on & cond
    return (
        numbered.join(offsets, on)
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_bucket", "_row", "_offset", "_at", *[f"_by_{c}" for c in by]))


def number_in_order(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` as a table whose rows are numbered from 0 in the given order, as column ``name``.

    Rows are dealt by ranges of ``order`` and sorted there, so no group is in one task unless its
    rows are equal in every column of the order; those come in any order. One count for each task
    is summed up on the driver.
    """
    part, at = free(df, "_part"), free(df, "_at")
    dealt = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, total = [], 0
    for p, n in sorted(map(tuple, dealt.groupBy(part).agg(F.count(F.lit(1))).collect())):
        before.append((p, total))
        total += n
    offset = free(df, "_offset")
    offsets = df.sparkSession.createDataFrame(before, f"{part} int, {offset} long")
    return (
        dealt.join(F.broadcast(offsets), part)
        .withColumn(name, F.col(at) + F.col(offset)).drop(part, at, offset))


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcast only if its rows, of ``row_bytes`` each, fit; else it joins by shuffle."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= limit else df
