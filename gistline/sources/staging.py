"""Intermediate tables.

A digest reads its facts in several branches. Writing them once, to the shared folder the
cluster names, costs little (facts are a small part of a log), keeps the plans short, gives the
planner true sizes, and survives the loss of executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def staging_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; all executors must share it.

    Where it is unset, a session with a single process gets a temporary folder of its own (tests,
    notebooks); any other session must name one. The session's settings are not changed.
    """
    folder = spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_FOLDER} to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gistline-"))


def new_folder(spark: SparkSession) -> str:
    path = f"{staging_folder(spark)}/staged/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a table, partitioned by the columns ``by``, and read back."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the intermediate tables written inside the block, when it ends.

    DataFrames that read such tables are of no use after it. The block gets a function that writes a
    table which stays.
    """
    known = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    first, stay = len(known), []

    def keep(df: DataFrame) -> DataFrame:
        at = len(known)
        out = stage(df)
        stay.append(known[at])
        return out

    try:
        yield keep
    finally:
        for path in known[first:]:
            if path not in stay:
                _delete(spark, path)
        known[first:] = stay


def drop_staged(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables; call it when the results are written."""
    return _delete(spark, f"{staging_folder(spark)}/staged/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
