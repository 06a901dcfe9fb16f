"""Log and source stores as partitioned Parquet tables; ids, lookups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistline.functions import text as T
from gistline.sources.staging import stage

TTL = "7 days"
ID_DIGITS = 12


def log_id(name: Column | str, *run: Column | str) -> Column:
    """Readable prefix and a hash of what identifies the run. Deterministic, so retries agree."""
    prefix = F.left(F.regexp_replace(T.as_col(name), "[^A-Za-z0-9]", ""), F.lit(8))
    seed = F.concat_ws("\n", *[T.as_col(c).cast("string") for c in run])
    return F.concat(F.when(prefix == "", "log").otherwise(prefix), F.lit("_"), F.left(F.sha2(seed, 256), F.lit(ID_DIGITS)))


#: Folders that the ids of one kind and day are dealt into, so that a lookup reads one of them.
ID_BUCKETS = 16


def _id_bucket(log_id: Column | str) -> Column:
    return F.pmod(F.crc32(T.as_col(log_id).cast("string").cast("binary")), F.lit(ID_BUCKETS)).cast("int")


def write_log_store(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write logs (log_id, kind, ended_at, text, ...) partitioned by kind, day and a hash of the id.

    Rows are dealt by these columns first, so that a folder gets its files from few tasks; a second
    hash of the id splits a kind and day that hold most of the logs.
    """
    placed = logs.withColumns({"day": F.to_date("ended_at"), "id_bucket": _id_bucket("log_id")})
    placed.repartition("kind", "day", "id_bucket", F.pmod(F.xxhash64("log_id"), F.lit(4))).write.mode(mode).partitionBy(
        "kind", "day", "id_bucket").parquet(path)


def read_log_store(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The stored logs, or only those whose log_id is in ``wanted``.

    The join is on the id's folder, too, so that few wanted ids prune the folders that are read.
    """
    logs = spark.read.parquet(path)
    if wanted is None:
        return logs.drop("id_bucket")
    ids = wanted.select("log_id").distinct().withColumn("id_bucket", _id_bucket("log_id"))
    return logs.join(ids, ["id_bucket", "log_id"], "left_semi").drop("id_bucket")


def read_stored_log(spark: SparkSession, path: str, log_id: str) -> DataFrame:
    """One log by its id; only the folders that can hold it are read."""
    logs = spark.read.parquet(path)
    return logs.filter((F.col("id_bucket") == _id_bucket(F.lit(log_id))) & (F.col("log_id") == log_id)).drop("id_bucket")


def missing_logs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that are not stored, as error rows."""
    known = stored.select("log_id").distinct()
    missing = wanted.select("log_id").distinct().join(known, "log_id", "left_anti")
    return missing.select("log_id", F.concat(
        F.lit('[error] log_id "'), F.col("log_id").cast("string"), F.lit('" not found')).alias("error"))


def expired(entries: DataFrame, now: Column) -> DataFrame:
    """Entries older than the retention time."""
    return entries.filter(F.col("ended_at") < now - F.expr(f"INTERVAL {TTL}"))


def kept(entries: DataFrame, now: Column) -> DataFrame:
    """Entries within the retention time, to be written back."""
    return entries.filter(F.col("ended_at") >= now - F.expr(f"INTERVAL {TTL}"))


def count_expired(entries: DataFrame, now: Column) -> DataFrame:
    return expired(entries, now).agg(F.count("*").alias("removed"))


def prune_log_store(spark: SparkSession, path: str, now: Column) -> int:
    """Remove expired logs from a store; returns how many days were removed whole.

    Days that ended before the border are dropped as folders. Of the border day the logs that stay are
    written first, and only then the files that were there before are removed, one by one; a run that
    fails in between loses no log but leaves some twice, which the next run puts right.
    """
    border = spark.range(1).select((now - F.expr(f"INTERVAL {TTL}")).cast("timestamp").alias("t")).select(F.to_date("t").alias("day")).first()["day"]
    days = spark.read.parquet(path).select("kind", "day").distinct().collect()  # one row per folder
    gone = [f"{path}/kind={r['kind']}/day={r['day']}" for r in days if r["day"] is not None and r["day"] < border]
    _remove(spark, gone)
    at_border = [r["kind"] for r in days if r["day"] == border]
    if at_border:
        spark.catalog.refreshByPath(path)
        before = [f for kind in at_border for f in _files(spark, f"{path}/kind={kind}/day={border}")]
        stay = kept(spark.read.parquet(path).filter(F.col("day") == F.lit(border)), now)
        stage(stay.dropDuplicates(["kind", "log_id", "ended_at"])).write.mode("append").partitionBy("kind", "day", "id_bucket").parquet(path)
        _remove(spark, before)
    spark.catalog.refreshByPath(path)
    return len(gone)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The files below a folder of any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


SYMBOL = ("name string, qualified_name string, parent_qualified_name string, kind string, line_lo bigint, line_hi bigint, "
          "modifiers array<string>, doc string")
_SYMBOLS_PER_PART = 10_000


def symbols_to_json(symbols: DataFrame) -> DataFrame:
    """(file_id, part_no, symbols): the symbols of each file as JSON arrays of about 10,000 symbols.

    Columns that ``symbols`` lacks are left out; nulls are, too, as in any JSON of Spark's.
    """
    names = [f.split(" ")[0] for f in SYMBOL.split(", ")]
    present = [n for n in names if n in symbols.columns]
    sizes = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("qualified_name", "line_lo"), F.ceil(F.col("n") / _SYMBOLS_PER_PART))
    dealt = symbols.join(sizes, "file_id").withColumn("part_no", part.cast("int"))
    return dealt.groupBy("file_id", "part_no").agg(F.to_json(F.collect_list(F.struct(*present))).alias("symbols"))


def symbols_from_json(stored: DataFrame) -> DataFrame:
    """The rows of :func:`symbols_to_json` as symbols again."""
    return stored.select("file_id", F.inline(F.from_json("symbols", f"array<struct<{SYMBOL}>>")))


def write_symbol_store(symbols: DataFrame, path: str, mode: str = "append") -> None:
    """Keep symbols by file id, as JSON; :func:`~gistline.sources.code.select_changed` reads the ids."""
    symbols_to_json(symbols).withColumn("id_bucket", _id_bucket("file_id")).repartition("id_bucket").write.mode(mode).partitionBy("id_bucket").parquet(path)


def read_symbol_store(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    """The stored symbols, of all files or of one; for one only its folder is read."""
    stored = spark.read.parquet(path)
    if file_id is not None:
        stored = stored.filter((F.col("id_bucket") == _id_bucket(F.lit(file_id))) & (F.col("file_id") == file_id))
    return symbols_from_json(stored)
