"""Reading logs: whole texts, numbered lines, and lines of files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Lines of one folder of a line store.
LINES_PER_BLOCK = 1 << 16


def explode_lines(df: DataFrame, text: str = "text", id_col: str = "log_id", *keep: str) -> DataFrame:
    """Numbered lines of a text column; a trailing newline yields a last empty line."""
    lines = F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")
    return df.select(F.col(id_col).alias("log_id"), *keep, lines).select(
        "log_id", *keep, (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``log_id`` (the path) and ``text``. For logs that fit a cell.

    Spark's file sources skip files without a byte; keep empty logs as rows of a table.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of text files of any size, read by splits.

    A file larger than a split is read by several tasks. Lines are numbered inside their split
    and shifted by the line counts of the file's earlier splits, so neither the numbering nor
    the text of a file is ever in one task. Same rows as ``read_logs`` + ``explode_lines``.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("mid"),
        F.col("value").alias("line"),
    )
    # A file that ends in a newline has one more, empty, line that the reader does not return.
    blocks = lines.groupBy("log_id", "block", "size").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    by_block = Window.partitionBy("log_id").orderBy("block")
    whole = Window.partitionBy("log_id")
    blocks = blocks.select(
        "log_id", "block",
        F.coalesce(F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        (F.sum("n").over(whole)).alias("lines"),
        (F.sum("bytes").over(whole) == F.col("size")).alias("ends_open"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"))
    in_block = Window.partitionBy("log_id", "block").orderBy("mid")
    numbered = lines.select("log_id", "block", "line", F.row_number().over(in_block).alias("rn")).join(
        blocks, ["log_id", "block"]).select("log_id", (F.col("rn") + F.col("shift")).alias("line_no"), "line")
    tail = blocks.filter(F.col("is_last") & F.col("ends_open")).select(
        "log_id", (F.col("lines") + 1).alias("line_no"), F.lit("").alias("line"))
    return numbered.unionByName(tail)


def write_line_store(lines: DataFrame, path: str, lines_per_block: int = LINES_PER_BLOCK) -> None:
    """Keep numbered lines (log_id, line_no, line) in folders of line ranges.

    A range of lines then reads the folders that hold it, whatever the size of the files. Rows are
    dealt by file and block, so a file with most of the lines is written by many tasks.
    """
    block = F.expr(f"(line_no - 1) div {lines_per_block}")
    lines.select("log_id", "line_no", "line", block.cast("long").alias("block")).repartition("log_id", "block").write.partitionBy("block").parquet(f"{path}/lines")
    lines.groupBy("log_id").agg(F.max("line_no").alias("n")).withColumn("lines_per_block", F.lit(lines_per_block)).write.parquet(f"{path}/files")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, n): the files of a line store and their number of lines."""
    return spark.read.parquet(f"{path}/files").drop("lines_per_block")


def stored_lines(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Lines lo..hi of every file of a line store, from the folders that hold them."""
    size = spark.read.parquet(f"{path}/files").select("lines_per_block").first()
    per = size[0] if size else LINES_PER_BLOCK
    found = spark.read.schema("log_id string, line_no long, line string, block long").parquet(f"{path}/lines") if size is None else spark.read.parquet(f"{path}/lines")
    inside = F.col("block").between((max(lo, 1) - 1) // per, (max(hi, 1) - 1) // per)
    return found.filter(inside & F.col("line_no").between(lo, hi)).drop("block")
