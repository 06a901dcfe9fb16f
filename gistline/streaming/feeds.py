"""Live log feeds: the stateless line operators on a stream, and hourly warning counts.

Operators that carry state along a log need all its lines in order, which row windows on streams
do not give; run them per finished log with ``foreachBatch`` and the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gistline.functions import text as T
from gistline.operators import classify, gradle, junit, npm

WATERMARK = "7 days"


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of line files (log_id, line_no, line, and possibly ts)."""
    return spark.readStream.schema(schema).parquet(path)


def line_facts(lines: DataFrame) -> DataFrame:
    """Diagnostics, tasks and results of single lines, on a stream or a table. What stands in an
    open failure note is not told apart here; that needs the batch operator."""
    return gradle.classify_lines(lines).filter("line_class IN ('kotlin', 'javac', 'task', 'result')").withColumnRenamed(
        "line_class", "fact")


def stream_facts(lines: DataFrame) -> DataFrame:
    return gradle.kotlin_diagnostics(line_facts(lines))


def stream_warning_counts(lines: DataFrame, watermark: str = WATERMARK, width: str = "1 hour") -> DataFrame:
    """Warnings per message and hour of ``ts``; rows later than the watermark are dropped."""
    timed = lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    facts = gradle.classify_lines(timed, "ts").withColumnRenamed("line_class", "fact")
    warnings = gradle.diagnostics(facts, "ts").filter("severity = 'warning'")
    counts = warnings.groupBy(F.window("ts", width), "message").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "message", "n")


def drain(result: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a streaming result over what is there now into a Parquet sink and read the sink."""
    query = result.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(out)


def _keep(facts: DataFrame, out: str, batch_id: int) -> None:
    """Write a batch's rows in place of those an earlier run of the same batch may have left."""
    facts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def per_finished_log(batch_operator: Callable[[DataFrame], DataFrame], out: str):
    """A ``foreachBatch`` function for feeds whose micro-batches hold whole logs.

    Results are kept by batch id (partition column ``batch``), so a batch that runs again after a
    failure replaces its own rows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        _keep(batch_operator(batch), out, batch_id)

    return run


#: The stateless facts of lines, by the table that they go to.
LINE_FACTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kotlin_diagnostics": lambda lines: gradle.kotlin_diagnostics(line_facts(lines)),
    "javac_diagnostics": lambda lines: gradle.javac_diagnostics(line_facts(lines)),
    "npm_changes": lambda lines: npm.npm_changes(npm.stateless_facts(lines)),
    "junit_results": lambda lines: junit.junit_results(junit.stateless_facts(lines)),
    "clean_lines": lambda lines: lines.select("log_id", "line_no", T.strip_ansi("line").alias("line")),
}


def all_line_facts(out: str, facts: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """A ``foreachBatch`` function that writes all facts of a batch of lines, each to a table of its own below ``out``.

    Each table reads the batch from its source again, which gives the same rows for a batch id and costs less
    than a copy in memory. Each table keeps its rows by batch id; read them with :func:`fact_table`.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        for name, fact in (facts or LINE_FACTS).items():
            _keep(fact(batch), f"{out}/{name}", batch_id)

    return run


def fact_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}").drop("batch")


def drain_batches(feed: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand what is there now to a ``foreachBatch`` function."""
    feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_kinds(runs: DataFrame) -> DataFrame:
    """The kind of each captured run (log_id, command, head), on a stream or a table."""
    return runs.select("log_id", classify.classify().alias("kind"))
