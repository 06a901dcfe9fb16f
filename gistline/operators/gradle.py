"""Build logs: compiler diagnostics, failed tasks, the failure note, the result.

Line classes follow the order in which a line is tested; which lines count also depends on
whether an open "What went wrong" block holds them, which is the carried state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D
from gistline.operators.scan import first_k, first_lines, once, scan
from gistline.sources.staging import stage

TOP_WARNINGS = 10
WRONG_LINES = 6


def classify_lines(lines: DataFrame, *keep: str) -> DataFrame:
    t = F.col("text")
    star = t.startswith("*")
    # A cheap test goes before each pattern: it holds wherever the pattern does.
    line_class = (
        F.when(t.startswith("BUILD ") & t.rlike(P.BUILD_RESULT), "result")
        .when(t.startswith("FAILURE:") & t.rlike(P.FAILURE_HEADER), "failure")
        .when(star & t.rlike(P.WRONG_HEADER), "wrong")
        .when(star & t.rlike(P.TRY_HEADER), "try")
        .when(t.startswith(">") & t.contains("FAILED") & t.rlike(P.TASK), "task")
        .when((t.startswith("e:") | t.startswith("w:")) & t.rlike(P.KOTLIN), "kotlin")
        .when(t.contains(".java:") & t.rlike(P.JAVAC), "javac")
        .otherwise("other")
    )
    return once(lines.select("log_id", "line_no", *keep, T.rtrim("line").alias("text")), "line_class", line_class)


def facts(lines: DataFrame, details: bool = False, span: int | None = None) -> DataFrame:
    """Lines that say something, with ``fact`` in result, task, kotlin, javac, detail.

    Without ``details`` the lines that match no pattern are dropped before the shuffle: they
    matter only as the text of a failure note.
    """
    c = F.col("line_class")
    wanted = F.col("text") != "" if details else c != "other"
    state = F.when(c == "wrong", 1).when(c.isin("result", "failure", "try"), 0)
    carried = scan(classify_lines(lines).filter(wanted), before={"inside": state}, span=span, late=True)
    header = c.isin("result", "failure", "wrong", "try")
    fact = F.when(header, c).when(F.col("inside") == 1, "detail").otherwise(c)
    return carried.withColumn("fact", fact).filter(
        F.col("fact").isin("result", "task", "kotlin", "javac", "detail")
    ).select("log_id", "line_no", "fact", "text")


def diagnostics(fact_rows: DataFrame, *keep: str) -> DataFrame:
    """severity, file, line, col (null if unknown), message."""
    t, kotlin = F.col("text"), F.col("fact") == "kotlin"

    def part(k: int, j: int):
        return F.when(kotlin, F.regexp_extract(t, P.KOTLIN, k)).otherwise(F.regexp_extract(t, P.JAVAC, j))

    return fact_rows.filter(F.col("fact").isin("kotlin", "javac")).select(
        "log_id", "line_no", *keep, F.col("fact").alias("compiler"),
        F.when(part(1, 3).isin("e", "error"), "error").otherwise("warning").alias("severity"),
        T.basename(part(2, 1)).alias("file"),
        part(3, 2).try_cast("bigint").alias("line"),
        F.when(kotlin, T.captured(t, P.KOTLIN, 4)).try_cast("bigint").alias("col"),
        T.trim(part(5, 4)).alias("message"),
    )


def kotlin_diagnostics(fact_rows: DataFrame) -> DataFrame:
    return diagnostics(fact_rows.filter("fact = 'kotlin'")).drop("compiler")


def javac_diagnostics(fact_rows: DataFrame) -> DataFrame:
    return diagnostics(fact_rows.filter("fact = 'javac'")).drop("compiler", "col")


def _last_result(fact_rows: DataFrame) -> DataFrame:
    t = F.col("text")
    last = F.max(F.struct("line_no", F.regexp_extract(t, P.BUILD_RESULT, 1).alias("status"),
                          T.captured(t, P.BUILD_RESULT, 2).alias("duration")))
    return fact_rows.filter("fact = 'result'").groupBy("log_id").agg(last.alias("r")).select("log_id", "r.status", "r.duration")


def build_result(lines: DataFrame) -> DataFrame:
    """Status and duration of the last result line of every log. Needs no state, so no scan."""
    found = _last_result(classify_lines(lines).withColumnRenamed("line_class", "fact"))
    return D.log_sizes(lines).select("log_id").join(found, "log_id", "left").select(
        "log_id", F.coalesce("status", F.lit("UNKNOWN")).alias("status"), "duration")


def failed_tasks(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("fact = 'task'").select(
        "log_id", "line_no", F.regexp_extract("text", P.TASK, 1).alias("task"))


def what_went_wrong(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """The lines, or the first k, of the failure note; only for builds that failed."""
    found = fact_rows.filter("fact = 'detail'").select("log_id", "line_no", T.trim("text").alias("text"))
    found = first_lines(found, k)
    failed = _last_result(fact_rows).filter("status = 'FAILED'").select("log_id")
    return found.join(failed, "log_id", "left_semi")


def warning_groups(fact_rows: DataFrame) -> DataFrame:
    """Warnings by message: count, first place, rank by count and first appearance."""
    warnings = diagnostics(fact_rows).filter("severity = 'warning'")
    return warnings.groupBy("log_id", "message").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"),
        F.min_by("file", "line_no").alias("file"))


def warnings_topk(fact_rows: DataFrame, k: int = TOP_WARNINGS) -> DataFrame:
    return first_k(warning_groups(fact_rows), k, ["log_id"], [F.col("n").desc(), "first_line"], "rank")


def stats(fact_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per log: result, counts, summary line."""
    t, fact = F.col("text"), F.col("fact")
    severity = F.when(fact == "kotlin", F.regexp_extract(t, P.KOTLIN, 1)).when(
        fact == "javac", F.left(F.regexp_extract(t, P.JAVAC, 3), F.lit(1)))
    found = fact_rows.select("log_id", "line_no", "fact", "text", severity.alias("severity")).groupBy("log_id").agg(
        F.max(F.when(fact == "result", F.struct(
            "line_no", F.regexp_extract(t, P.BUILD_RESULT, 1).alias("status"),
            T.captured(t, P.BUILD_RESULT, 2).alias("duration")))).alias("r"),
        F.min(F.when(fact == "task", F.struct("line_no", F.regexp_extract(t, P.TASK, 1).alias("task")))).alias("t"),
        F.count_if(F.col("severity") == "e").alias("errors"),
        F.count_if(F.col("severity") == "w").alias("warnings"),
        F.count_if(fact == "task").alias("tasks"),
    )
    unique = warning_groups(fact_rows).groupBy("log_id").agg(
        F.count("*").alias("unique_warnings"), F.min(F.struct((-F.col("n")).alias("order"), "first_line", "message", "n")).alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    head = F.when(F.col("status") == "UNKNOWN", "BUILD (status unknown)").otherwise(F.concat(F.lit("BUILD "), "status"))
    return (
        sizes.join(found, "log_id", "left").join(unique, "log_id", "left")
        .select("log_id", "original_tokens", F.coalesce("r.status", F.lit("UNKNOWN")).alias("status"),
                F.col("r.duration").alias("duration"), F.col("t.task").alias("first_task"),
                F.col("t.line_no").alias("first_task_line"),
                F.col("w.message").alias("top_warning"), F.col("w.n").alias("top_count"),
                zero("errors"), zero("warnings"), zero("tasks"), zero("unique_warnings"))
        .withColumn("summary", F.concat(head, F.lit(" ("), T.counted("errors", "error"), F.lit(", "),
                                        T.counted("unique_warnings", "warning"), F.lit(")")))
        .withColumn("outcome", F.when(F.col("status") == "SUCCESSFUL", "ok").when(F.col("status") == "FAILED", "failed")
                    .otherwise("unknown"))
    )


def gradle_summary(lines: DataFrame) -> DataFrame:
    """Per build: result, errors, warnings and the most frequent warning."""
    return stats(facts(lines), D.log_sizes(lines)).select(
        "log_id", "status", "duration", "errors", "unique_warnings", "warnings", "summary", "top_warning", "top_count")


def digest_rows(fact_rows: DataFrame, totals: DataFrame) -> DataFrame:
    n, u, w = F.col("tasks"), F.col("unique_warnings"), F.col("warnings")
    s = lambda c: c.cast("string")
    row = D.row
    capped = F.when(u > TOP_WARNINGS, f", showing top {TOP_WARNINGS}").otherwise("")
    warn_head = F.when(u == w, F.concat(F.lit("Warnings ("), s(u), F.lit(" unique):"))).otherwise(
        F.concat(F.lit("Warnings ("), s(u), F.lit(" unique, collapsed from "), s(w), F.lit(" occurrences"), capped, F.lit("):")))
    heads = D.rows_of(
        totals,
        F.when(F.col("duration").isNotNull(), row(0, 0, F.concat(F.lit("Duration: "), "duration"))),
        F.when(F.col("errors") > 0, row(1, 0, "")),
        F.when(F.col("errors") > 0, row(1, 1, "Errors:")),
        F.when(u > 0, row(2, 0, "")),
        F.when(u > 0, row(2, 1, warn_head)),
        F.when(u > TOP_WARNINGS, row(2, 2 + TOP_WARNINGS, F.concat(
            F.lit("  … "), s(u - TOP_WARNINGS), F.lit(" more unique warnings omitted")))),
        F.when(n > 0, row(4, 0, "")),
        F.when(n > 0, row(4, 1, F.concat(F.lit("Failed task"), F.when(n > 1, "s").otherwise(""), F.lit(": "), "first_task"))),
    )
    loc = F.concat_ws(":", "file", s(F.col("line")), s(F.col("col")))
    errors = D.rows_of(
        diagnostics(fact_rows).filter("severity = 'error'"),
        row(1, F.col("line_no") + 1, F.concat(F.lit("  "), loc, F.lit(" — "), "message")))
    warnings = D.rows_of(
        warnings_topk(fact_rows),
        row(2, F.col("rank") + 1, F.concat(F.lit("  "), T.count_prefix("n"), "message")))
    note = what_went_wrong(fact_rows, WRONG_LINES)
    wrong = D.rows_of(
        note,
        F.when(F.col("seq") == 1, row(3, 0, "")),
        F.when(F.col("seq") == 1, row(3, 1, "What went wrong:")),
        row(3, F.col("seq") + 1, F.concat(F.lit("  "), "text")))
    later = fact_rows.filter("fact = 'task'").join(totals.select("log_id", "first_task_line"), "log_id").filter(
        F.col("line_no") > F.col("first_task_line"))
    tasks = D.rows_of(later, row(4, F.col("line_no") + 1, F.regexp_extract("text", P.TASK, 1)), glue=", ")
    return D.union([heads, errors, warnings, wrong, tasks])


def digest(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    known = stage(facts(lines, details=True))
    totals = stats(known, D.log_sizes(lines) if sizes is None else sizes)
    return D.finish("gradle", totals, digest_rows(known, totals))
