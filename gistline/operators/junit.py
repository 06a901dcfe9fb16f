"""JVM test logs: results, failure messages, application stack frames, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D, gradle
from gistline.operators.scan import first_k, first_lines, once, scan
from gistline.sources.staging import stage

SHOWN_MESSAGES = 4
SHOWN_FRAMES = 5
FRAMEWORK_FRAME = r"^\s*at\s+(?:" + "|".join(T.regex_escape(p) for p in P.JUNIT_FRAMEWORK) + ")"


def classify_lines(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    # The cheap test first: the pattern may try every dot of a long line without blanks.
    named = t.contains("PASSED") | t.contains("FAILED") | t.contains("SKIPPED")
    line_class = (
        F.when(named & t.rlike(P.JUNIT_RESULT), "result").when(t.between("0", ":") & t.rlike(P.JUNIT_TOTALS), "totals")
        .when(T.is_blank(t), "blank").otherwise("other"))
    return once(lines.select("log_id", "line_no", T.strip_cr("line").alias("text")), "line_class", line_class)


def stateless_facts(lines: DataFrame) -> DataFrame:
    """Result and totals lines, without a shuffle."""
    return classify_lines(lines).withColumnRenamed("line_class", "fact").filter("fact IN ('result', 'totals')")


def facts(lines: DataFrame, span: int | None = None, numbered: bool = False, short: bool = False) -> DataFrame:
    """Result and totals lines, and the lines of failure blocks as message or frame.

    A block is named by its result line and ends at the next result, totals or blank line.
    Frames of the test framework and the runtime are dropped. With ``numbered``, ``messages`` and
    ``frames`` count the log's lines of that part so far, from which those of a block get their number.
    With ``short``, results that are no failures keep their status alone as text.
    """
    c, t = F.col("line_class"), F.col("text")
    failed = (c == "result") & t.contains("FAILED") & t.rlike(r"FAILED\s*\z")
    # What a line is inside a block is told once, before the shuffle; lines that are nothing stay out of it.
    part = F.when(t.contains("at ") & t.rlike(r"^\s*at "), F.when(~t.rlike(FRAMEWORK_FRAME), "frame")).otherwise("message")
    named = once(classify_lines(lines), "part", F.when(c == "other", part).when(failed, "failure").otherwise(c)).filter("part IS NOT NULL")
    kept = F.when(F.col("part") == "result", _status(t)).otherwise(t) if short else t
    named = named.select("log_id", "line_no", F.when(F.col("part") != "blank", kept).alias("text"), "part")
    part, numbers = F.col("part"), {f"{p}s": (F.col("part") == p).cast("int") for p in ("message", "frame")}
    state = F.when(part == "failure", F.col("line_no")).when(~part.isin("message", "frame"), F.lit(-1))
    carried = scan(named, before={"block": state}, running=numbers if numbered else None, span=span, late=True)
    fact = F.when(part == "failure", "result").when(part.isin("result", "totals"), part).when(part.isin("message", "frame") & (F.col("block") > 0), part)
    return carried.select("log_id", "line_no", "block", "text", fact.alias("fact"), *(numbers if numbered else [])).filter("fact IS NOT NULL")


def junit_results(fact_rows: DataFrame, *keep: str) -> DataFrame:
    t = F.col("text")
    return fact_rows.filter("fact = 'result'").select(
        "log_id", "line_no", F.regexp_extract(t, P.JUNIT_RESULT, 1).alias("fqcn"),
        F.regexp_extract(t, P.JUNIT_RESULT, 2).alias("test"), F.regexp_extract(t, P.JUNIT_RESULT, 3).alias("status"), *keep)


def _status(text: Column) -> Column:
    """The status that a result line ends with."""
    return F.regexp_extract(text, r"(PASSED|FAILED|SKIPPED)\s*\z", 1)


def junit_counts(fact_rows: DataFrame) -> DataFrame:
    status = F.col("status")
    return fact_rows.filter("fact = 'result'").select("log_id", _status(F.col("text")).alias("status")).groupBy("log_id").agg(
        F.count_if(status == "PASSED").alias("passed"), F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status == "SKIPPED").alias("skipped"))


def junit_totals(fact_rows: DataFrame) -> DataFrame:
    """The last totals line, whole."""
    return fact_rows.filter("fact = 'totals'").groupBy("log_id").agg(
        F.max_by(T.trim("text"), "line_no").alias("totals"))


def failure_lines(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("fact IN ('message', 'frame')").select(
        "log_id", "block", "line_no", F.col("fact").alias("part"), T.trim("text").alias("text"))


def failures(fact_rows: DataFrame, *keep: str) -> DataFrame:
    return junit_results(fact_rows, *keep).filter("status = 'FAILED'").select(
        "log_id", F.col("line_no").alias("block"), "fqcn", "test", *keep)


def _shown(fact_rows: DataFrame) -> DataFrame:
    """First messages and frames of each block, with how many frames the block has where that is more than are shown."""
    found = failure_lines(fact_rows)
    counts = found.filter("part = 'frame'").groupBy("log_id", "block", "part").agg(F.count("*").alias("n")).filter(F.col("n") > SHOWN_FRAMES)
    first = first_k(found, max(SHOWN_FRAMES, SHOWN_MESSAGES), ["log_id", "block", "part"], ["line_no"])
    first = first.filter((F.col("part") == "frame") | (F.col("seq") <= SHOWN_MESSAGES))
    return first.join(counts, ["log_id", "block", "part"], "left")


def junit_failures(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Failures with their message lines, all or the first k; a failure without any has one row with nulls."""
    if k is None and "messages" in fact_rows.columns:
        start = fact_rows.filter("fact = 'result'").withColumn("start", F.col("messages"))
        found = fact_rows.filter("fact = 'message'").select("log_id", "block", "messages", T.trim("text").alias("text"))
        both = failures(start, "start").join(found, ["log_id", "block"], "left")
        return both.select("log_id", "block", "fqcn", "test", (F.col("messages") - F.col("start")).alias("seq"), "text")
    messages = first_lines(failure_lines(fact_rows).filter("part = 'message'"), k, ["log_id", "block"])
    return failures(fact_rows).join(messages.select("log_id", "block", "seq", "text"), ["log_id", "block"], "left")


def junit_app_frames(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """The application frames of each failure, all or the first k, and how many are left out."""
    if k is None and "frames" in fact_rows.columns:
        start = fact_rows.filter((F.col("fact") == "result") & F.col("text").rlike(r"FAILED\s*\z")).select(
            "log_id", F.col("line_no").alias("block"), F.col("frames").alias("start"))
        found = fact_rows.filter("fact = 'frame'").select("log_id", "block", "frames", T.trim("text").alias("text"))
        return found.join(start, ["log_id", "block"]).select(
            "log_id", "block", (F.col("frames") - F.col("start")).alias("seq"), "text", F.lit(0).cast("bigint").alias("omitted"))
    frames = failure_lines(fact_rows).filter("part = 'frame'")
    counts = frames.groupBy("log_id", "block").agg(F.count("*").alias("n"))
    omitted = F.lit(0) if k is None else F.greatest(F.col("n") - k, F.lit(0))
    return first_lines(frames, k, ["log_id", "block"]).join(counts, ["log_id", "block"]).select(
        "log_id", "block", "seq", "text", omitted.cast("bigint").alias("omitted"))


def named_failures(totals: str):
    """How many failed tests a totals line names; 0 where it names none."""
    return F.coalesce(F.regexp_extract(totals, r"(\d+) failed", 1).try_cast("bigint"), F.lit(0))


def stats(fact_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    s = lambda n: F.col(n).cast("string")
    out = sizes.join(junit_counts(fact_rows), "log_id", "left").join(junit_totals(fact_rows), "log_id", "left").select(
        "log_id", "original_tokens", "totals", zero("passed"), zero("failed"), zero("skipped"))
    skipped = F.when(F.col("skipped") > 0, F.concat(F.lit(", "), s("skipped"), F.lit(" skipped"))).otherwise("")
    return out.withColumn(
        "summary",
        F.when(F.col("totals").isNotNull(), F.concat(F.lit("junit: "), "totals"))
        .when(F.col("failed") > 0, F.concat(F.lit("junit: "), s("failed"), F.lit(" failed, "), s("passed"), F.lit(" passed")))
        .when(F.col("passed") > 0, F.concat(F.lit("junit: "), s("passed"), F.lit(" passed"), skipped))
        .otherwise("junit: (no tests detected)")
    ).withColumn("outcome", F.when(F.greatest(F.col("failed"), named_failures("totals")) > 0, "failed").when(
        F.col("totals").isNull() & (F.col("passed") + F.col("skipped") == 0), "unknown").otherwise("ok"))


def _with_facts(totals: DataFrame) -> DataFrame:
    return totals.filter("totals IS NOT NULL OR passed + failed + skipped > 0")


def digest_rows(fact_rows: DataFrame, totals: DataFrame) -> DataFrame:
    row, n = D.row, F.col("failed")
    some = (F.col("passed") > 0) | (F.col("skipped") > 0)
    skipped = F.when(F.col("skipped") > 0, F.concat(F.lit(", "), F.col("skipped").cast("string"), F.lit(" skipped"))).otherwise("")
    heads = D.rows_of(
        totals,
        F.when(F.col("totals").isNotNull(), row(0, 0, F.col("totals"))),
        F.when(n > 0, row(1, 0, "")),
        F.when(n > 0, row(1, 1, F.concat(F.lit("Failed tests ("), n.cast("string"), F.lit("):")))),
        F.when(some, row(2, 0, "")),
        F.when(some, row(2, 1, F.concat(
            F.lit("("), F.col("passed").cast("string"), F.lit(" passed"), skipped, F.lit(" — names collapsed)")))))
    # Messages come before frames whatever their order in the log; 16 places per block.
    at, seq = F.col("block") * 16, F.col("seq")
    titles = D.rows_of(failures(fact_rows), row(1, at, F.concat(F.lit("\n  ✗ "), "fqcn", F.lit(" > "), "test")))
    indented = F.concat(F.lit("    "), "text")
    frame = F.col("part") == "frame"
    parts = D.rows_of(
        _shown(fact_rows),
        F.when(~frame, row(1, at + 1 + seq, indented)),
        F.when(frame, row(1, at + 5 + seq, indented)),
        F.when(frame & (seq == SHOWN_FRAMES) & (F.col("n") > SHOWN_FRAMES), row(1, at + 11, F.concat(
            F.lit("    … "), (F.col("n") - SHOWN_FRAMES).cast("string"), F.lit(" more app frames omitted")))))
    return D.union([heads, titles, parts])


def junit_fallback(lines: DataFrame, fact_rows: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame | None:
    """Logs without any test fact, as build digests; None if every log has some.

    Their ids are written first: usually few, so the lines are picked by a broadcast join.
    """
    known = stateless_facts(lines) if fact_rows is None else fact_rows
    tested = known.filter("fact IN ('result', 'totals')").select("log_id").distinct()
    sizes = D.log_sizes(lines) if sizes is None else sizes
    untested = stage(sizes.join(tested, "log_id", "left_anti"))
    if untested.isEmpty():
        return None
    return gradle.digest(lines.join(untested.select("log_id"), "log_id", "left_semi"), untested)


def digest(lines: DataFrame) -> DataFrame:
    known, sizes = stage(facts(lines, short=True)), stage(D.log_sizes(lines))
    totals = _with_facts(stats(known, sizes))
    tested, builds = D.finish("junit", totals, digest_rows(known, totals)), junit_fallback(lines, known, sizes)
    return tested if builds is None else tested.unionByName(builds)
