"""JavaScript test logs: suites, failure blocks with their details, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D
from gistline.operators.scan import first_lines, once, scan
from gistline.sources.staging import stage

SHOWN_DETAILS = 20


def classify_lines(lines: DataFrame) -> DataFrame:
    """Line classes in testing order; blank lines carry nothing here and are dropped."""
    t = F.col("text")
    # A cheap test goes before each pattern: it holds wherever the pattern does.
    line_class = (
        F.when(t.startswith("Summary") & t.rlike(P.JEST_SUMMARY), "summary")
        .when(t.startswith("Test Suites:") & t.rlike(P.JEST_SUITES), "suites")
        .when(t.startswith("Tests:") & t.rlike(P.JEST_TESTS), "tests")
        .when(t.startswith("Time:") & t.rlike(P.JEST_TIME), "time")
        .when(t.startswith("PASS") & t.rlike(P.JEST_PASS), "pass")
        .when(t.startswith("FAIL") & t.rlike(P.JEST_FAIL), "fail")
        .when(t.contains("●") & t.rlike(P.JEST_MARKER), "marker")
        .when(~T.is_blank(t), "other")
    )
    text = lines.select("log_id", "line_no", T.strip_cr("line").alias("text"))
    return once(text, "line_class", line_class).filter("line_class IS NOT NULL")


def _suite() -> Column:
    c, t = F.col("fact"), F.col("text")
    return F.when(c == "pass", F.regexp_extract(t, P.JEST_PASS, 1)).otherwise(F.regexp_extract(t, P.JEST_FAIL, 1))


def jest_suites(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("fact IN ('pass', 'fail')").select(
        "log_id", "line_no", F.col("fact").alias("status"), _suite().alias("suite"))


def stateless_facts(lines: DataFrame) -> DataFrame:
    """Suites and totals: the facts that need no carried state, without a shuffle."""
    return classify_lines(lines).withColumnRenamed("line_class", "fact").filter(
        "fact IN ('suites', 'tests', 'time', 'pass', 'fail')")


def facts(lines: DataFrame, details: bool = False, span: int | None = None) -> DataFrame:
    """Suites, totals, and the titles and details of failures with their ``block``.

    A block is named by the line of its title, its suite by ``suite_line``. Without ``details``,
    lines of no class are dropped before the shuffle.
    """
    c = F.col("line_class")
    marked = classify_lines(lines)
    if not details:
        marked = marked.filter(c != "other")
    carried = scan(marked, span=span, late=True, before={
        "summary_seen": F.when(c == "summary", 1),
        "suite_line": F.when(c == "fail", F.col("line_no")).when(c == "pass", F.lit(0)),
        "open": F.when(c == "marker", F.col("line_no")).when(c.isin("pass", "fail", "summary"), F.lit(-1)),
    })
    failing = F.col("summary_seen").isNull() & (F.col("suite_line") > 0)
    fact = (
        F.when(c == "marker", F.when(failing, "title"))
        .when(c == "other", F.when(failing & (F.col("open") > 0), "detail"))
        .when(c != "summary", c))
    block = F.when(c == "marker", F.col("line_no")).otherwise(F.col("open"))
    return carried.select("log_id", "line_no", fact.alias("fact"), "suite_line", block.alias("block"), "text").filter(
        "fact IS NOT NULL")


def jest_failures(fact_rows: DataFrame) -> DataFrame:
    """Failure blocks with suite and title."""
    suites = fact_rows.filter("fact = 'fail'").select(
        "log_id", F.col("line_no").alias("suite_line"), _suite().alias("suite"))
    found = fact_rows.filter("fact = 'title'").select("log_id", "suite_line", "block", "text")
    return found.join(suites, ["log_id", "suite_line"]).select(
        "log_id", "block", "suite", T.trim(F.regexp_extract("text", P.JEST_MARKER, 1)).alias("title"))


def jest_failure_details(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """The detail lines of each block, all or the first k; ``seq`` counts within the block."""
    found = fact_rows.filter("fact = 'detail'").select("log_id", "block", "line_no", "text")
    return first_lines(found, k, ["log_id", "block"])


def totals_of(fact_rows: DataFrame) -> DataFrame:
    """The last totals lines of the logs that have any."""
    c, t = F.col("fact"), F.col("text")

    def last(name: str, pattern: str) -> Column:
        value = F.struct("line_no", T.trim(F.regexp_extract(t, pattern, 1)).alias("v"))
        return F.nullif(F.max(F.when(c == name, value))["v"], F.lit("")).alias(name)

    return fact_rows.filter(c.isin("suites", "tests", "time")).groupBy("log_id").agg(
        last("suites", P.JEST_SUITES), last("tests", P.JEST_TESTS), last("time", P.JEST_TIME))


def jest_totals(lines: DataFrame) -> DataFrame:
    """The last totals lines of every log; nulls where a log has none."""
    return D.log_sizes(lines).select("log_id").join(totals_of(stateless_facts(lines)), "log_id", "left")


def stats(fact_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    counts = fact_rows.groupBy("log_id").agg(
        F.count_if(F.col("fact") == "pass").alias("passed"), F.count_if(F.col("fact") == "title").alias("failures"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    out = sizes.join(totals_of(fact_rows), "log_id", "left").join(counts, "log_id", "left").select(
        "log_id", "original_tokens", "suites", "tests", "time", zero("passed"), zero("failures"))
    with_suites = F.concat(F.lit("Tests: "), "tests", F.coalesce(F.concat(F.lit(" | Suites: "), "suites"), F.lit("")))
    failures = F.concat(F.col("failures").cast("string"), F.lit(" test failure(s)"))
    return out.withColumn(
        "summary", F.when(F.col("tests").isNotNull(), with_suites).when(F.col("failures") > 0, failures)
        .otherwise("Tests OK")
    ).withColumn("outcome", F.when((F.col("failures") > 0) | F.col("tests").rlike(r"\d+ failed"), "failed")
                 .when(F.col("tests").isNull() & (F.col("passed") == 0), "unknown").otherwise("ok"))


def digest_rows(fact_rows: DataFrame, totals: DataFrame) -> DataFrame:
    row, n, p = D.row, F.col("failures"), F.col("passed")
    heads = D.rows_of(
        totals,
        F.when(F.col("suites").isNotNull(), row(0, 0, F.concat(F.lit("Test Suites: "), "suites"))),
        F.when(F.col("tests").isNotNull(), row(0, 1, F.concat(F.lit("Tests: "), "tests"))),
        F.when(F.col("time").isNotNull(), row(0, 2, F.concat(F.lit("Time: "), "time"))),
        F.when(n > 0, row(1, 0, "")),
        F.when(n > 0, row(1, 1, F.concat(F.lit("Failed tests ("), n.cast("string"), F.lit("):")))),
        F.when(p > 0, row(2, 0, "")),
        F.when(p > 0, row(2, 1, F.concat(
            F.lit("("), p.cast("string"), F.lit(" test suite(s) passed — names collapsed)")))),
    )
    at = F.col("block") * 4
    titles = D.rows_of(
        jest_failures(fact_rows), row(1, at, F.concat(F.lit("\n  ✗ "), "suite", F.lit("\n    ● "), "title")))
    at = F.col("line_no") * 4
    details = D.rows_of(
        jest_failure_details(fact_rows, SHOWN_DETAILS), row(1, at, F.concat(F.lit("    "), "text")),
        F.when(F.col("seq") == SHOWN_DETAILS, row(1, at + 1, "        … (truncated)")))
    return D.union([heads, titles, details])


def digest(lines: DataFrame) -> DataFrame:
    known = stage(facts(lines, details=True))
    totals = stats(known, D.log_sizes(lines))
    return D.finish("jest", totals, digest_rows(known, totals))
