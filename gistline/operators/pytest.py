"""Python test logs: sections, trimmed blocks, short summary, result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D
from gistline.operators.scan import first_lines, once, scan
from gistline.sources.staging import stage

CAPS = {"errors": 60, "failures": 120}
SHOWN_SUMMARY = 40
_CODES = {"failures": 1, "errors": 2, "short_summary": 3, "tail": 4}


def classify_lines(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    line_class = (
        F.when(~t.startswith("="), "text")
        .when(t.rlike(P.PYTEST_FAILURES), "failures")
        .when(t.rlike(P.PYTEST_ERRORS), "errors")
        .when(t.rlike(P.PYTEST_SHORT), "short_summary")
        .when(t.rlike(P.PYTEST_FINAL) & t.rlike(P.PYTEST_RULED), "tail")
        .when(t.rlike(P.PYTEST_OTHER), "header")
        .otherwise("text")
    )
    return once(lines.select("log_id", "line_no", T.strip_cr("line").alias("text")), "line_class", line_class)


def facts(lines: DataFrame, span: int | None = None) -> DataFrame:
    """Content lines with their section, and result lines with section ``final``.

    An unknown header ends a section, but only after a known one.
    """
    c = F.col("line_class")
    code = F.lit(None).cast("int")
    for name, value in {**_CODES, "header": _CODES["tail"]}.items():
        code = F.when(c == name, value).otherwise(code)
    known = F.when(c.isin(*_CODES), 1)
    carried = scan(classify_lines(lines), before={"known": known, "code": code}, span=span, late=True)
    section = F.lit("prelude")
    for name, value in _CODES.items():
        section = F.when(F.col("known").isNotNull() & (F.col("code") == value), name).otherwise(section)
    content = (c == "text") | ((c == "header") & (F.col("section") == "prelude"))
    final = F.when((c == "tail"), "final").when(content, F.col("section"))
    return carried.withColumn("section", section).withColumn("section", final).filter(
        "section IS NOT NULL").select("log_id", "line_no", "section", "text")


def pytest_sections(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("section != 'final'")


def result_of(fact_rows: DataFrame) -> DataFrame:
    """The last result line and the first platform line of the prelude."""
    t, section = F.col("text"), F.col("section")
    final = T.trim(F.regexp_replace(t, "=+", ""))
    platform = (section == "prelude") & t.rlike(P.PYTEST_PLATFORM)
    found = fact_rows.filter((section == "final") | platform).groupBy("log_id").agg(
        F.max(F.when(section == "final", F.struct("line_no", final.alias("v")))).alias("final"),
        F.min(F.when(section == "prelude", F.struct("line_no", t.alias("v")))).alias("platform"))
    return found.select("log_id", F.nullif("final.v", F.lit("")).alias("final"), F.col("platform.v").alias("platform"))


def pytest_result(lines: DataFrame) -> DataFrame:
    """Result and platform of every log."""
    return D.log_sizes(lines).select("log_id").join(result_of(facts(lines)), "log_id", "left")


def pytest_blocks(fact_rows: DataFrame, caps: dict[str, int] | None = None, span: int | None = None) -> DataFrame:
    """Lines of the errors and failures blocks: single blanks, no blank at the ends, middle cut.

    ``seq`` is the position in the trimmed block; the marker row takes that of the first cut line.
    """
    caps = caps or CAPS
    key = ["log_id", "section"]
    blank = T.is_blank("text")
    block = fact_rows.filter(F.col("section").isin(*caps))
    near = scan(block, before={"prev_text": (~blank).cast("int")}, after={"more": F.when(~blank, 1)}, key=key, span=span)
    kept = near.filter(~blank | ((F.col("prev_text") == 1) & F.col("more").isNotNull()))
    n = scan(kept, running={"seq": F.lit(1)}, total={"n": F.lit(1)}, key=key, span=span)
    cap = F.lit(None).cast("int")
    for name, value in caps.items():
        cap = F.when(F.col("section") == name, value).otherwise(cap)
    over = F.col("n") > cap
    head = F.when(over, F.floor(cap * F.lit(0.6))).otherwise(F.col("n"))
    tail = F.when(over, F.floor(cap * F.lit(0.4))).otherwise(F.lit(0))
    seq = F.col("seq")
    dropped = F.col("n") - F.col("head") - F.col("tail")
    marker = F.concat(F.lit("… ["), dropped.cast("string"), F.lit(" lines omitted] …"))
    shown = F.when((seq == F.col("head") + 1) & (dropped > 0), marker).when(
        (seq <= F.col("head")) | (seq > F.col("n") - F.col("tail")), F.col("text"))
    return n.withColumn("head", head).withColumn("tail", tail).withColumn("line", shown).filter(
        "line IS NOT NULL").select("log_id", "section", "seq", "line")


def pytest_short_summary(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """The lines of the short summary, all or the first k."""
    listed = fact_rows.filter((F.col("section") == "short_summary") & (T.trim("text") != ""))
    return first_lines(listed, k).select(
        "log_id", "seq", T.trim("text").alias("text"))


def stats(fact_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    sec = F.col("section")
    counts = fact_rows.groupBy("log_id").agg(
        F.count_if(sec == "errors").alias("errors"), F.count_if(sec == "failures").alias("failures"),
        F.count_if((sec == "short_summary") & (T.trim("text") != "")).alias("listed"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    out = sizes.join(result_of(fact_rows), "log_id", "left").join(counts, "log_id", "left").select(
        "log_id", "original_tokens", "final", "platform", zero("errors"), zero("failures"), zero("listed"))
    listed = F.concat(F.lit("pytest: "), F.col("listed").cast("string"), F.lit(" failure(s)"))
    bad = (F.col("listed") > 0) | (F.col("failures") > 0) | (F.col("errors") > 0)
    return out.withColumn(
        "summary", F.when(F.col("final").isNotNull(), F.concat(F.lit("pytest: "), "final"))
        .when(F.col("listed") > 0, listed).otherwise("pytest OK")
    ).withColumn("outcome", F.when(bad | F.col("final").rlike("(failed|error)"), "failed")
                 .when(F.col("final").isNull(), "unknown").otherwise("ok"))


def digest_rows(fact_rows: DataFrame, totals: DataFrame) -> DataFrame:
    row = D.row

    def header(section: int, cond: Column, title: str) -> list[Column]:
        return [F.when(cond, row(section, 0, "")), F.when(cond, row(section, 1, title))]

    heads = D.rows_of(
        totals,
        F.when(F.col("platform").isNotNull(), row(0, 0, F.col("platform"))),
        F.when(F.col("platform").isNotNull() & F.col("final").isNotNull(), row(1, 0, "")),
        F.when(F.col("final").isNotNull(), row(1, 1, F.col("final"))),
        *header(2, F.col("errors") > 0, "ERRORS:"),
        *header(3, F.col("failures") > 0, "FAILURES:"),
        *header(4, F.col("listed") > 0, "Short summary:"))
    blocks = D.rows_of(
        pytest_blocks(fact_rows),
        F.when(F.col("section") == "errors", row(2, F.col("seq") + 1, F.col("line"))),
        F.when(F.col("section") == "failures", row(3, F.col("seq") + 1, F.col("line"))))
    short = D.rows_of(pytest_short_summary(fact_rows, SHOWN_SUMMARY), row(4, F.col("seq") + 1, F.concat(F.lit("  "), "text")))
    return D.union([heads, blocks, short])


def digest(lines: DataFrame) -> DataFrame:
    t, section = F.col("text"), F.col("section")
    shown = (section != "tail") & ((section != "prelude") | t.rlike(P.PYTEST_PLATFORM))
    known = stage(facts(lines).filter(shown))
    totals = stats(known, D.log_sizes(lines))
    return D.finish("pytest", totals, digest_rows(known, totals))
