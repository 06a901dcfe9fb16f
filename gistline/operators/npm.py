"""Package install logs: error blocks, deprecations, warnings, changes, audit lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D
from gistline.operators.scan import first_k, once, scan
from gistline.sources.staging import stage

SHOWN_ERRORS = 40
TOP_DEPRECATIONS = 10
TOP_WARNINGS = 8


def classify_lines(lines: DataFrame) -> DataFrame:
    """Line classes in testing order. Lines that neither say something nor change the state are dropped."""
    t = F.col("text")
    own = t.startswith("n") | t.startswith("N")
    change = reduce(Column.__or__, [t.startswith(c) for c in "aArRcCuU"])
    # A cheap test goes before each pattern: it holds wherever the pattern does.
    line_class = (
        F.when(t == "", "blank")
        .when(own & t.rlike(P.NPM_ERROR), "error")
        .when(F.col("line").startswith(" ") | ((F.col("line") >= "\t") & (F.col("line") < "\u000e")), "indented")
        .when(own & t.rlike(P.NPM_DEPRECATED), "deprecated")
        .when(own & t.rlike(P.NPM_WARN), "warn")
        .when(change & t.rlike(P.NPM_CHANGE), "change")
        .when(t.between("0", ":") & t.rlike(P.NPM_AUDIT), "audit")
    )
    text = lines.select("log_id", "line_no", "line", T.rtrim("line").alias("text"))
    return once(text, "line_class", line_class).filter("line_class IS NOT NULL").drop("line")


def facts(lines: DataFrame, span: int | None = None) -> DataFrame:
    """Lines that say something: error, cont (indented line of an error block), deprecated, warn,
    change, audit. Only a blank line closes an error block."""
    c = F.col("line_class")
    state = F.when(c == "error", 1).when(c == "blank", 0)
    carried = scan(classify_lines(lines), before={"open": state}, span=span, late=True)
    fact = F.when(c == "indented", F.when(F.col("open") == 1, "cont")).when(c != "blank", c)
    return carried.select("log_id", "line_no", fact.alias("fact"), "text").filter("fact IS NOT NULL")


def stateless_facts(lines: DataFrame) -> DataFrame:
    """The facts that need no carried state, without a shuffle."""
    return classify_lines(lines).withColumnRenamed("line_class", "fact").filter("fact NOT IN ('blank', 'indented')")


def npm_errors(fact_rows: DataFrame) -> DataFrame:
    """Error payloads and the lines of their blocks; ``code`` where a payload names one."""
    header = F.col("fact") == "error"
    text = F.when(header, T.trim(F.regexp_extract("text", P.NPM_ERROR, 1))).otherwise(T.trim("text"))
    return fact_rows.filter("fact IN ('error', 'cont')").select(
        "log_id", "line_no", text.alias("text"),
        F.when(header & text.rlike(P.NPM_CODE + r"\S"), F.regexp_replace(text, P.NPM_CODE, "")).alias("code"),
    ).filter(F.col("text") != "")


def npm_error_code(fact_rows: DataFrame) -> DataFrame:
    """The last ``code X`` payload."""
    found = npm_errors(fact_rows.filter("fact = 'error'")).filter("code IS NOT NULL")
    return found.groupBy("log_id").agg(F.max_by("code", "line_no").alias("code"))


def deprecation_groups(fact_rows: DataFrame) -> DataFrame:
    found = fact_rows.filter("fact = 'deprecated'").select(
        "log_id", "line_no", T.strip_version(F.regexp_extract("text", P.NPM_DEPRECATED, 1)).alias("package"),
        T.trim(F.regexp_extract("text", P.NPM_DEPRECATED, 2)).alias("message"))
    return found.groupBy("log_id", "package").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min_by("message", "line_no").alias("message"))


def npm_deprecations(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Deprecated packages, most frequent first: all, or the first k."""
    top = first_k(deprecation_groups(fact_rows), k, ["log_id"], [F.col("n").desc(), "first_line"], "rank")
    return top.withColumn("message", T.ellipsize("message"))


def warning_groups(fact_rows: DataFrame) -> DataFrame:
    found = fact_rows.filter("fact = 'warn'").select(
        "log_id", "line_no", T.trim(F.regexp_extract("text", P.NPM_WARN, 1)).alias("message"))
    return found.filter(~F.col("message").rlike(P.NPM_DEPRECATED_TEXT)).groupBy("log_id", "message").agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def npm_other_warnings(fact_rows: DataFrame, k: int | None = None) -> DataFrame:
    """Warnings that are no deprecations, by message, most frequent first: all, or the first k."""
    return first_k(warning_groups(fact_rows), k, ["log_id"], [F.col("n").desc(), "first_line"], "rank")


def npm_changes(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("fact = 'change'").select("log_id", "line_no", "text")


def npm_audit(fact_rows: DataFrame) -> DataFrame:
    return fact_rows.filter("fact = 'audit'").select("log_id", "line_no", "text")


def stats(fact_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    c = F.col("fact")
    counts = fact_rows.groupBy("log_id").agg(
        F.count_if(c == "change").alias("changes"), F.count_if(c == "audit").alias("audits"))
    errors = npm_errors(fact_rows).groupBy("log_id").agg(
        F.count("*").alias("errors"),
        F.max_by("code", F.when(F.col("code").isNotNull(), F.col("line_no"))).alias("code"))
    deprecated = deprecation_groups(fact_rows).groupBy("log_id").agg(F.count("*").alias("deprecated"))
    warned = warning_groups(fact_rows).groupBy("log_id").agg(F.count("*").alias("warned"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    out = sizes
    for part in (counts, errors, deprecated, warned):
        out = out.join(part, "log_id", "left")
    out = out.select("log_id", "original_tokens", "code", *[zero(n) for n in (
        "changes", "audits", "errors", "deprecated", "warned")])
    failed = F.concat(F.lit("npm FAILED"), F.coalesce(F.concat(F.lit(" ("), "code", F.lit(")")), F.lit("")))
    noted = F.concat(F.lit("npm OK ("), F.col("deprecated").cast("string"), F.lit(" unique deprecation warnings)"))
    return out.withColumn(
        "summary", F.when(F.col("errors") > 0, failed).when(F.col("deprecated") > 0, noted).otherwise("npm OK")
    ).withColumn("outcome", F.when(F.col("errors") > 0, "failed").otherwise("ok"))


def npm_summary(lines: DataFrame) -> DataFrame:
    return stats(facts(lines), D.log_sizes(lines)).select("log_id", "summary", "code", "changes", "audits", "errors", "deprecated", "warned")


def digest_rows(fact_rows: DataFrame, totals: DataFrame) -> DataFrame:
    row = D.row
    s = lambda c: F.col(c).cast("string")
    has = lambda c: F.col(c) > 0
    e, d = F.col("errors"), F.col("deprecated")
    some1, some2 = has("changes"), has("changes") | has("errors")
    some3 = some2 | has("deprecated")
    heads = D.rows_of(
        totals,
        F.when(has("errors") & some1, row(1, 0, "")),
        F.when(has("errors"), row(1, 1, "Errors:")),
        F.when(e > SHOWN_ERRORS, row(1, 2 + SHOWN_ERRORS, F.concat(
            F.lit("  … "), (e - SHOWN_ERRORS).cast("string"), F.lit(" more error lines")))),
        F.when(has("deprecated") & some2, row(2, 0, "")),
        F.when(has("deprecated"), row(2, 1, F.concat(F.lit("Deprecated packages ("), s("deprecated"), F.lit(" unique):")))),
        F.when(d > TOP_DEPRECATIONS, row(2, 2 + TOP_DEPRECATIONS, F.concat(
            F.lit("  … "), (d - TOP_DEPRECATIONS).cast("string"), F.lit(" more deprecations omitted")))),
        F.when(has("warned") & some3, row(3, 0, "")),
        F.when(has("warned"), row(3, 1, F.concat(F.lit("Other warnings ("), s("warned"), F.lit(" unique):")))),
        F.when(has("audits") & (some3 | has("warned")), row(4, 0, "")),
        F.when(has("audits"), row(4, 1, "Audit:")),
    )
    shown = first_k(npm_errors(fact_rows), SHOWN_ERRORS, ["log_id"], ["line_no"])
    return D.union([
        heads,
        D.rows_of(fact_rows, F.when(F.col("fact") == "change", row(0, F.col("line_no"), F.col("text"))),
                  F.when(F.col("fact") == "audit", row(4, F.col("line_no") + 1, F.concat(F.lit("  "), "text")))),
        D.rows_of(shown, row(1, F.col("seq") + 1, F.concat(F.lit("  "), "text"))),
        D.rows_of(npm_deprecations(fact_rows, TOP_DEPRECATIONS), row(2, F.col("rank") + 1, F.concat(
            F.lit("  "), T.count_prefix("n"), "package", F.lit(" — "), "message"))),
        D.rows_of(npm_other_warnings(fact_rows, TOP_WARNINGS), row(3, F.col("rank") + 1, F.concat(
            F.lit("  "), T.count_prefix("n"), "message"))),
    ])


def digest(lines: DataFrame) -> DataFrame:
    known = stage(facts(lines))
    totals = stats(known, D.log_sizes(lines))
    return D.finish("npm", totals, digest_rows(known, totals))
