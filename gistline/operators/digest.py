"""Digests: ordered rows of text per log, joined to short texts, and what they save.

A digest row is (log_id, section, seq, text) and optionally ``glue``, the text that goes before
it when it is not the first row (a newline unless given). Unbounded sections (compiler errors,
for example, are neither merged nor capped) make a digest that may not fit a cell, so texts are
joined in *pieces* of at most ``PIECE`` positions and pieces in *parts* of about ``PART_CHARS``
characters. Nearly every digest has one part, ``part_no`` 0; the parts in order are the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import text as T
from gistline.operators.scan import scan
from gistline.sources.staging import stage

PIECE = 1 << 16
PART_CHARS = 1 << 24
PIECES_PER_SPAN = 64
_SECTION = 1 << 44


def log_sizes(lines: DataFrame) -> DataFrame:
    """Lines and tokens of every log; one combined row per log and map task is shuffled.

    Lines without a log id belong to no log, here as in ``scan``.
    """
    return lines.filter("log_id IS NOT NULL").groupBy("log_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars")
    ).select("log_id", "n_lines",
             T.tokens_of_length(F.col("chars") + F.col("n_lines") - 1).alias("original_tokens"))


def row(section: int, seq: Column | int, text: Column | str) -> Column:
    """One digest row as a struct, for :func:`rows_of`."""
    return F.struct(
        F.lit(section).alias("section"),
        (F.lit(seq) if isinstance(seq, int) else seq).cast("bigint").alias("seq"),
        (F.lit(text) if isinstance(text, str) else text).alias("text"),
    )


def rows_of(df: DataFrame, *items: Column, glue: str = "\n") -> DataFrame:
    """Digest rows from row structs; a null struct gives no row."""
    rows = df.select("log_id", F.inline(F.array(*items))).filter("section IS NOT NULL")  # a null struct has no section
    return rows.withColumn("glue", F.lit(glue))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assemble(rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(log_id, part_no, body) from digest rows.

    The rows are written once. A log with no more of them than a piece has positions, and fewer characters than
    a part, is joined in one step; only the others go by pieces.
    """
    ord_ = F.col("section").cast("bigint") * _SECTION + F.col("seq")
    texts = stage(rows.filter("log_id IS NOT NULL").select("log_id", ord_.alias("ord"), F.concat("glue", "text").alias("text")))
    sizes = texts.groupBy("log_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = stage(sizes.filter((F.col("n") > PIECE) | (F.col("chars") >= part_chars)).select("log_id"))
    if large.isEmpty():
        return _in_one_part(texts)
    return _in_one_part(texts.join(large, "log_id", "left_anti")).unionByName(_by_pieces(texts.join(large, "log_id", "left_semi"), part_chars))


def _in_one_part(texts: DataFrame) -> DataFrame:
    whole = texts.groupBy("log_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY ord)").alias("body"))
    return whole.select("log_id", F.lit(0).cast("bigint").alias("part_no"), F.substr("body", F.lit(2)).alias("body"))


def _by_pieces(texts: DataFrame, part_chars: int) -> DataFrame:
    pieces = (
        texts.withColumn("piece", F.expr(f"ord div {PIECE} + 1"))
        .groupBy("log_id", "piece")
        .agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY ord)").alias("text"))
    )
    placed = scan(pieces, running={"upto": F.length("text")}, pos="piece", span=PIECES_PER_SPAN)
    part_no = F.floor((F.col("upto") - F.length("text")) / part_chars)
    parts = placed.withColumn("part_no", part_no).groupBy("log_id", "part_no").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY piece)").alias("body"))
    return parts.withColumn(
        "body", F.when(F.col("part_no") == 0, F.substr("body", F.lit(2))).otherwise(F.col("body")))


def finish(kind: str, stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests of all logs in ``stats`` (log_id, summary, original_tokens, outcome)."""
    done = stats.join(assemble(rows), "log_id", "left")
    return done.select(
        "log_id", F.lit(kind).alias("kind"), F.coalesce("part_no", F.lit(0).cast("bigint")).alias("part_no"),
        "summary", F.coalesce("body", F.lit("")).alias("body"), "original_tokens", "outcome")


def account(digests: DataFrame) -> DataFrame:
    """Tokens before and after, per log; the summary line is not counted."""
    return digests.groupBy("log_id", "kind").agg(
        F.first("original_tokens").alias("original_tokens"),
        T.tokens_of_length(F.sum(F.length("body"))).alias("compressed_tokens"))


def format_response(digests: DataFrame, runs: DataFrame) -> DataFrame:
    """The text a caller sees: summary with status, body, reduction, log id. One row per part."""
    sized = digests.join(account(digests).select("log_id", "compressed_tokens"), "log_id")
    both = sized.join(runs.select("log_id", "exit_code", "timed_out", "duration_ms"), "log_id")
    s = lambda c: F.col(c).cast("string")
    pct = T.reduction_pct("original_tokens", "compressed_tokens")
    response = F.concat_ws(
        "\n",
        F.concat("summary", F.lit(" ["), T.run_status("timed_out", "exit_code"), F.lit(", "), s("duration_ms"), F.lit("ms]")),
        F.lit(""), "body", F.lit(""), F.lit("---"),
        F.concat(F.lit("[Compressed from ~"), s("original_tokens"), F.lit(" tokens → ~"), s("compressed_tokens"),
                 F.lit(" tokens ("), pct.cast("string"), F.lit("% reduction)]")),
        F.concat(F.lit('[Full log stored as log_id="'), s("log_id"), F.lit('"]')),
    )
    return both.select("log_id", "part_no", response.alias("response"))


def reduction_report(accounts: DataFrame, *by: str) -> DataFrame:
    """Totals per group and over all groups, with the share saved in percent."""
    return accounts.rollup(*by).agg(
        F.count("*").alias("logs"), F.sum("original_tokens").alias("original_tokens"),
        F.sum("compressed_tokens").alias("compressed_tokens"),
    ).withColumn("reduction_pct", T.reduction_pct_1("original_tokens", "compressed_tokens"))
