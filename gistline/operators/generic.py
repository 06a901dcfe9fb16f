"""Any other output: repeats collapsed, error lines first, the middle cut when it is long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import patterns as P, text as T
from gistline.operators import digest as D
from gistline.operators.scan import halo, once, scan
from gistline.sources.staging import stage

SHOWN_ERRORS = 50
FEW_LOGS = 1 << 19  #: Logs whose notes' lengths are broadcast, some 100 bytes each.
ERROR_PATTERN = "(?i)" + P.word(P.ERROR_WORDS)


def _runs(lines: DataFrame, span: int | None) -> DataFrame:
    """The rows that stand for runs of equal lines, numbered, with the log's and their own counts, in one dealing of the lines.

    A run shows up as its first line and, if longer than one, its second line (which becomes the
    note). Both are recognised from the two lines before, so only they are kept and numbered.
    """
    near = halo(
        lines.filter("log_id IS NOT NULL").select("log_id", "line_no", "line"),
        lambda w: {"p1": F.lag("line", 1).over(w), "p2": F.lag("line", 2).over(w),
                   "following": F.lead("line_no", 1).over(w)},
        left=2, right=1, span=span, keep_span=True)
    again = F.col("line").eqNullSafe(F.col("p1"))
    marked = near.select(
        "log_id", "__span", "line_no", (~again).alias("starts"),
        (again & ~F.col("p1").eqNullSafe(F.col("p2"))).alias("second"),
        F.col("following").isNull().alias("ends"),
        F.when(~again, F.col("line")).alias("line"),
    ).filter("starts OR second OR ends")
    # A note about repeats is no error line.
    marked = once(marked, "is_error", F.col("starts") & F.coalesce(F.col("line").rlike(ERROR_PATTERN), F.lit(False)))
    shown, error = F.col("starts") | F.col("second"), F.col("is_error").cast("int")
    stop = F.when(F.col("starts"), F.col("line_no")).when(F.col("ends"), F.col("line_no") + 1)
    numbered = scan(
        marked, after={"stop": stop}, running={"seq": shown.cast("int"), "rank": error}, span=span, dealt=True,
        total={"n": shown.cast("int"), "chars": F.when(F.col("starts"), F.length("line")), "errors": error}).filter(shown)
    length = F.coalesce("stop", F.col("line_no") + 1) - F.col("line_no") + 1
    note = F.concat(F.lit("  … (repeated "), length.cast("string"), F.lit("×)"))
    return numbered.withColumn("line", F.when(F.col("starts"), F.col("line")).otherwise(note))


def dedupe_consecutive(lines: DataFrame, span: int | None = None) -> DataFrame:
    """(log_id, seq, line): each run of equal lines once, then a row with its length if it repeats."""
    return _runs(lines, span).select("log_id", "seq", "line")


def error_lines(lines: DataFrame, k: int | None = None) -> DataFrame:
    """The error lines of each log, all or the first k, with the log's number of error lines."""
    wanted = F.col("is_error") if k is None else F.col("is_error") & (F.col("rank") <= k)
    return sized(lines).filter(wanted).select(
        "log_id", "seq", "line", "rank", F.col("errors").alias("error_count"))


def sized(lines: DataFrame, span: int | None = None) -> DataFrame:
    """Merged lines with the log's number of lines, tokens, error lines, and the rank among those.

    Written once: the lengths of the notes are known only when the runs are, and are added up from there.
    """
    runs = stage(_runs(lines, span).select("log_id", "seq", "line", "starts", "is_error", "rank", "n", "chars", "errors"))
    notes = stage(runs.filter("NOT starts").groupBy("log_id").agg(F.sum(F.length("line")).alias("note_chars")))
    if notes.count() <= FEW_LOGS:  # one row a log: a join by log id would bring all lines of a log to one task
        notes = F.broadcast(notes)
    chars = F.col("chars") + F.coalesce("note_chars", F.lit(0))
    return runs.join(notes, "log_id", "left").withColumn("tokens", T.tokens_of_length(chars + F.col("n") - 1)).drop("chars", "note_chars", "starts")


def _cut(max_tokens: int) -> Column:
    """What a line becomes when the middle is cut: itself, the marker (first cut line), or null."""
    n, seq = F.col("n"), F.col("seq")
    over = F.col("tokens") > max_tokens
    head, tail = F.floor(n * F.lit(0.3)), F.floor(n * F.lit(0.5))
    marker = F.concat(F.lit("… ["), (n - head - tail).cast("string"), F.lit(" lines omitted] …"))
    return F.when(~over | (seq <= head) | (seq > n - tail), F.col("line")).when(seq == head + 1, marker)


def middle_truncate(lines: DataFrame, max_tokens: int = 2000, span: int | None = None) -> DataFrame:
    """(log_id, ord, line): logs over budget keep their first 30 and last 50 percent of lines."""
    shown = sized(lines, span).select(
        "log_id", (F.col("seq") * 2).alias("ord"), _cut(max_tokens).alias("line"))
    return shown.filter("line IS NOT NULL")


def stats(sized_lines: DataFrame, sizes: DataFrame) -> DataFrame:
    n = F.col("errors")
    counts = sized_lines.filter("seq = 1").select("log_id", "errors")
    return sizes.join(counts, "log_id", "left").withColumn(
        "summary", F.when(n > 0, F.concat(F.lit("Command output ("), n.cast("string"), F.lit(" error-matching lines)")))
        .otherwise("Command output")).withColumn("outcome", F.lit("unknown"))


def digest_rows(sized_lines: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """All rows in one pass: each line knows the log's counts and its own rank."""
    row, n = D.row, F.col("errors")
    first, some = F.col("seq") == 1, n > 0
    body = _cut(max_tokens)
    return D.rows_of(
        sized_lines,
        F.when(first & some, row(0, 0, F.concat(F.lit("Error-matching lines ("), n.cast("string"), F.lit("):")))),
        F.when(F.col("is_error") & (F.col("rank") <= SHOWN_ERRORS), row(0, F.col("rank"), F.col("line"))),
        F.when(first & some, row(1, 0, "")),
        F.when(body.isNotNull(), row(2, F.col("seq"), body)))


def digest(lines: DataFrame, max_tokens: int = 2000) -> DataFrame:
    merged = sized(lines)
    return D.finish("generic", stats(merged, D.log_sizes(lines)), digest_rows(merged, max_tokens))
