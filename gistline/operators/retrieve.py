"""Serving the detail behind a digest: pattern search, ranges, references, budgets.

The reference tool answers for one log; these answer for all logs of a table at once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from gistline.functions import text as T
from gistline.operators.digest import log_sizes
from gistline.operators.scan import deal, first_k, once, scan
from gistline.sources.staging import stage

FEW_WORDS = 256  #: Requests of a file that each of its lines is looked through for.
FEW_PLACES = 1 << 16  #: Lines around hits that may be broadcast, if the planner likes.

# ASCII word bound; Java's own looks at Unicode letters.
_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def pattern_error(df: DataFrame, pattern: str) -> str | None:
    """Why a pattern is not a regex, found before any task runs."""
    jvm = getattr(df.sparkSession, "_jvm", None)
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:  # noqa: BLE001 - the JVM wraps its own exception type
        return f"[error] invalid regex: {pattern}"
    return None


def grep_context(lines: DataFrame, pattern: str, context: int = 3) -> DataFrame:
    """(log_id, line_no, part, text): lines within ``context`` of a hit, part 1; ``---`` before
    each group, part 0.

    Two passes instead of a shuffle of all lines: the hits are written first, so the planner
    knows their size and joins the few wanted positions by broadcast when they are few.
    """
    error = pattern_error(lines, pattern)
    if error:
        return lines.select("log_id").distinct().select(
            "log_id", F.lit(0).cast("bigint").alias("line_no"), F.lit(0).alias("part"), F.lit(error).alias("text"))
    hits = stage(lines.filter(F.col("line").rlike(f"(?i){pattern}")).select("log_id", "line_no"))
    at = F.col("line_no")
    band = hits.select("log_id", F.explode(F.sequence(
        F.greatest(F.lit(1).cast("bigint"), at - context), at + context)).alias("line_no")).distinct()
    previous = band.select("log_id", (at + 1).alias("line_no"), F.lit(False).alias("opens"))
    wanted = band.join(previous, ["log_id", "line_no"], "left").select(
        "log_id", "line_no", F.coalesce("opens", F.lit(True)).alias("opens"))
    shown = lines.join(wanted, ["log_id", "line_no"])
    row = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("text"))
    rows = F.array_compact(F.array(
        F.when(F.col("opens"), row(0, F.lit("---"))), row(1, numbered(F.col("line_no"), F.col("line")))))
    return shown.select("log_id", "line_no", F.inline(rows))


def numbered(no, line):
    return F.concat(no.cast("string"), F.lit(": "), line)


def slice_lines(lines: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Lines lo..hi, 1-based and inclusive, numbered."""
    no = F.col("line_no")
    found = lines.filter(no >= (1 if lo is None else lo))
    if hi is not None:
        found = found.filter(no <= hi)
    return found.select("log_id", "line_no", numbered(no, F.col("line")).alias("text"))


def head_lines(lines: DataFrame, n: int = 200) -> DataFrame:
    return slice_lines(lines, 1, n)


def cap_tokens(rows: DataFrame, max_tokens: int = 2000, pos: str = "ord", span: int | None = None) -> DataFrame:
    """(log_id, pos, text): rows while their cost fits, then one marker row."""
    cost = T.estimate_tokens("text") + 1
    spent = scan(rows.select("log_id", pos, "text"), running={"spent": cost}, pos=pos, span=span)
    marker = F.lit(f"… [truncated at {max_tokens} tokens; use start_line/end_line to paginate]")
    shown = F.when(F.col("spent") <= max_tokens, F.col("text")).when(F.col("spent") - cost <= max_tokens, marker)
    return spent.select("log_id", pos, shown.alias("text")).filter("text IS NOT NULL")


def read_log_section(lines: DataFrame, pattern: str | None = None, context: int = 3, lo: int | None = None,
                     hi: int | None = None, max_tokens: int = 2000) -> DataFrame:
    """A pattern, else a range, else the first 200 lines; under a token budget."""
    if pattern:
        rows = grep_context(lines, pattern, context).withColumn("ord", F.col("line_no") * 2 + F.col("part") + 1)
    else:
        rows = head_lines(lines) if lo is None and hi is None else slice_lines(lines, lo, hi)
        rows = rows.withColumn("ord", F.col("line_no") * 2)
    return cap_tokens(rows, max_tokens)


def read_lines(files: DataFrame, lines: DataFrame, lo: int, hi: int, max_tokens: int = 2000, max_bytes: int | None = None) -> DataFrame:
    """(file_key, seq, text): header and numbered lines lo..hi of each file under a budget.

    ``files`` has file_key, path, size_bytes and ``n``, the number of lines; ``lines`` (file_key,
    line_no, line) needs no more than lines lo..hi, as ``stored_lines`` gives them. Files over
    ``max_bytes``, if that is given, get an error row instead.

    A line costs at least one token, so at most ``max_tokens`` + 1 lines of a file are looked at
    and the window below stays small whatever the file's size.
    """
    first = F.lit(max(1, lo)).cast("bigint")
    sized = files.select("file_key", "path", "size_bytes", F.col("n").cast("bigint").alias("n"))
    sized = sized.withColumn("last", F.least("n", F.lit(hi).cast("bigint")))
    s = lambda c: c.cast("string")
    reversed_ = F.concat(F.lit("[error] end_line ("), s(F.col("last")), F.lit(") < start_line ("), s(first), F.lit(")"))
    error = F.when(F.col("last") < first, reversed_)
    if max_bytes is not None:
        mega = F.floor(F.col("size_bytes") / 1048576 + 0.5)
        too_big = F.concat(F.lit("[error] "), "path", F.lit(" is "), s(mega), F.lit(f"MB (limit {max_bytes >> 20}MB)"))
        error = F.when(F.col("size_bytes") > max_bytes, too_big).otherwise(error)
    header = F.concat(F.lit("File: "), "path", F.lit("\nLines "), s(first), F.lit("-"), s(F.col("last")),
                      F.lit(" of "), s(F.col("n")), F.lit("\n"))
    sized = sized.withColumn("error", error).withColumn("header", header)
    good = sized.filter("error IS NULL")
    at = F.col("line_no")
    wanted = lines.select("file_key", "line_no", "line").filter(at.between(max(1, lo), min(hi, max(1, lo) + max_tokens)))
    body = wanted.join(good.select("file_key", F.length("header").alias("header_chars")), "file_key").withColumn("text", numbered(at, F.col("line")))
    cost = T.estimate_tokens("text")
    upto = Window.partitionBy("file_key").orderBy("line_no")
    spent = T.tokens_of_length(F.col("header_chars")) + F.sum(cost).over(upto)
    marker = F.lit(f"... [truncated at {max_tokens} tokens; use a narrower range]")
    shown = F.when(F.col("spent") <= max_tokens, F.col("text")).when(
        F.col("before") <= max_tokens, marker)
    kept = body.withColumn("spent", spent).withColumn("before", F.col("spent") - cost).select(
        "file_key", (at - first + 4).cast("bigint").alias("seq"), shown.alias("text")).filter("text IS NOT NULL")
    heads = good.select("file_key", F.posexplode(F.split("header", "\n")).alias("p", "text")).select(
        "file_key", (F.col("p") + 1).cast("bigint").alias("seq"), "text")
    errors = sized.filter("error IS NOT NULL").select(
        "file_key", F.lit(1).cast("bigint").alias("seq"), F.col("error").alias("text"))
    return heads.unionByName(kept).unionByName(errors)


def word_index(lines: DataFrame, id_col: str = "file_id") -> DataFrame:
    """The inverted index of the lines: (word, ``id_col``, line_no), a word once for each of its lines.

    Words are runs of ASCII letters, digits and underscores, so a word bounded by anything else is one
    entry. Write it partitioned or bucketed by a hash of the word to look up few words in many lines.
    """
    words = F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return lines.select(F.explode(words).alias("word"), id_col, "line_no")


def indexed_references(lines: DataFrame, requests: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(file_id, identifier, line_no): lines of a file that hold the identifier as a word, for a table of
    requests (file_id, identifier).

    Each request is looked up in the index by its longest word, an equi join; the lines found are
    fetched and, where the identifier is more than that word, compared with its pattern. An
    identifier without any letter, digit or underscore is looked for in its file's lines.

    Without an ``index``, the lines of files with at most ``FEW_WORDS`` requests meet their file's words
    instead, so that lines are dealt and not all their words; an index is made of the other files' lines alone.
    """
    if index is None:
        wanted = requests.filter("file_id IS NOT NULL AND identifier IS NOT NULL").select("file_id", "identifier").distinct()
        sizes = stage(wanted.groupBy("file_id").agg(F.count("*").alias("n")))
        few, many = (sizes.filter(where).select("file_id") for where in (f"n <= {FEW_WORDS}", f"n > {FEW_WORDS}"))
        found = _references_by_file(lines, wanted.join(few, "file_id", "left_semi"))
        if many.isEmpty():
            return found
        rest = lines.join(many, "file_id", "left_semi")
        return found.unionByName(indexed_references(rest, wanted.join(many, "file_id", "left_semi"), word_index(rest)))
    asked = requests.select("file_id", "identifier").filter("file_id IS NOT NULL AND identifier IS NOT NULL").distinct()
    words = F.regexp_extract_all("identifier", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    asked = asked.withColumn("word", longest)
    hits = asked.filter("word IS NOT NULL").join(index, ["file_id", "word"]).select("file_id", "identifier", "word", "line_no")
    pattern = F.concat(F.lit(_BOUND), T.regex_escape_col("identifier"), F.lit(_BOUND))
    whole = hits.filter("word = identifier").select("file_id", "identifier", "line_no")
    partly = stage(hits.filter("word <> identifier")).join(lines.select("file_id", "line_no", "line"), ["file_id", "line_no"])
    signs = asked.filter("word IS NULL AND identifier <> ''").join(lines.select("file_id", "line_no", "line"), "file_id").filter(
        F.contains("line", "identifier"))
    checked = partly.select("file_id", "identifier", "line_no", "line").unionByName(
        signs.select("file_id", "identifier", "line_no", "line")).filter(F.regexp_like("line", pattern)).select("file_id", "identifier", "line_no")
    return whole.unionByName(checked)


def _references_by_file(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """As :func:`indexed_references`, for few distinct requests a file: each line is looked through for its file's identifiers."""
    words = F.regexp_extract_all("identifier", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    by_file = asked.filter("identifier <> ''").withColumn("word", longest).groupBy("file_id").agg(
        F.collect_list(F.struct("identifier", "word")).alias("asked"))
    both = lines.select("file_id", "line_no", "line").join(by_file, "file_id")
    held = F.regexp_extract_all("line", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    both = both.select("file_id", "line_no", "line", held.alias("held"), "asked")
    near = F.filter("asked", lambda a: F.when(a["word"].isNull(), F.contains("line", a["identifier"])).otherwise(F.array_contains("held", a["word"])))
    hits = both.select("file_id", "line_no", "line", F.explode(near).alias("a"))
    pattern = F.concat(F.lit(_BOUND), T.regex_escape_col(F.col("a.identifier")), F.lit(_BOUND))
    whole = F.coalesce(F.col("a.word") == F.col("a.identifier"), F.lit(False))
    return hits.filter(F.when(whole, F.lit(True)).otherwise(F.regexp_like("line", pattern))).select(
        "file_id", F.col("a.identifier").alias("identifier"), "line_no")


def find_references(lines: DataFrame, identifier: str, limit: int | None = None) -> DataFrame:
    """The lines of each text that hold the identifier as a word; case counts.

    ``total`` is how many there are and ``capped`` whether ``limit`` left some out.
    """
    pattern = _BOUND + T.regex_escape(identifier) + _BOUND
    found = once(lines, "hit", F.col("line").rlike(pattern)).filter("hit").select("log_id", "line_no", "line")
    if limit is None:
        counted = scan(found, running={"seq": F.lit(1)}, total={"total": F.lit(1)})
        return counted.select("log_id", "line_no", "line", "seq", "total", F.lit(False).alias("capped"))
    totals = found.groupBy("log_id").agg(F.count("*").alias("total"))
    first = first_k(found, limit, ["log_id"], ["line_no"])
    return first.join(totals, "log_id").select("log_id", "line_no", "line", "seq", "total", (F.col("total") > limit).alias("capped"))


def reference_context(lines: DataFrame, identifier: str, context: int = 2, limit: int | None = None) -> DataFrame:
    """(log_id, seq, line_no, part, text): the lines around each hit. Bands of neighbouring hits
    repeat their common lines; ``---`` (part 0) stands before a band that does not touch the last."""
    at = F.col("line_no")
    pattern = _BOUND + T.regex_escape(identifier) + _BOUND
    found = once(lines, "hit", F.col("line").rlike(pattern)).filter("hit").select("log_id", "line_no")
    if limit is None:
        hits = stage(scan(found, running={"seq": F.lit(1)}, before={"last": at}))
    else:
        hits = stage(scan(first_k(found, limit, ["log_id"], ["line_no"]), before={"last": at}))
    start = F.greatest(F.lit(1).cast("bigint"), at - context)
    bands = hits.select("log_id", "seq", at.alias("hit"), start.alias("start"), "last").select(
        "log_id", "seq", "hit", "start",
        (F.col("last").isNull() | (F.col("start") > F.col("last") + context + 1)).alias("apart"),
        F.explode(F.sequence(F.col("start"), F.col("hit") + context)).alias("line_no"))
    # Bands compress so well that Spark would leave one partition for a core.
    bands = deal(bands, ["log_id", "line_no"])
    # The planner knows the hits by the size of their files, some bytes a hit, and not how many lines come of each.
    if hits.count() * (2 * context + 1) > FEW_PLACES:
        bands = bands.hint("merge")
    shown = lines.join(bands, ["log_id", "line_no"])
    mark = F.when(at == F.col("hit"), "► ").otherwise("  ")
    row = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("text"))
    rows = F.array_compact(F.array(
        F.when((at == F.col("start")) & F.col("apart"), row(0, F.lit("---"))),
        row(1, F.concat(mark, numbered(at, F.col("line"))))))
    return shown.select("log_id", "seq", "line_no", F.inline(rows))


def head_tail(lines: DataFrame, small: int = 300, head: int = 50, tail: int = 50) -> DataFrame:
    """(log_id, line_no, text): short texts whole; of long ones the numbered first and last lines
    and, in place of the first line left out, how many are left out."""
    sizes = stage(log_sizes(lines).select("log_id", "n_lines"))
    at, n = F.col("line_no"), F.col("n_lines")
    omitted = F.concat(F.lit("... ["), (n - head - tail).cast("string"), F.lit(" lines omitted] ..."))
    shown = (
        F.when(n <= small, F.col("line"))
        .when((at <= head) | (at > n - tail), numbered(at, F.col("line")))
        .when(at == head + 1, omitted))
    return lines.join(sizes, "log_id").select("log_id", "line_no", shown.alias("text")).filter("text IS NOT NULL")
