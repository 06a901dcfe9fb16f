"""Whole jobs for a user's tables: captured runs to digests, source files to focused readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from gistline.functions import text as T
from gistline.operators import classify, digest as D, lexical, retrieve as R, symbols as S
from gistline.operators.scan import first_k, scan
from gistline.sources import code, store
from gistline.sources.logs import explode_lines
from gistline.sources.staging import stage

_DASHES = "-" * 57
_CHUNK = 1 << 24  # places of one focused symbol among the text rows


@dataclass(frozen=True)
class DistilledRuns:
    logs: DataFrame  #: log_id, kind, text and the run's columns; what the log store keeps
    digests: DataFrame  #: log_id, kind, part_no, summary, body, original_tokens, outcome
    responses: DataFrame  #: log_id, part_no, response
    by_run: DataFrame | None = None  #: of runs as lines, the digests with their run_id


def distill_runs(runs: DataFrame) -> DistilledRuns:
    """Captured runs (run_id, command, stdout, stderr, exit_code, timed_out, duration_ms, ...).

    The runs are read once: classified, named and written by kind. Each distiller reads its own
    kind's folder, and the digests are written before the responses are made of them.
    """
    text = T.combine_streams(T.strip_ansi("stdout"), T.strip_ansi("stderr"))
    logs = runs.withColumn("text", text)
    logs = logs.withColumn("kind", classify.kind_of("command", classify.head_of("text")))
    logs = logs.withColumn("log_id", store.log_id("kind", "run_id", "text")).drop("stdout", "stderr")
    logs = stage(logs, "kind")
    digests = stage(classify.distill(explode_lines(logs, "text", "log_id", "kind")))
    return DistilledRuns(logs, digests, D.format_response(digests, logs))


HEAD_CHARS = 1024  #: What the kind of a run is told from, as many characters and so at most as many lines.
HEAD_LINES = 128  #: Lines of a run that nearly always hold that many characters.
FEW_RUNS = 1 << 21  #: Runs whose kinds are broadcast, some 60 bytes each.


def _with_kind(lines: DataFrame, logs: DataFrame) -> DataFrame:
    """Lines with the kind of their run.

    Runs are few against their lines, so their kinds are broadcast by a hash of the run id, and the lines stay where
    they are. Lines of more runs than ``FEW_RUNS``, and of runs that come twice or share a hash, meet them by run id.
    """
    named = logs.filter("run_id IS NOT NULL").select(F.xxhash64("run_id").alias("__run"), "kind")
    n, hashes = named.agg(F.count("*"), F.count_distinct("__run")).first()
    if n > FEW_RUNS or hashes < n or lines.schema["run_id"].dataType != logs.schema["run_id"].dataType:
        return lines.join(logs.select("run_id", "kind"), "run_id")
    return lines.filter("run_id IS NOT NULL").withColumn("__run", F.xxhash64("run_id")).join(F.broadcast(named), "__run").drop("__run")


def distill_run_lines(runs: DataFrame, lines: DataFrame) -> DistilledRuns:
    """Captured runs (run_id, command, exit_code, timed_out, duration_ms, ...) whose output comes as lines (run_id, line_no, line).

    No cell ever holds a log: the kind is told from the first lines of each run, the log id from hashes
    of all its lines, and the lines go to the distillers as they are. ``logs`` has no text; keep the
    lines with ``write_line_store``. A run without lines gets the empty digest of its kind.
    """
    clean = lines.select("run_id", F.col("line_no").cast("bigint").alias("line_no"), T.strip_ansi("line").alias("line"))
    prints = clean.groupBy("run_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line_no", "line")).alias("print"))
    # Few lines make a head; of runs whose first lines are too short, the rest is fetched. Every line has a line end.
    at, chars = F.col("line_no"), F.coalesce(F.length("line"), F.lit(0)) + 1
    begun = clean.filter(at <= HEAD_CHARS).groupBy("run_id").agg(
        F.sum(F.when(at <= HEAD_LINES, F.least(chars, F.lit(HEAD_CHARS)))).alias("chars"), F.max(at).alias("last"))
    short = stage(begun.filter((F.col("last") > HEAD_LINES) & (F.coalesce("chars", F.lit(0)) <= HEAD_CHARS)).select("run_id"))
    cut = lambda where: clean.filter(where).select("run_id", "line_no", F.left("line", F.lit(HEAD_CHARS)).alias("line"))
    more = cut((at > HEAD_LINES) & (at <= HEAD_CHARS)).join(short, "run_id", "left_semi")
    first = cut(at <= HEAD_LINES).unionByName(more)
    heads = first.groupBy("run_id").agg(F.left(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)"), F.lit(HEAD_CHARS)).alias("head"))
    known = runs.join(heads, "run_id", "left").join(prints, "run_id", "left")
    known = known.withColumn("kind", classify.kind_of("command", F.coalesce("head", F.lit(""))))
    known = known.withColumn("log_id", store.log_id("kind", "run_id", "n", "print")).drop("head", "n", "print")
    logs = stage(known)
    # The lines go by run id, the log id's long hash is given to the digests.
    empty = logs.join(prints, "run_id", "left_anti").select("run_id", "kind", F.lit(1).cast("bigint").alias("line_no"), F.lit("").alias("line"))
    tagged = _with_kind(clean, logs).select("run_id", "kind", "line_no", "line").unionByName(empty)
    # By the kind that a run goes to, too: a distiller may hand a run on, and its digest then has another kind.
    name = F.concat_ws(":", F.length("kind"), "kind", F.col("run_id").cast("string")).alias("__run")
    # Not partitioned by kind: that sorts all lines once more.
    done = classify.distill(stage(tagged.select(name.alias("log_id"), "kind", "line_no", "line"))).withColumnRenamed("log_id", "__run")
    ids = logs.select(name, "log_id", "run_id").distinct()
    by_run = stage(done.join(ids, "__run").select("log_id", "run_id", *[c for c in done.columns if c != "__run"]))
    digests = by_run.drop("run_id")
    return DistilledRuns(logs, digests, D.format_response(digests, logs), by_run)


def read_log_sections(wanted: DataFrame, store_path: str, pattern: str | None = None, context: int = 3, lo: int | None = None,
                      hi: int | None = None, max_tokens: int = 2000) -> DataFrame:
    """(log_id, ord, text): a section of each stored log in ``wanted`` (log_id), or its error row.

    A pattern with lines around it, else a range, else the first 200 lines, under a token budget.
    Only the folders of the wanted ids are read.
    """
    spark = wanted.sparkSession
    stored = stage(store.read_log_store(spark, store_path, wanted).select("log_id", "text"))
    sections = R.read_log_section(explode_lines(stored, "text"), pattern, context, lo, hi, max_tokens)
    missing = store.missing_logs(wanted, stored).select("log_id", F.lit(0).cast("bigint").alias("ord"), F.col("error").alias("text"))
    return sections.unionByName(missing)


def body_costs(found: DataFrame, lines: DataFrame, span: int | None = None) -> DataFrame:
    """Symbols with ``cost``, the tokens of their bodies, from running lengths at both ends."""
    chars = F.length("line")
    upto = scan(lines.select("file_id", "line_no", "line"), key=["file_id"], running={"upto": chars + 1}, span=span)
    indent = chars - F.length(F.ltrim("line"))
    start = upto.select("file_id", F.col("line_no").alias("line_lo"), (F.col("upto") - chars - 1 + indent).alias("from"))
    end = upto.select("file_id", F.col("line_no").alias("line_hi"), (F.col("upto") - 1).alias("to"))
    both = found.join(start, ["file_id", "line_lo"]).join(end, ["file_id", "line_hi"])
    return both.withColumn("cost", T.tokens_of_length(F.col("to") - F.col("from"))).drop("from", "to")


def _text_rows(df: DataFrame, *items) -> DataFrame:
    return D.rows_of(df.withColumn("log_id", F.col("file_id")), *items)


def _frame(modes: DataFrame) -> DataFrame:
    """Everything around the content: header, titles, hints, errors."""
    row, s = D.row, lambda c: F.col(c).cast("string")
    returned, n = F.col("returned"), F.col("picked")
    good, tree, focused = returned != "error", ~returned.isin("error", "full"), returned == "focused"
    what = F.when(returned == "full", "full content").when(focused, F.concat(
        F.lit("outline + "), s("picked"), F.when(n == 1, " focused symbol").otherwise(" focused symbols"))).otherwise("outline only")
    return _text_rows(
        modes,
        F.when(~good, row(0, 0, F.concat(F.lit("[error] could not parse "), "path", F.lit(": unsupported language")))),
        F.when(good, row(0, 1, F.concat(F.lit("File: "), "path"))),
        F.when(good, row(0, 2, F.concat(
            F.lit("Language: "), F.coalesce("language", F.lit("plain")), F.lit(" · "), s("line_count"), F.lit(" lines · ~"),
            s("token_estimate"), F.lit(" tokens (full file)")))),
        F.when(good, row(0, 3, F.concat(F.lit("file_id: "), "file_id"))),
        F.when(good, row(0, 4, F.concat(F.lit("Returning: "), what))),
        F.when(good, row(0, 5, "")),
        F.when(tree, row(0, 6, "OUTLINE")),
        F.when(tree, row(0, 7, _DASHES)),
        F.when(tree, row(3, 0, "")),
        F.when(focused & (n > 0), row(3, 1, "FOCUSED SYMBOLS")),
        F.when(focused & (n > 0), row(3, 2, _DASHES)),
        F.when(good, row(5, 0, "---")),
        F.when(good, row(5, 1, F.concat(F.lit('[file_id="'), "file_id", F.lit('"]')))),
        F.when(returned == "outline_note", row(5, 2, "")),
        F.when(returned == "outline_note", row(5, 3, F.concat(
            F.lit("[note] focus='"), "focus", F.lit("' matched no symbols in this file.")))))


def _trees(table: DataFrame, modes: DataFrame, packed: DataFrame) -> DataFrame:
    """Outlines; a focused one may be longer, marks its picks and lists those it does not reach."""
    row = D.row

    def of(*names: str) -> DataFrame:
        return table.join(modes.filter(F.col("returned").isin(*names)).select("file_id"), "file_id", "left_semi")

    picks = packed.select("file_id", "line_lo", F.lit("   ← focused").alias("mark"))
    plain = S.outline(of("outline", "outline_note"))
    marked = S.outline(of("focused").join(picks, ["file_id", "line_lo"], "left"), S.FOCUSED_CAP)
    missing = S.focused_missing(of("focused"), packed)
    title = missing.select("file_id").distinct()
    return D.union([
        _text_rows(plain.select("file_id", "seq", "text"), row(1, F.col("seq"), F.col("text"))),
        _text_rows(marked.select("file_id", "seq", "text"), row(1, F.col("seq"), F.col("text"))),
        _text_rows(title, row(2, 0, ""), row(2, 1, "(focused symbols beyond outline cap:)")),
        _text_rows(missing.join(packed.select("file_id", "qualified_name", "seq"), ["file_id", "qualified_name"]),
                   row(2, F.col("seq") + 1, F.col("text"))),
    ])


def _bodies(packed: DataFrame, table: DataFrame, lines: DataFrame) -> DataFrame:
    """Bodies of the picked symbols; of those over half the budget their structural outline."""
    row, at = D.row, F.col("seq") * _CHUNK
    fits = ~F.col("oversized")
    title = F.concat(T.kind_label("kind"), F.lit(" "), "qualified_name", F.lit(" "), T.line_range_label("line_lo", "line_hi"))
    fences = _text_rows(packed, F.when(fits, row(4, at, title)), F.when(fits, row(4, at + 1, "```")),
                        F.when(fits, row(4, at + _CHUNK - 2, "```")), row(4, at + _CHUNK - 1, ""))
    # A body that fits has few lines, so its line numbers are listed and joined on equality.
    wanted = packed.filter(fits).select("file_id", "seq", "line_lo", F.explode(F.sequence("line_lo", "line_hi")).alias("line_no"))
    first = F.col("line_no") == F.col("line_lo")
    text = F.when(first, F.ltrim("line")).otherwise(F.col("line"))
    body = _text_rows(lines.join(wanted, ["file_id", "line_no"]), row(4, at + 2 + F.col("line_no") - F.col("line_lo"), text))
    key = ["file_id", "qualified_name", "line_lo"]
    big = packed.filter("oversized").select(*key, F.col("seq").alias("place"))
    outlines = S.structural_outline(table).join(big, key)
    return D.union([fences, body, _text_rows(outlines, row(4, F.col("place") * _CHUNK + F.col("seq"), F.col("text")))])


def read_code(files: DataFrame, focus: str | None = None, mode: str = "auto", max_tokens: int = 2000) -> DataFrame:
    """(file_id, path, returned, part_no, text): each file whole, as an outline, or as an outline
    with the bodies of the focused symbols, whichever its size and the request call for.

    ``files`` has path, mtime_ms, size_bytes, source_text.
    """
    keyed = files.withColumn("file_id", code.file_id("path", "mtime_ms", "size_bytes")).withColumn("language", code.language_of("path"))
    lines = explode_lines(keyed.filter("language IS NOT NULL"), "source_text", "file_id", "language").withColumnRenamed("log_id", "file_id")
    table = stage(lexical.lexical_symbols(lines))
    if focus is None:
        matches = table.limit(0)
    else:
        matches = S.match_focus(table, focus).drop("exact")
    children = S.structural_outline(table).groupBy("file_id", "qualified_name", "line_lo").agg(
        T.tokens_of_length(F.sum(F.length("text")) + F.count("*") - 1).alias("outline_cost"))
    costed = stage(body_costs(matches, lines).join(children, ["file_id", "qualified_name", "line_lo"]))
    fitting = stage(S.pack_focus(costed, max_tokens))
    hits = costed.groupBy("file_id").agg(F.count("*").alias("focus_hits"))
    picked = fitting.groupBy("file_id").agg(F.count("*").alias("picked"))
    status = lexical.parse_status(lines).select("file_id", F.col("status").alias("parse_status"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    asked = code.profile(files).join(hits, "file_id", "left").join(picked, "file_id", "left").join(status, "file_id", "left")
    modes = stage(code.read_mode(asked.withColumns({
        "mode": F.lit(mode), "focus": F.lit(focus).cast("string"), "focus_hits": zero("focus_hits"), "picked": zero("picked"),
        "parse_status": F.coalesce("parse_status", F.lit("failed"))})))
    focused = modes.filter("returned = 'focused'").select("file_id")
    packed = fitting.join(focused, "file_id", "left_semi")
    whole = keyed.join(modes.filter("returned = 'full'").select("file_id"), "file_id", "left_semi")
    row = D.row
    text = D.assemble(D.union([
        _frame(modes), _trees(table, modes, packed), _bodies(packed, table, lines),
        _text_rows(whole, row(1, 0, "```"), row(1, 1, F.col("source_text")), row(1, 2, "```"), row(1, 3, "")),
    ])).select(F.col("log_id").alias("file_id"), "part_no", F.col("body").alias("text"))
    return modes.select("file_id", "path", "returned").join(text, "file_id")


def read_symbols(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(file_id, requested, qualified_name, line_lo, header, note, doc, body, error) for requests (file_id, requested).

    A request gets all symbols of that name or qualified name, overloads too, or one row with an
    error. Only symbols asked for have their lines fetched; a body is cut from those by offsets.
    """
    pieces = lexical.code_pieces(lines)
    table = stage(lexical.lexical_symbols(lines, pieces=pieces))
    found = stage(S.read_symbols(table, requests))
    ranges = found.select("file_id", F.col("char_lo").alias("id"), F.col("char_lo").alias("lo"), F.col("char_hi").alias("hi"), "line_lo", "line_hi").distinct()
    bodies = lexical.cut_texts(ranges, lines, lexical.line_offsets(pieces), "body").withColumnRenamed("id", "char_lo")
    docs = lexical.leading_doc(lines, pieces=pieces).withColumnRenamed("line_no", "line_lo")
    # A comment is the doc of the first declaration on the line below it.
    first = table.groupBy("file_id", "line_lo").agg(F.min("char_lo").alias("char_lo"))
    docs = docs.join(first, ["file_id", "line_lo"]).select("file_id", "char_lo", "doc")
    shown = found.join(bodies, ["file_id", "char_lo"], "left").join(docs, ["file_id", "char_lo"], "left").select(
        "file_id", "requested", "qualified_name", "line_lo", "header", "note", "doc", "body", F.lit(None).cast("string").alias("error"))
    none = S.symbols_not_found(table, requests)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("qualified_name", "string"), ("line_lo", "bigint"), ("header", "string"), ("note", "string"), ("doc", "string"), ("body", "string"))]
    return shown.unionByName(none.select("file_id", "requested", *empty, "error"))


_LINES_AROUND = 1 << 12  #: Places of one hit among the rows of a reference list.


def find_references(lines: DataFrame, requests: DataFrame, symbols: DataFrame, context: int = 2, limit: int | None = 50,
                    index: DataFrame | None = None) -> DataFrame:
    """(file_id, identifier, ord, text): for each request (file_id, path, identifier) its reference list.

    A heading with the number of hits, then for each hit the lines around it and the innermost symbol
    it is in; a request without hits gets one row. The first ``limit`` hits are shown, as the heading
    says, or all for None. Bands of neighbouring hits are not merged.
    """
    if context > _LINES_AROUND // 4:
        raise ValueError(f"at most {_LINES_AROUND // 4} lines around a hit")
    key = ["file_id", "identifier"]
    hits = R.indexed_references(lines, requests, index)
    if limit is None:
        shown = scan(hits, key=key, running={"seq": F.lit(1)}, before={"last": F.col("line_no")})
    else:  # at most ``limit`` rows of a request, so the hit before is found in the request's own window
        shown = first_k(hits, limit, key, ["line_no"]).withColumn("last", F.lag("line_no").over(Window.partitionBy(*key).orderBy("line_no")))
    shown = stage(S.enclosing_symbol(shown, symbols))
    at, seq = F.col("line_no"), F.col("seq") * _LINES_AROUND
    counts = shown.groupBy(*key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    heads = requests.select("file_id", "path", "identifier").distinct().join(counts, key, "left")
    s = lambda c: c.cast("string")
    capped = F.when(F.lit(limit is not None) & (n == F.lit(limit or 0)), F.lit(" (capped)")).otherwise("")
    row = lambda ord_, text: F.struct(F.lit(ord_).cast("bigint").alias("ord"), text.alias("text"))
    head = F.when(n == 0, F.array(row(0, F.concat(F.lit("["), "identifier", F.lit("] 0 matches in "), "path")))).otherwise(F.array(
        row(0, F.concat(F.lit("File: "), "path")), row(1, F.concat(F.lit("Identifier: "), "identifier")),
        row(2, F.concat(s(n), F.when(n == 1, F.lit(" match")).otherwise(F.lit(" matches")), capped)), row(3, F.lit(""))))
    start = F.greatest(F.lit(1).cast("bigint"), at - context)
    bands = shown.select(
        *key, "seq", at.alias("hit"), start.alias("start"), "qualified_name",
        (F.col("last").isNull() | (start > F.col("last") + context + 1)).alias("apart"))
    wanted = bands.select("*", F.explode(F.sequence("start", F.col("hit") + context)).alias("line_no"))
    mark = F.when(at == F.col("hit"), "► ").otherwise("  ")
    around = lines.select("file_id", "line_no", "line").join(wanted, ["file_id", "line_no"])
    body = around.select(*key, (seq + 2 + at - F.col("start")).alias("ord"), F.concat(mark, R.numbered(at, F.col("line"))).alias("text"))
    between = bands.filter("apart").select(*key, (seq + 1).alias("ord"), F.lit("---").alias("text"))
    inside = bands.filter("qualified_name IS NOT NULL").select(
        *key, (seq + _LINES_AROUND - 1).alias("ord"), F.concat(F.lit("  (inside "), "qualified_name", F.lit(")")).alias("text"))
    return D.union([heads.select(*key, F.inline(head)), body, between, inside])
