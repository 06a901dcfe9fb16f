"""Queries by name: carrier in, operator applied. Wiring only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistline.functions import text as T
from gistline.operators import (
    classify as C, digest as D, generic, gradle, jest, junit, lexical, npm, pytest, retrieve as R, symbols as S)
from gistline.plans import carriers as V, jobs
from gistline.sources import code, logs, store
from gistline.sources.staging import new_folder, stage
from gistline.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _over(carrier: Query, **operators: Callable[[DataFrame], DataFrame]) -> None:
    for name, op in operators.items():
        QUERIES[name] = lambda spark, sf_dir, op=op: op(carrier(spark, sf_dir))


# Sources, stores, scalars.
QUERIES["explode_lines"] = V.log_lines
_over(
    V.runs,
    combine_streams=lambda r: r.select("log_id", T.combine_streams(
        F.when(F.col("log_id") % 3 == 0, "").otherwise(F.col("head")), "command").alias("text")),
    log_ids=lambda r: r.select(F.col("log_id").alias("run"), store.log_id("command", F.col("log_id"), "head").alias("log_id")),
    run_status=lambda r: r.select("log_id", T.run_status("timed_out", "exit_code").alias("status")),
    classify=lambda r: r.select("log_id", C.classify().alias("kind")),
    can_handle=lambda r: r.select("log_id", *[c.alias(k) for k, c in C.can_handle().items()]),
    prune_expired=lambda r: store.count_expired(r, r.agg(F.max("ended_at")).scalar()),
)


@query
def missing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_logs(V.runs(spark, sf_dir), V.log_lines(spark, sf_dir))


@query
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("log_id"), T.estimate_tokens("text").alias("tokens"))


_over(V.ansi_text, strip_ansi=lambda a: a.select("event_id", T.strip_ansi("raw").alias("text")))
_over(V.project_files, detect_build_tool=C.detect_build_tool, detect_test_framework=C.detect_test_framework)

# Distillers.
_over(V.build_lines, gradle_summary=gradle.gradle_summary, build_result=gradle.build_result, gradle_digest=gradle.digest)
_over(
    lambda spark, sf_dir: gradle.facts(V.build_lines(spark, sf_dir)),
    kotlin_diagnostics=gradle.kotlin_diagnostics, javac_diagnostics=gradle.javac_diagnostics,
    failed_tasks=gradle.failed_tasks, gradle_warnings_topk=gradle.warnings_topk)
_over(V.build_lines, what_went_wrong=lambda b: gradle.what_went_wrong(gradle.facts(b, details=True)))
_over(V.npm_lines, npm_errors=lambda n: npm.npm_errors(npm.facts(n)), npm_summary=npm.npm_summary, npm_digest=npm.digest)
_over(
    lambda spark, sf_dir: npm.stateless_facts(V.npm_lines(spark, sf_dir)),
    npm_error_code=npm.npm_error_code, npm_deprecations=npm.npm_deprecations,
    npm_other_warnings=npm.npm_other_warnings, npm_changes=npm.npm_changes, npm_audit=npm.npm_audit)
_over(
    V.generic_lines,
    dedupe_consecutive=generic.dedupe_consecutive, error_lines=generic.error_lines,
    middle_truncate=generic.middle_truncate, generic_digest=lambda g: generic.digest(stage(g)))
_over(
    V.jest_lines,
    jest_suites=lambda j: jest.jest_suites(jest.stateless_facts(j)),
    jest_failures=lambda j: jest.jest_failures(jest.facts(j)), jest_totals=jest.jest_totals,
    jest_failure_details=lambda j: jest.jest_failure_details(jest.facts(j, details=True)), jest_digest=lambda j: jest.digest(stage(j)))
_over(
    V.pytest_lines,
    pytest_sections=lambda p: pytest.pytest_sections(pytest.facts(p)), pytest_result=pytest.pytest_result,
    pytest_blocks=lambda p: pytest.pytest_blocks(stage(pytest.facts(p)), {"errors": 30, "failures": 30}),
    pytest_short_summary=lambda p: pytest.pytest_short_summary(pytest.facts(p)), pytest_digest=pytest.digest)
_over(
    V.junit_lines,
    junit_results=lambda j: junit.junit_results(junit.stateless_facts(j)),
    junit_counts=lambda j: junit.junit_counts(junit.stateless_facts(j)),
    junit_failures=lambda j: junit.junit_failures(junit.facts(j, numbered=True)),
    junit_app_frames=lambda j: junit.junit_app_frames(junit.facts(j, numbered=True)), junit_digest=lambda j: junit.digest(stage(j)))


@query
def junit_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test and build logs together: only the build logs fall back."""
    tests = V.junit_lines(spark, sf_dir).withColumn("log_id", -F.col("log_id") - 1)
    return junit.junit_fallback(stage(tests.unionByName(V.build_lines(spark, sf_dir))))


@query
def digest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.account(gradle.digest(V.build_lines(spark, sf_dir)))


@query
def reduction_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(spark, sf_dir).select(
        "log_id", T.reduction_pct("original_tokens", "compressed_tokens").alias("pct"))


_BY_KIND = {"gradle": V.build_lines, "npm": V.npm_lines, "jest": V.jest_lines, "pytest": V.pytest_lines,
            "junit": V.junit_lines, "generic": V.generic_lines}


@query
def distill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distill(stage(D.union([
        lines.withColumn("kind", F.lit(kind)) for kind, lines in V.lines_by_kind(spark, sf_dir).items()])))


_COMMANDS = {"gradle": "./gradlew build", "npm": "npm install", "jest": "npx jest", "pytest": "pytest -q",
             "junit": "./gradlew test", "generic": "make all"}


@query
def distill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over runs of all kinds, each log as lines."""
    run = F.concat(F.col("kind"), F.lit(":"), F.col("log_id").cast("string")).alias("run_id")
    lines = stage(D.union([lines.withColumn("kind", F.lit(kind)) for kind, lines in V.lines_by_kind(spark, sf_dir).items()]).select("kind", run, "line_no", "line"))
    command = F.create_map(*[F.lit(x) for item in _COMMANDS.items() for x in item])
    runs = lines.select("kind", "run_id").distinct().select("run_id", F.element_at(command, F.col("kind")).alias("command"))
    done = jobs.distill_run_lines(runs.withColumns({
        "exit_code": F.lit(0), "timed_out": F.lit(False), "duration_ms": F.lit(1).cast("bigint")}), lines.drop("kind"))
    return done.by_run.select(
        "run_id", "kind", "part_no", "summary", "body", "original_tokens", "outcome")


@query
def format_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.format_response(gradle.digest(V.build_lines(spark, sf_dir)), V.runs(spark, sf_dir))


@query
def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = D.account(gradle.digest(V.build_lines(spark, sf_dir))).unionByName(
        D.account(generic.digest(stage(V.generic_lines(spark, sf_dir)))))
    runs = V.runs(spark, sf_dir).select("log_id", T.run_status("timed_out", "exit_code").alias("status"))
    return D.reduction_report(accounts.join(runs, "log_id"), "kind", "status")


# Retrieval.
@query
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of stored logs by id, two of three of them stored."""
    docs = V.table(spark, sf_dir, "documents")
    name, folder = F.concat(F.lit("log"), F.col("doc_id").cast("string")), new_folder(spark)
    store.write_log_store(docs.filter("doc_id % 3 <> 1").select(
        name.alias("log_id"), F.lit("generic").alias("kind"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") % 3 * 86400).alias("ended_at"), "text"), folder)
    return jobs.read_log_sections(docs.select(name.alias("log_id")), folder, "than", 2, max_tokens=200)


WORD = "and"
_over(
    V.log_lines,
    grep_context=lambda t: R.grep_context(t, "than", 2),
    cap_tokens=lambda t: R.read_log_section(t, "than", 2, max_tokens=200),
    slice_lines=lambda t: R.slice_lines(t, 3, 8),
    find_references=lambda t: R.find_references(t, WORD),
    reference_context=lambda t: R.reference_context(t, WORD),
    head_tail=lambda t: R.head_tail(t, small=20, head=3, tail=3),
)
_over(V.build_lines, head_lines=R.head_lines)

# Source files.
_over(
    V.source_files,
    source_profile=code.profile,
    language_counts=code.language_counts,
    file_ids=lambda f: f.select("file_key", code.file_id("path", "mtime_ms", "size_bytes").alias("file_id")),
    changed_files=lambda f: code.select_changed(f, _stored(f)).select("file_key", "file_id"),
    read_mode=lambda f: code.read_mode(_requests(code.profile(f))).select("file_key", "returned"),
)


@query
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of every file, from a line store of small blocks."""
    files, folder = V.source_files(spark, sf_dir), new_folder(spark)
    logs.write_line_store(logs.explode_lines(files, "source_text", "file_key"), folder, 16)
    sizes = logs.stored_files(spark, folder).withColumnRenamed("log_id", "file_key")
    lines = logs.stored_lines(spark, folder, 2, 60).withColumnRenamed("log_id", "file_key")
    return R.read_lines(files.join(sizes, "file_key"), lines, 2, 60, max_tokens=200)


def _stored(files: DataFrame) -> DataFrame:
    """Ids of an earlier run that saw two files of three, some of them in an older version."""
    key = F.col("file_key")
    mtime = F.when(key % 7 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms"))
    return files.filter(key % 3 != 0).select(code.file_id("path", mtime, "size_bytes").alias("file_id"))


def _requests(profiled: DataFrame) -> DataFrame:
    key = F.col("file_key")
    return profiled.withColumns({
        "mode": F.when(key % 3 == 0, "outline").when(key % 3 == 1, "full").otherwise("auto"),
        "focus": F.when(key % 2 == 0, "x"), "focus_hits": key % 4,
        "parse_status": F.when(F.col("language").isNull(), "failed").otherwise("ok")})


@query
def symbol_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols, written to a store as JSON and read back."""
    folder = new_folder(spark)
    symbols = V.symbols(spark, sf_dir).withColumns({
        "modifiers": F.when(F.col("line_lo") % 3 == 0, F.array()).otherwise(F.array(F.lit("open"), F.col("kind"))),
        "doc": F.when(F.col("line_lo") % 2 == 0, F.concat(F.lit('/** "'), F.col("name"), F.lit('"\n */')))})
    store.write_symbol_store(symbols, folder)
    return store.read_symbol_store(spark, folder).withColumn("modifiers", F.array_join("modifiers", " "))


# Symbols.
FOCI = ["NATION_2", "00[12]$|_7"]
_over(
    V.symbols,
    flatten_symbols=S.flatten_symbols,
    symbol_paths=S.symbol_paths,
    list_symbols=lambda s: S.list_symbols(s, ["class", "field"]),
    match_focus=lambda s: D.union([
        S.match_focus(s, f).select("file_id", "qualified_name", F.lit(f).alias("focus"), "exact") for f in FOCI]),
    outline=S.outline,
    pack_focus=lambda s: S.pack_focus(
        s.withColumn("cost", F.col("line_hi") - F.col("line_lo") + 1).withColumn("outline_cost", F.lit(10)), 800,
    ).select("file_id", "seq", "qualified_name", "oversized", "spent"),
    structural_outline=S.structural_outline,
    focused_missing=lambda s: S.focused_missing(s, s.filter("kind = 'field'")),
)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for symbols: customers and nations (many in the wrong file), nation paths, regions."""
    customer, nation = V.table(spark, sf_dir, "customer"), V.table(spark, sf_dir, "nation")
    region = V.table(spark, sf_dir, "region")
    paths = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    return D.union([
        customer.select((F.col("c_custkey") % 5).alias("file_id"), F.col("c_name").alias("requested")),
        nation.select((F.col("n_nationkey") % 5).cast("bigint").alias("file_id"), F.col("n_name").alias("requested")),
        paths.select(F.col("n_regionkey").cast("bigint").alias("file_id"), F.concat_ws(".", "r_name", "n_name").alias("requested")),
        region.select(F.col("r_regionkey").cast("bigint").alias("file_id"), F.col("r_name").alias("requested")),
    ]).distinct()


@query
def read_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.read_symbols(V.symbols(spark, sf_dir), _names(spark, sf_dir))
    return found.select("file_id", "requested", "header", "note")


@query
def symbols_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.symbols_not_found(V.symbols(spark, sf_dir), _names(spark, sf_dir))


@query
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.enclosing_symbol(V.ident_hits(spark, sf_dir), V.symbols(spark, sf_dir))


@query
def outline_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = S.outline_tokens(S.outline(V.symbols(spark, sf_dir)))
    files = V.source_files(spark, sf_dir).select(
        F.col("file_key").alias("file_id"), T.estimate_tokens("source_text").alias("full_tokens"))
    return shown.join(files, "file_id").withColumn("reduction_pct", T.reduction_pct_1("full_tokens", "returned_tokens"))


# Declarations.
_over(
    V.code_lines,
    lexical_symbols=lambda c: lexical.lexical_symbols(stage(c)).withColumn("modifiers", F.array_join("modifiers", " ")),
    leading_doc=lambda c: lexical.leading_doc(stage(c)),
    parse_status=lexical.parse_status,
)
_over(V.bracket_lines, parse_errors=lexical.parse_errors)


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file its class, a member with more than a word, a sign, a common word and one that is nowhere."""
    doc = F.col("doc_id")
    name = F.concat(F.lit("Doc"), doc.cast("string"))
    asked = F.array(name, F.lit("f2(x"), F.lit("f2"), F.lit("="), F.lit("and"), F.lit("nowhere"))
    return V.table(spark, sf_dir, "documents").select(
        doc.alias("file_id"), F.concat(F.lit("/src/"), doc.cast("string")).alias("path"), F.explode(asked).alias("identifier"))


@query
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over a table of identifiers, with the symbols around the hits."""
    lines = stage(V.code_lines(spark, sf_dir))
    return jobs.find_references(lines, _identifiers(spark, sf_dir), stage(lexical.lexical_symbols(lines)), limit=20)


@query
def symbol_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's class by name, members by name and path, and one that is missing, with docs and bodies."""
    doc = F.col("doc_id")
    name = F.concat(F.lit("Doc"), doc.cast("string"))
    asked = F.array(name, F.lit("f2"), F.concat(name, F.lit(".t1")), F.concat(name, F.lit(".T4")), F.lit("nowhere"))
    requests = V.table(spark, sf_dir, "documents").select(doc.alias("file_id"), F.explode(asked).alias("requested"))
    return jobs.read_symbols(stage(V.code_lines(spark, sf_dir)), requests)


# Streams.
def _streamed(spark: SparkSession, lines: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    landed = new_folder(spark)
    lines.write.parquet(landed)
    result = operator(feeds.read_feed(spark, landed, lines.schema))
    return feeds.drain(result, new_folder(spark), new_folder(spark))


@query
def stream_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, V.build_lines(spark, sf_dir), feeds.stream_facts)


@query
def stream_fact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stateless facts of a feed with build, install and test lines, from the tables that one stream wrote."""
    parts = [view(spark, sf_dir).select(F.concat(F.lit(f"{kind}:"), F.col("log_id").cast("string")).alias("log_id"), "line_no", "line")
             for kind, view in _BY_KIND.items() if kind in ("gradle", "npm", "junit")]
    landed, out = new_folder(spark), new_folder(spark)
    D.union(parts).write.parquet(landed)
    feed = feeds.read_feed(spark, landed, parts[0].schema)
    feeds.drain_batches(feed, feeds.all_line_facts(out), new_folder(spark))
    texts = {"kotlin_diagnostics": "message", "javac_diagnostics": "message", "npm_changes": "text", "junit_results": "test", "clean_lines": "line"}
    return D.union([feeds.fact_table(spark, out, name).select(F.lit(name).alias("fact"), "log_id", "line_no", F.col(c).alias("text")) for name, c in texts.items()])


@query
def stream_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, V.runs(spark, sf_dir), feeds.stream_kinds)


@query
def stream_warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, V.timed_build_lines(spark, sf_dir), feeds.stream_warning_counts)
