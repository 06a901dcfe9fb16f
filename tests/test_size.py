"""Plans that stay in proportion to their input, and the cheap tests before patterns."""
import pytest
from pyspark.sql import functions as F

from gistline.functions import patterns as P
from gistline.operators import classify, digest as D, generic, gradle, jest, junit, npm, retrieve as R
from gistline.operators.scan import scan
from gistline.plans import carriers as V, jobs
from gistline.sources.staging import stage
from gistline.streaming import feeds


def test_line_facts_keep_no_copy_of_the_batch(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([("a", 1, "w: /x/A.kt:3:1 Unused"), ("a", 2, "plain")], "log_id string, line_no long, line string")

    def refuse(*_):
        raise AssertionError("the batch is copied")

    monkeypatch.setattr(type(lines), "persist", refuse)
    out = str(tmp_path / "facts")
    feeds.all_line_facts(out)(lines, 0)
    assert feeds.fact_table(spark, out, "clean_lines").count() == 2


ODD = ["", " ", "\t", "\x0b x", "\x0c", "\r", "\x0d y", "\x08", "\x0e", "NPM ERR! code E1", "npm  WARN x", "npm error", " npm error x", "nPm warn deprecated a: b",
       "Added 3 PACKAGES", "removed 1 package", "UPDATED 5 packages", "changed x", "9 vulnerabilities", "0 LOW", ":", "/", "12 tests completed, 1 failed",
       "3 Test completed", "٣ tests completed", "BUILD SUCCESSFUL", "BUILD  FAILED", " BUILD FAILED", "FAILURE: x", "* What went wrong:", "*Try:", "* Try: x",
       "> Task :a FAILED", ">Task :a FAILED ", "> Task FAILED", "e: file:///a.kt:1:2 x", "w:a.kt:1 x", "e:", "E: a.kt:1 x", "a.java:1: error: x", ".java:1: error:",
       "x.java:2: note: x", "PASS a", "PASSED", "FAIL  a", "Tests: 1", " Tests: 1", "Test Suites:1", "Time:", "Summary of all failing tests", "Summary of all failing testsx",
       "  ● a", "●", "x ● y", "a.B > c PASSED"]


@pytest.mark.parametrize("module, chain", [
    (gradle, [("result", P.BUILD_RESULT), ("failure", P.FAILURE_HEADER), ("wrong", P.WRONG_HEADER), ("try", P.TRY_HEADER), ("task", P.TASK), ("kotlin", P.KOTLIN), ("javac", P.JAVAC)]),
    (npm, [("blank", r"\A\z"), ("error", P.NPM_ERROR), ("indented", r"\A\s"), ("deprecated", P.NPM_DEPRECATED), ("warn", P.NPM_WARN), ("change", P.NPM_CHANGE), ("audit", P.NPM_AUDIT)]),
    (jest, [("summary", P.JEST_SUMMARY), ("suites", P.JEST_SUITES), ("tests", P.JEST_TESTS), ("time", P.JEST_TIME), ("pass", P.JEST_PASS), ("fail", P.JEST_FAIL), ("marker", P.JEST_MARKER)]),
    (junit, [("result", P.JUNIT_RESULT), ("totals", P.JUNIT_TOTALS)]),
])
def test_cheap_tests_leave_classes_as_the_patterns_give_them(spark, module, chain):
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(ODD, 1)], "log_id string, line_no long, line string")
    got = {r.line_no: r.line_class for r in module.classify_lines(lines).collect()}
    want = F.lit(None)
    for name, pattern in reversed(chain):
        # The indentation is that of the line, everything else of the line without blanks at its end.
        text = F.col("line") if name == "indented" or module in (jest, junit) else F.rtrim("line", F.lit(P.WHITESPACE))
        text = F.regexp_replace(text, r"\r\z", "") if module in (jest, junit) else text
        want = F.when(text.rlike(pattern), name).otherwise(want)
    for r in lines.select("line_no", "line", want.alias("want")).collect():
        have = got.get(r.line_no)
        assert (have if have in [n for n, _ in chain] else None) == r.want, r


def test_few_references_need_no_index_of_all_words(spark, monkeypatch):
    lines = spark.createDataFrame([(f, i, x) for f in (1, 2) for i, x in enumerate(["a foo", "foo2 b=1", "f(x", "x foo = a.b"], 1)], "file_id long, line_no long, line string")
    asked = [(f, x) for f in (1, 2) for x in ("foo", "f(x", "=", "a.b", "none", "")] + [(1, "b"), (None, "a"), (1, None)]
    requests = spark.createDataFrame(asked, "file_id long, identifier string")

    def found():
        return sorted((r.file_id, r.identifier, r.line_no) for r in R.indexed_references(lines, requests).collect())

    by_index = sorted((r.file_id, r.identifier, r.line_no) for r in R.indexed_references(lines, requests, R.word_index(lines)).collect())
    monkeypatch.setattr(R, "FEW_WORDS", 6)  # file 1 has more
    assert found() == by_index
    monkeypatch.setattr(R, "FEW_WORDS", 256)

    def refuse(*_):
        raise AssertionError("all words are listed")

    monkeypatch.setattr(R, "word_index", refuse)
    assert found() == by_index and (1, "b", 2) in by_index and (2, "=", 2) in by_index


def test_bands_of_references_are_dealt_into_the_sessions_partitions(spark):
    lines = spark.createDataFrame([("a", i, "foo" if i % 3 else "x") for i in range(1, 20)], "log_id string, line_no long, line string")
    assert "REPARTITION_BY_NUM" in R.reference_context(lines, "foo", 1)._jdf.queryExecution().executedPlan().toString()


def test_many_bands_of_references_are_not_broadcast(spark):
    lines = spark.range(60000).selectExpr("id div 100 AS log_id", "id % 100 + 1 AS line_no", "IF(id % 2 = 0, 'foo', 'x') AS line")
    found = R.reference_context(lines, "foo", 1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("part = 1").count() == 600 * (50 * 3 - 1)  # no line stands before the first
    few = R.reference_context(lines.filter("log_id < 10"), "foo", 1)
    assert few.orderBy("log_id", "seq", "line_no", "part").collect() == found.filter("log_id < 10").orderBy("log_id", "seq", "line_no", "part").collect()


def test_lines_stay_where_they_are_when_they_get_their_kind(spark, monkeypatch):
    texts = {"a": ("npm install", "npm error code E1\nadded 3 packages"), "b": ("make", "x\nx\nerror: bad"), "c": ("jest", "")}
    more = ["0 AS exit_code", "false AS timed_out", "5L AS duration_ms"]
    runs = spark.createDataFrame([(k, c) for k, (c, _) in texts.items()] + [(None, "make")], "run_id string, command string").selectExpr("*", *more)
    lines = spark.createDataFrame([(k, i, x) for k, (_, t) in texts.items() if t for i, x in enumerate(t.split("\n"), 1)] + [("lost", 1, "x"), (None, 1, "x")],
                                  "run_id string, line_no long, line string")
    plans = []

    def recorded(df, *by, real=jobs.stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *by)

    monkeypatch.setattr(jobs, "stage", recorded)

    def digests(r):
        del plans[:]
        return sorted(map(str, jobs.distill_run_lines(r, lines).digests.collect())), plans[2]  # after the runs with short lines and the logs

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, plan = digests(runs)
        assert "BroadcastHashJoin" in plan and len(few) == 4
        assert "BroadcastHashJoin" not in digests(runs.unionByName(runs.filter("run_id = 'b'")))[1]
        monkeypatch.setattr(jobs, "FEW_RUNS", 0)
        by_id, plan = digests(runs)
        assert "BroadcastHashJoin" not in plan and by_id == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kinds_are_told_apart_while_the_lines_are_read(spark, monkeypatch):
    lines = stage(spark.createDataFrame([("a", 1, "x", "npm"), ("b", 1, "x", "odd"), ("c", 1, "x", None)], "log_id string, line_no long, line string, kind string"))
    read = {}
    for kind, fn in list(classify.DISTILLERS.items()):
        monkeypatch.setitem(classify.DISTILLERS, kind, lambda df, kind=kind, fn=fn: read.update({kind: df._jdf.queryExecution().executedPlan().toString()}) or fn(df))
    assert sorted((r.log_id, r.kind) for r in classify.distill(lines).collect()) == [("a", "npm"), ("b", "generic"), ("c", "generic")]
    assert "EqualTo(kind,npm)" in read["npm"] and "IsNull(kind)" in read["generic"]


def test_only_long_digests_go_by_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(k, s, i, f"{k}{s}-{i}", "\n") for k, n in (("a", 3), ("b", 40), ("c", 1)) for s in (0, 2) for i in range(n)] + [(None, 0, 0, "x", "\n")],
                                 "log_id string, section int, seq long, text string, glue string")
    sorted_rows = lambda df: sorted(map(tuple, df.select("log_id", "part_no", "body").collect()))
    whole = sorted_rows(D.assemble(rows))
    assert [k for k, _, _ in whole] == ["a", "b", "c"] and whole[0][2] == "a0-0\na0-1\na0-2\na2-0\na2-1\na2-2"
    parts = sorted_rows(D.assemble(rows, part_chars=100))
    assert [r for r in parts if r[0] != "b"] == [whole[0], whole[2]] and "".join(r[2] for r in parts if r[0] == "b") == whole[1][2]
    assert len([r for r in parts if r[0] == "b"]) > 1
    monkeypatch.setattr(D, "PIECE", 16)
    assert sorted_rows(D.assemble(rows)) == whole

    def refuse(*_, **__):
        raise AssertionError("short digests are cut into pieces")

    monkeypatch.setattr(D, "scan", refuse)
    assert sorted_rows(D.assemble(rows.filter("log_id <> 'b'"))) == [whole[0], whole[2]]


def test_short_test_results_keep_their_status(spark, lines_of):
    lines = lines_of({"a": ["x.Y > one PASSED", "x.Y > two > PASSED FAILED ", "  boom", "  at x.Y.two(Y.kt:1)", "x.Y > three SKIPPED", "  not shown"]})
    short, full = junit.facts(lines, short=True), junit.facts(lines)
    assert {r.line_no: r.text for r in short.collect()} == {**{r.line_no: r.text for r in full.collect()}, 1: "PASSED", 5: "SKIPPED"}
    assert junit.junit_counts(short).collect() == junit.junit_counts(full).collect()
    assert junit.failures(short).collect() == junit.failures(full).collect()


def test_items_are_numbered_once_for_all_kinds(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    spark.range(40).selectExpr(
        "id div 3 AS l_orderkey", "CAST(id % 7 + 1 AS int) AS l_linenumber", "id * 7 % 50 AS l_partkey", "id % 2 AS l_suppkey", "CAST(id % 4 AS double) AS l_quantity",
        "1.5D AS l_extendedprice", "timestamp'2020-01-01' AS l_shipdate", "0.1D AS l_discount", "0.2D AS l_tax",
        "substr('RAN', CAST(id % 3 + 1 AS int), 1) AS l_returnflag", "'F' AS l_linestatus").write.parquet(f"{at}/lineitem.parquet")
    spark.range(30).selectExpr("id % 3 AS user_id", "id AS event_id", "IF(id % 2 = 0, 'error', 'click') AS event_type").write.parquet(f"{at}/events.parquet")
    spark.range(30).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey", "substr('FPO', CAST(id % 3 + 1 AS int), 1) AS o_orderstatus").write.parquet(f"{at}/orders.parquet")
    views = {"gradle": V.build_lines, "npm": V.npm_lines, "jest": V.jest_lines, "pytest": V.pytest_lines, "junit": V.junit_lines, "generic": V.generic_lines}
    rows = lambda df: sorted(map(str, df.select("log_id", "line_no", "line").collect()))
    want = {kind: rows(view(spark, at)) for kind, view in views.items()}
    numbered = []
    monkeypatch.setattr(V, "_items", lambda *a, real=V._items: numbered.append(a) or real(*a))
    assert {kind: rows(df) for kind, df in V.lines_by_kind(spark, at).items()} == want and all(want.values())
    assert len(numbered) == 1


def test_cheap_values_do_not_travel(spark, lines_of):
    """The dealt rows hold their own columns alone, and the results are those of values that travel."""
    lines = lines_of({"a": ["x", "1", "y", "2"], "b": ["3", "x"]})
    values = {"before": {"last": F.when(F.col("line") < "x", F.col("line_no"))}, "running": {"n": F.lit(1)}, "total": {"m": F.length("line")}, "span": 2}
    late, early = scan(lines, late=True, **values), scan(lines, **values)
    assert sorted(late.collect()) == sorted(early.collect())
    assert "AS __b_last" not in late._jdf.queryExecution().executedPlan().toString().rsplit("Exchange hashpartitioning(log_id", 1)[1]
    facts = junit.facts(lines_of({"a": ["x.Y > one FAILED", "  boom"]}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(log_id" in facts and "__b_block" not in facts.rsplit("Exchange hashpartitioning(log_id", 1)[1]


def test_lengths_of_notes_do_not_bring_a_log_to_one_task(spark, lines_of, monkeypatch):
    lines = lines_of({"a": ["x", "x", "x", "error: y"], "b": ["z"], "c": ["w", "w"]})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_hint = generic.sized(lines)
        assert "BroadcastHashJoin" in by_hint._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(generic, "FEW_LOGS", 0)
        by_id = generic.sized(lines)
        assert "BroadcastHashJoin" not in by_id._jdf.queryExecution().executedPlan().toString()
        assert sorted(by_hint.collect()) == sorted(by_id.collect()) and by_id.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
