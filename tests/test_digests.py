"""Whole digests of small logs, written for these tests."""

import pytest
from pyspark.sql import functions as F

from gistline.operators import classify, digest as D, generic, gradle, jest, junit, npm, pytest as pytest_logs


def only(df):
    (row,) = df.collect()
    return row


def test_failed_build(lines_of):
    log = "\n".join([
        "> Task :core:compile", "w: file:///w/A.kt:1:2 old call", "w: /w/B.kt:7 old call", "w: /w/C.kt:8:1 unused",
        "e: /w/A.kt:3:4 no such name  ", "/w/Main.java:9: error: missing ;", "> Task :core:compile FAILED", "",
        "FAILURE: Build failed with an exception.", "", "* What went wrong:", "Execution failed for ':core:compile'.",
        "  > see above", "e: /w/A.kt:3:4 not counted here", "", "* Try:", "> Task :late FAILED", "BUILD FAILED in 3s"])
    row = only(gradle.digest(lines_of({"a": log})))
    assert (row.summary, row.outcome, row.part_no) == ("BUILD FAILED (2 errors, 2 warnings)", "failed", 0)
    assert row.body == "\n".join([
        "Duration: 3s", "", "Errors:", "  A.kt:3:4 — no such name", "  Main.java:9 — missing ;", "",
        "Warnings (2 unique, collapsed from 3 occurrences):", "  [×2] old call", "  unused", "", "What went wrong:",
        "  Execution failed for ':core:compile'.", "  > see above", "  e: /w/A.kt:3:4 not counted here", "",
        "Failed tasks: :core:compile, :late"])


def test_build_without_anything(lines_of):
    row = only(gradle.digest(lines_of({"a": "hello"})))
    assert (row.summary, row.body, row.outcome) == ("BUILD (status unknown) (0 errors, 0 warnings)", "", "unknown")


def test_more_than_ten_warnings(lines_of):
    body = only(gradle.digest(lines_of({"a": [f"w: /a.kt:1 m{i}" for i in range(12)] + ["w: /a.kt:2 m11"]}))).body
    assert body.split("\n")[1] == "Warnings (12 unique, collapsed from 13 occurrences, showing top 10):"
    assert body.split("\n")[2:4] == ["  [×2] m11", "  m0"]
    assert body.endswith("  … 2 more unique warnings omitted")


def test_failed_install(lines_of):
    long = "x" * 90
    log = ["npm warn deprecated @a/b@1.2.3: gone", f"npm warn deprecated c@2: {long}", "npm warn deprecated @a/b@9: later",
           "npm warn config old", "npm warn deprecated", "npm ERR! code E404", "npm ERR!", "  at line", "npm ERR! 404 not found", "",
           "  not in a block", "added 3 packages in 2s", "2 vulnerabilities (1 low)", "found 0 vulnerabilities"]
    row = only(npm.digest(lines_of({"a": log})))
    assert row.summary == "npm FAILED (E404)"
    assert row.body == "\n".join([
        "added 3 packages in 2s", "", "Errors:", "  code E404", "  at line", "  404 not found", "", "Deprecated packages (2 unique):",
        "  [×2] @a/b — gone", f"  c — {'x' * 77}...", "", "Other warnings (1 unique):", "  config old", "", "Audit:",
        "  2 vulnerabilities (1 low)"])


def test_clean_installs(lines_of):
    rows = {r.log_id: r for r in npm.digest(lines_of({
        "a": "npm warn deprecated z@1: m\nup to date", "b": "up to date"})).collect()}
    assert rows["a"].summary == "npm OK (1 unique deprecation warnings)"
    assert (rows["b"].summary, rows["b"].body) == ("npm OK", "")


def test_jest(lines_of):
    details = [f"      d{i}" for i in range(25)]
    log = ["PASS src/a.test.ts", "FAIL src/b.test.ts", "  ● B › works", "", *details, "  ● B › short", "    only", "PASS src/c.test.ts",
           "  ● not in a failing suite", "Summary of all failing tests", "FAIL src/b.test.ts", "  ● B › works",
           "Test Suites: 1 failed, 2 passed, 3 total", "Tests:       2 failed, 5 total", "Time:        1.5 s"]
    row = only(jest.digest(lines_of({"a": log})))
    assert row.summary == "Tests: 2 failed, 5 total | Suites: 1 failed, 2 passed, 3 total"
    assert row.body == "\n".join([
        "Test Suites: 1 failed, 2 passed, 3 total", "Tests: 2 failed, 5 total", "Time: 1.5 s", "", "Failed tests (2):", "",
        "  ✗ src/b.test.ts", "    ● B › works", *["    " + d for d in details[:20]], "        … (truncated)", "",
        "  ✗ src/b.test.ts", "    ● B › short", "        only", "", "(2 test suite(s) passed — names collapsed)"])


def test_unparsed_test_output_is_not_called_ok(lines_of):
    row = only(jest.digest(lines_of({"a": "some crash"})))
    assert (row.summary, row.outcome) == ("Tests OK", "unknown")
    row = only(pytest_logs.digest(lines_of({"a": "some crash"})))
    assert (row.summary, row.outcome) == ("pytest OK", "unknown")


def test_pytest(lines_of):
    log = ["=== test session starts ===", "platform linux -- Python 3.12", "t.py .F", "", "=== ERRORS ===", "", "E boom", "", "", "tail", "",
           "=== FAILURES ===", *[f"f{i}" for i in range(130)], "=== warnings summary ===", "ignored", "=== short test summary info ===",
           "FAILED t.py::x  ", "", "=== 1 failed, 2 passed in 0.1s ==="]
    row = only(pytest_logs.digest(lines_of({"a": log})))
    assert row.summary == "pytest: 1 failed, 2 passed in 0.1s"
    assert row.body == "\n".join([
        "platform linux -- Python 3.12", "", "1 failed, 2 passed in 0.1s", "", "ERRORS:", "E boom", "", "tail", "", "FAILURES:",
        *[f"f{i}" for i in range(72)], "… [10 lines omitted] …", *[f"f{i}" for i in range(82, 130)], "", "Short summary:", "  FAILED t.py::x"])


def test_junit(lines_of):
    log = ["a.B > one() PASSED", "a.B > two() FAILED", "    at a.B.f(B.kt:1)", "    boom", "    at org.junit.Assert.fail(A.java:1)",
           *[f"    at a.B.g(B.kt:{i})" for i in range(6)], "    Caused by: x", "", "    outside", "a.C > three SKIPPED",
           "3 tests completed, 1 failed, 1 skipped"]
    row = only(junit.digest(lines_of({"a": log})))
    assert row.summary == "junit: 3 tests completed, 1 failed, 1 skipped"
    assert row.body == "\n".join([
        "3 tests completed, 1 failed, 1 skipped", "", "Failed tests (1):", "", "  ✗ a.B > two()", "    boom", "    Caused by: x",
        "    at a.B.f(B.kt:1)", *[f"    at a.B.g(B.kt:{i})" for i in range(4)], "    … 2 more app frames omitted", "",
        "(1 passed, 1 skipped — names collapsed)"])


def test_junit_without_tests_is_a_build(lines_of):
    rows = {r.log_id: r for r in junit.digest(lines_of({"a": "BUILD SUCCESSFUL in 1s", "b": "x.Y > z PASSED"})).collect()}
    assert (rows["a"].kind, rows["a"].body) == ("gradle", "Duration: 1s")
    assert (rows["b"].kind, rows["b"].summary) == ("junit", "junit: 1 passed")


def test_generic(lines_of):
    log = ["start", *["tick"] * 10, "NullPointerException in errors", "Fatal: stop", "end"]
    row = only(generic.digest(lines_of({"a": log})))
    assert row.summary == "Command output (1 error-matching lines)"
    assert row.body == "\n".join(["Error-matching lines (1):", "Fatal: stop", "", "start", "tick", "  … (repeated 10×)",
                                  "NullPointerException in errors", "Fatal: stop", "end"])


def test_generic_middle(lines_of):
    log = [f"line number {i}" for i in range(1000)]
    got = [r.line for r in generic.middle_truncate(lines_of({"a": log}), 2000, span=64).orderBy("ord").collect()]
    assert got == log[:300] + ["… [200 lines omitted] …"] + log[500:]


def test_accounting_and_response(spark, lines_of):
    digests = gradle.digest(lines_of({"a": ["x" * 37, "BUILD SUCCESSFUL in 1s"]}))
    acc = only(D.account(digests))
    assert (acc.original_tokens, acc.compressed_tokens) == (15, 3)
    runs = spark.createDataFrame([("a", 0, False, 12)], "log_id string, exit_code int, timed_out boolean, duration_ms bigint")
    text = only(D.format_response(digests, runs)).response
    assert text == ('BUILD SUCCESSFUL (0 errors, 0 warnings) [OK, 12ms]\n\nDuration: 1s\n\n---\n'
                    '[Compressed from ~15 tokens → ~3 tokens (80% reduction)]\n[Full log stored as log_id="a"]')
    report = {r.kind: r for r in D.reduction_report(D.account(digests), "kind").collect()}
    assert report[None].reduction_pct == report["gradle"].reduction_pct == 80.0


CASES = [
    ("./gradlew assembleDebug", "", "gradle"), ("gradle :app:testDebug", "", "junit"), ("make", "BUILD FAILED", "gradle"),
    ("pytest -q", "", "pytest"), ("run", "== test session starts ==", "pytest"), ("npx jest", "", "jest"), ("vitest", "", "jest"),
    ("ci", "x\nPASS a.ts\nTests: 1", "jest"), ("ci", "PASS a.ts", "generic"), ("npm i", "", "npm"), ("yarn", "", "npm"),
    ("x", "npm WARN old", "npm"), ("x", "a.B > c PASSED", "junit"), ("npm t", "a.B > c FAILED now", "junit"), ("mynpm", "", "generic"),
    ("x", "a.B > c PASSEDX", "generic"), ("echo", "hi", "generic"), ("énpm", "", "npm"),
]


@pytest.mark.parametrize("command, head, kind", CASES)
def test_classify(spark, command, head, kind):
    df = spark.createDataFrame([(command, head)], "command string, head string")
    assert df.select(classify.kind_of()).first()[0] == kind


def test_registered_distiller(spark, lines_of):
    def shout(lines):
        text = lines.groupBy("log_id").agg(F.max(F.upper("line")).alias("body"))
        return text.select("log_id", F.lit("loud").alias("kind"), F.lit(0).cast("bigint").alias("part_no"), F.lit("s").alias("summary"),
                           "body", F.lit(1).cast("bigint").alias("original_tokens"), F.lit("ok").alias("outcome"))

    classify.register_distiller("loud", F.col("command") == "shout", shout)
    try:
        df = spark.createDataFrame([("shout", "")], "command string, head string")
        assert df.select(classify.kind_of()).first()[0] == "loud"
        lines = lines_of({"a": "hey"}).withColumn("kind", F.lit("loud"))
        assert only(classify.distill(lines)).body == "HEY"
    finally:
        classify.DISTILLERS.pop("loud")
        classify._PREDICATES.clear()


def test_generic_deals_the_lines_once(spark, tmp_path):
    """Border rows, runs, numbers and counts come from one shuffle of the lines; what else is shuffled are span summaries."""
    path = str(tmp_path / "lines")
    spark.range(400).selectExpr("id % 3 AS log_id", "id div 3 + 1 AS line_no", "concat('line ', id div 7) AS line").write.parquet(path)
    found = generic._runs(spark.read.parquet(path), 16)
    assert found.count() and found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in final.split("\n") if "Exchange hashpartitioning" in x and "__span" in x and "ReusedExchange" not in x]
    assert len(dealt) == 1


def test_digest_rows_need_no_interpreted_filter(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, None, 0)], "log_id long, text string, n int")
    rows = D.rows_of(df, D.row(0, 1, F.col("text")), F.when(F.col("n") > 0, D.row(1, 2, "more")))
    assert sorted(tuple(r) for r in rows.collect() if r.log_id == 1) == [(1, 0, 1, "x", "\n"), (1, 1, 2, "more", "\n")]
    assert [tuple(r) for r in rows.filter("log_id = 2").collect()] == [(2, 0, 1, None, "\n")]
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()
