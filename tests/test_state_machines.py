"""Random logs: the span-based operators against plain loops, with spans far smaller than the logs."""

import random

import pytest
from pyspark.sql import functions as F

from gistline.operators import generic, gradle, jest, junit, npm, pytest as pytest_logs, symbols
from tests import loops

SPANS = [2, 5, None]


def logs(seed, words, n=60):
    rng = random.Random(seed)
    return {f"log{k}": [rng.choice(words) for _ in range(rng.randint(1, n))] for k in range(6)}


@pytest.mark.parametrize("span", SPANS)
def test_gradle_note(lines_of, span):
    data = logs(1, ["FAILURE: x", "* What went wrong:", "* Try:", "BUILD FAILED in 2s", "  a detail", "", "w: /a.kt:1 m", "> Task :a FAILED"])
    got = gradle.facts(lines_of(data), details=True, span=span).filter("fact = 'detail'")
    assert sorted((r.log_id, r.line_no, r.text.strip()) for r in got.collect()) == sorted(
        (k, *x) for k, v in data.items() for x in loops.gradle_note(v))


@pytest.mark.parametrize("span", SPANS)
def test_npm_error_blocks(lines_of, span):
    data = logs(2, ["npm ERR! code E1", "npm error", "npm error  spaced ", "   indented", "", "npm warn deprecated a@1: b", "other", "\tTab"])
    got = npm.npm_errors(npm.facts(lines_of(data), span=span))
    assert sorted((r.log_id, r.line_no, r.text) for r in got.collect()) == sorted(
        (k, *x) for k, v in data.items() for x in loops.npm_errors(v))


@pytest.mark.parametrize("span", SPANS)
def test_jest_blocks(lines_of, span):
    data = logs(3, ["PASS a.ts", "FAIL b.ts (5ms)", "  ● t › u", "   detail", "", "Tests: 1 failed", "detail 2", "FAIL c.ts"], 80)
    for k in ("log1", "log4"):
        data[k].insert(len(data[k]) // 2, "Summary of all failing tests")
    facts = jest.facts(lines_of(data), details=True, span=span)
    titles = {k: loops.jest_blocks(v) for k, v in data.items()}
    assert sorted((r.log_id, r.block, r.suite) for r in jest.jest_failures(facts).collect()) == sorted(
        (k, *x) for k, (t, _) in titles.items() for x in t)
    assert sorted((r.log_id, r.block, r.line_no) for r in facts.filter("fact = 'detail'").collect()) == sorted(
        (k, *x) for k, (_, d) in titles.items() for x in d)


@pytest.mark.parametrize("span", SPANS)
def test_pytest_sections_and_blocks(lines_of, span):
    data = logs(4, ["=== FAILURES ===", "=== ERRORS ===", "== short test summary info ==", "=== 1 failed ===", "=== other ===",
                    "=====", "text", "more", "", "", "platform linux"], 90)
    facts = pytest_logs.facts(lines_of(data), span=span)
    assert sorted((r.log_id, r.line_no, r.section) for r in pytest_logs.pytest_sections(facts).collect()) == sorted(
        (k, *x) for k, v in data.items() for x in loops.pytest_sections(v))
    got = {}
    for r in pytest_logs.pytest_blocks(facts, {"errors": 4, "failures": 5}, span=span).orderBy("log_id", "section", "seq").collect():
        got.setdefault((r.log_id, r.section), []).append(r.line)
    want = {}
    for k, v in data.items():
        for section, cap in (("errors", 4), ("failures", 5)):
            kept = loops.trimmed([v[no - 1] for no, s in loops.pytest_sections(v) if s == section], cap)
            if kept:
                want[k, section] = kept
    assert got == want


@pytest.mark.parametrize("span", SPANS)
def test_junit_blocks(lines_of, span):
    data = logs(5, ["a.B > c FAILED", "a.B > d() PASSED", "2 tests completed, 1 failed", "", "   message", "  at org.junit.X(Y)",
                    "  at a.b.C(D.kt:1)", "at java.base/jdk.internal.X"], 80)
    facts = junit.facts(lines_of(data), span=span)
    assert sorted((r.log_id, r.block, r.line_no) for r in junit.failure_lines(facts).collect()) == sorted(
        (k, *x) for k, v in data.items() for x in loops.junit_blocks(v))


@pytest.mark.parametrize("span", SPANS)
def test_merged_lines(lines_of, span):
    data = logs(6, ["a", "a", "b", ""], 50)
    got = {}
    for r in generic.dedupe_consecutive(lines_of(data), span=span).orderBy("log_id", "seq").collect():
        got.setdefault(r.log_id, []).append(r.line)
    assert got == {k: loops.merged(v) for k, v in data.items()}


@pytest.mark.parametrize("span", SPANS)
def test_pack_focus(spark, span):
    rng = random.Random(8)
    data = {f: [(rng.choice([5, 30, 90, 250, 600]), rng.randint(1, 40)) for _ in range(25)] for f in range(5)}
    df = spark.createDataFrame(
        [(f, f"s{i:02d}", i + 1, i + 1, *c) for f, v in data.items() for i, c in enumerate(v)],
        "file_id int, qualified_name string, line_lo bigint, line_hi bigint, cost bigint, outline_cost bigint")
    got = {}
    for r in symbols.pack_focus(df, 900, span=span).orderBy("file_id", "seq").collect():
        got.setdefault(r.file_id, []).append(r.seq - 1)
    assert got == {f: loops.packed(v, 900) for f, v in data.items() if loops.packed(v, 900)}


def test_result_does_not_depend_on_partitions(spark, lines_of):
    data = logs(9, ["a", "b", "Error: x", "a"], 40)
    results = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, generic.digest(lines_of(data)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_every_error_stays_in_the_digest(lines_of):
    data = {"x": [f"e: /src/F{i}.kt:{i}:2 broken {i}" for i in range(1, 300)] + ["BUILD FAILED in 1s"]}
    (row,) = gradle.digest(lines_of(data)).collect()
    assert row.summary == "BUILD FAILED (299 errors, 0 warnings)"
    assert all(f"  F{i}.kt:{i}:2 — broken {i}\n" in row.body + "\n" for i in range(1, 300))


def test_long_digests_come_in_parts(spark, monkeypatch):
    from gistline.operators import digest as D

    rows = spark.range(1, 401).select(
        F.lit("x").alias("log_id"), F.lit(0).alias("section"), F.col("id").alias("seq"),
        F.format_string("line %d", "id").alias("text"), F.lit("\n").alias("glue"))
    monkeypatch.setattr(D, "PIECE", 16)
    parts = D.assemble(rows, part_chars=500).orderBy("part_no").collect()
    assert len(parts) > 3
    assert "".join(p.body for p in parts) == "\n".join(f"line {i}" for i in range(1, 401))


@pytest.mark.parametrize("span", [2, None])
def test_junit_numbers_from_the_scan(lines_of, span):
    """Numbers of a block's messages and frames, taken from running counts, are those of a numbering by block."""
    data = logs(9, ["a.B > c FAILED", "a.B > d() PASSED", "3 tests completed, 1 failed", "", "   message", "  at org.junit.X(Y)",
                    "  at com.app.A.b(A.kt:3)", "java.lang.Error"])
    lines = lines_of(data)
    plain, numbered = junit.facts(lines, span=span), junit.facts(lines, span=span, numbered=True)
    for operator in (junit.junit_failures, junit.junit_app_frames):
        want, got = operator(plain), operator(numbered)
        assert want.schema.simpleString() == got.schema.simpleString()
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect())) != []
