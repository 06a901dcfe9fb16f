import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gistline.functions import text as T
from gistline.operators import classify as C, gradle
from gistline.sources import code, logs, staging, store
from gistline.streaming import feeds


def value(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("n, tokens", [(0, 0), (1, 1), (16, 4), (17, 5)])
def test_tokens(spark, n, tokens):
    assert value(spark, T.estimate_tokens("x"), x="a" * n) == tokens


def test_utf16_tokens(spark):
    assert value(spark, T.estimate_tokens("x"), x="aa😀😀") == 1
    assert value(spark, T.estimate_tokens("x", utf16=True), x="aa😀😀") == 2


@pytest.mark.parametrize("orig, comp, pct", [(1000, 64, 94), (200, 199, 1), (200, 201, 0), (200, 203, -1), (0, 5, 0), (10, 20, -100)])
def test_reduction(spark, orig, comp, pct):
    assert value(spark, T.reduction_pct("o", "c"), o=orig, c=comp) == pct


def test_text_helpers(spark):
    assert value(spark, T.strip_ansi("x"), x="\x1b[31mred\x1b[0m \x1b]0;t\x07ok\x1b[2K") == "red ok"
    assert value(spark, T.trim("x"), x="﻿\t a b \r\n") == "a b"
    assert [value(spark, T.is_blank("x"), x=x) for x in ("", " \t\u00a0", " a ")] == [True, True, False]
    assert value(spark, T.strip_version("x"), x="@s/p@1.0") == "@s/p"
    assert value(spark, T.strip_version("x"), x="@s/p") == ""
    assert value(spark, T.basename("x"), x="/a/b/c.kt") == "c.kt"
    assert value(spark, T.ellipsize("x"), x="y" * 81) == "y" * 77 + "..."
    assert value(spark, T.compact_ws("x"), x=" fun  f(\n a ) {") == "fun f( a )"
    assert value(spark, T.combine_streams("a", "b"), a="", b="e") == "e"
    assert value(spark, T.combine_streams("a", "b"), a="o", b="e") == "o\ne"
    assert T.regex_escape("a.b(c)") == r"a\.b\(c\)"
    assert value(spark, T.regex_escape_col("x"), x="a.b(c)") == r"a\.b\(c\)"


def test_log_files_of_any_size(spark, tmp_path):
    texts = {"a.log": "one\n\ntwo\n", "b.log": "no newline at the end", "c.log": "".join(f"line {i}\n" for i in range(3000)) + "é"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = logs.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = logs.explode_lines(logs.read_logs(spark, str(tmp_path))).collect()
    assert sorted(split) == sorted(whole) and len(whole) == 4 + 1 + 3001


def test_retention_removes_data(spark, tmp_path):
    now, path = dt.datetime(2024, 5, 20, 12), str(tmp_path / "logs")
    ages = {"new": 1, "border_new": 6.9, "border_old": 7.1, "old": 8, "older": 30}
    rows = [(k, kind, now - dt.timedelta(days=d), k) for k, d in ages.items() for kind in ("npm", "jest")]
    store.write_log_store(spark.createDataFrame(rows, "log_id string, kind string, ended_at timestamp, text string"), path)
    assert store.prune_log_store(spark, path, F.lit(now)) == 4
    assert sorted(r.text for r in store.read_log_store(spark, path).collect()) == sorted(["new", "border_new"] * 2)
    assert store.prune_log_store(spark, path, F.lit(now)) == 0 and store.read_log_store(spark, path).count() == 4


def test_a_prune_that_fails_loses_no_log(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "store"), dt.datetime(2024, 5, 10, 12)
    rows = [(f"{k}{i}", "npm", now - dt.timedelta(days=d), k) for k, d in {"new": 1, "border_new": 6.9, "border_old": 7.1, "old": 8}.items() for i in range(5)]
    store.write_log_store(spark.createDataFrame(rows, "log_id string, kind string, ended_at timestamp, text string"), path)
    remove, calls = store._remove, []

    def fails(spark, paths):
        calls.append(paths)
        if len(calls) == 2:
            raise OSError("lost")
        remove(spark, paths)

    monkeypatch.setattr(store, "_remove", fails)
    with pytest.raises(OSError):
        store.prune_log_store(spark, path, F.lit(now))
    stay = {f"{k}{i}" for k in ("new", "border_new") for i in range(5)}
    assert stay <= {r.log_id for r in store.read_log_store(spark, path).collect()}
    assert store.prune_log_store(spark, path, F.lit(now)) == 0
    assert sorted(r.log_id for r in store.read_log_store(spark, path).collect()) == sorted(stay)


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "w: /x/A.kt:3:1 Unused"), ("a", 2, "added 3 packages in 2s"), ("a", 3, "a.B > works PASSED"),
                                   ("a", 4, "B.java:7: error: no"), ("a", 5, "\x1b[31mred\x1b[0m")], "log_id string, line_no long, line string")
    out = str(tmp_path / "facts")
    run = feeds.all_line_facts(out)
    run(lines, 0)
    run(lines.limit(0), 1)
    run(lines, 0)  # the same batch once more, as after a failure
    counts = {name: feeds.fact_table(spark, out, name).count() for name in feeds.LINE_FACTS}
    assert counts == {"kotlin_diagnostics": 1, "javac_diagnostics": 1, "npm_changes": 1, "junit_results": 1, "clean_lines": 5}
    assert [r.line for r in feeds.fact_table(spark, out, "clean_lines").filter("line_no = 5").collect()] == ["red"]


def test_log_store(spark, tmp_path):
    day = dt.datetime(2024, 5, 1, 12)
    df = spark.createDataFrame([("a", "npm", day, "x"), ("b", "jest", day - dt.timedelta(days=8), "y")],
                               "log_id string, kind string, ended_at timestamp_ntz, text string")
    path = str(tmp_path / "store")
    store.write_log_store(df, path)
    wanted = spark.createDataFrame([("a",), ("z",)], "log_id string")
    assert [r.text for r in store.read_log_store(spark, path, wanted).collect()] == ["x"]
    assert [r.error for r in store.missing_logs(wanted, store.read_log_store(spark, path)).collect()] == ['[error] log_id "z" not found']
    one = store.read_stored_log(spark, path, "a")
    assert [r.text for r in one.collect()] == ["x"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "id_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert store.count_expired(df, F.lit(day)).first()[0] == 1
    assert store.count_expired(df, F.lit(day - dt.timedelta(days=1))).first()[0] == 0
    assert [r.log_id for r in store.kept(df, F.lit(day)).collect()] == ["a"]


def test_log_ids(spark):
    first = value(spark, store.log_id("k", "x"), k="py-test-long-name", x="t")
    assert first == "pytestlo_" + hashlib.sha256(b"t").hexdigest()[:12]
    assert value(spark, store.log_id("k", "x"), k="--", x="t").startswith("log_")


def test_source_files(spark, tmp_path):
    (tmp_path / "A.KT").write_text("class A\n")
    (tmp_path / "README").write_text("x")
    files = code.read_sources(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in code.profile(files).collect()}
    assert (got["A.KT"].language, got["A.KT"].line_count, got["A.KT"].token_estimate) == ("kotlin", 2, 2)
    assert got["README"].language is None and got["README"].file_id.startswith("txt_")
    stored = code.profile(files).select("file_id")
    assert code.select_changed(files, stored).count() == 0
    assert code.select_changed(files.withColumn("size_bytes", F.col("size_bytes") + 1), stored).count() == 2


def test_manifests(spark):
    rows = [(1, "package.json", '{"dependencies":{"vitest":"1"}}'), (2, "package.json", "{broken"), (3, "package.json", '{"scripts":{"t":"run jest"}}'),
            (4, "package.json", '{"scripts":{"t":"jestful"}}'), (5, "gradlew", ""), (6, "pyproject.toml", "[tool.pytest]"), (7, "go.mod", ""), (7, "pytest.ini", "")]
    df = spark.createDataFrame(rows, "project_id int, path string, content string")
    assert {r.project_id: r.framework for r in C.detect_test_framework(df).collect()} == {
        1: "jest", 2: None, 3: "jest", 4: None, 5: "junit", 6: "pytest", 7: "go"}
    assert {r.project_id: r.tool for r in C.detect_build_tool(df).collect()} == {
        1: "npm", 2: "npm", 3: "npm", 4: "npm", 5: "gradle", 6: None, 7: None}


def test_staging_uses_the_named_folder(spark):
    assert staging.staging_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5).withColumn("s", F.array(F.struct("id")))
    assert staging.stage(df).schema.simpleString() == df.schema.simpleString()


def test_streams(spark, tmp_path, lines_of):
    lines = lines_of({"a": ["e: /x/A.kt:1:2 bad", "w: /x/B.kt:3 meh", "noise", "> Task :t FAILED"]})
    landed = str(tmp_path / "in")
    lines.write.parquet(landed)
    feed = feeds.read_feed(spark, landed, lines.schema)
    got = feeds.drain(feeds.stream_facts(feed), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gradle.kotlin_diagnostics(gradle.facts(lines)).collect()))
    query = feed.writeStream.foreachBatch(feeds.per_finished_log(gradle.digest, str(tmp_path / "digests"))).option(
        "checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "digests")).first().summary == "BUILD (status unknown) (1 error, 1 warning)"


def test_warning_counts_drop_open_hours(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", 1, "w: /a.kt:1 m", start), ("a", 2, "w: /a.kt:2 m", start + dt.timedelta(minutes=59)),
            ("a", 3, "w: /a.kt:3 m", start + dt.timedelta(hours=1)), ("a", 4, "x", start + dt.timedelta(days=7, hours=1))]
    df = spark.createDataFrame(rows, "log_id string, line_no bigint, line string, ts timestamp_ntz")
    landed = str(tmp_path / "in")
    df.coalesce(1).write.parquet(landed)
    counts = feeds.stream_warning_counts(feeds.read_feed(spark, landed, df.schema))
    got = feeds.drain(counts, str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert [(r.hour, r.message, r.n) for r in got] == [(start, "m", 2)]
