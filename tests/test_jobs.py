from gistline.operators import classify, junit
from gistline.plans import jobs
from gistline.sources import staging

RUNS = "run_id string, command string, stdout string, stderr string, exit_code int, timed_out boolean, duration_ms bigint"


def test_runs_to_responses(spark):
    runs = spark.createDataFrame([
        ("1", "./gradlew build", "\x1b[1me: /a/B.kt:1:2 no\x1b[0m\nBUILD FAILED in 2s", "", 1, False, 10),
        ("2", "echo", "", "oops error", 0, True, 5),
        ("3", "npm i", "added 1 package", "npm warn deprecated a@1: b", 0, False, 7)], RUNS)
    done = jobs.distill_runs(runs)
    text = {r.response.split("\n")[0] for r in done.responses.collect()}
    assert text == {"BUILD FAILED (1 error, 0 warnings) [EXIT 1, 10ms]", "Command output (1 error-matching lines) [TIMED OUT, 5ms]",
                    "npm OK (1 unique deprecation warnings) [OK, 7ms]"}
    assert {r.log_id.split("_")[0] for r in done.logs.collect()} == {"gradle", "generic", "npm"}


def test_runs_are_read_once(spark, tmp_path, monkeypatch):
    """The runs table is scanned by one job, and neither digests nor responses read it again."""
    path = str(tmp_path / "runs")
    spark.createDataFrame([(str(i), c, "BUILD FAILED in 2s\nadded 1 package", "", 0, False, 1) for i, c in enumerate(["gradle", "npm", "x"])], RUNS).write.parquet(path)
    plans = []
    whole = staging.stage

    def watched(df, *by):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles()))
        return whole(df, *by)

    for module in (jobs, *[m for m in (classify.gradle, classify.npm, classify.jest, classify.pytest, classify.junit, classify.generic) if hasattr(m, "stage")]):
        monkeypatch.setattr(module, "stage", watched)
    done = jobs.distill_runs(spark.read.parquet(path))
    assert sum(path in p for p in plans) == 1
    assert not any(path in f for df in (done.logs, done.digests, done.responses) for f in df.inputFiles())
    assert done.responses.count() == 3


def test_missing_kinds_and_ids(spark):
    lines = spark.createDataFrame([("a", None, 1, "oops error"), ("b", "zzz", 1, "x"), (None, "gradle", 1, "BUILD FAILED in 1s")],
                                  "log_id string, kind string, line_no bigint, line string")
    assert sorted((r.log_id, r.kind) for r in classify.distill(lines).collect()) == [("a", "generic"), ("b", "generic")]


def test_outcome_of_totals_alone(lines_of):
    lines = lines_of({"bad": ["5 tests completed, 2 failed"], "good": ["5 tests completed, 0 failed"]})
    assert {r.log_id: r.outcome for r in junit.digest(lines).collect()} == {"bad": "failed", "good": "ok"}


def test_staged_tables_go_with_their_block(spark, tmp_path):
    import os

    with staging.staged_tables(spark):
        files = staging.stage(spark.range(3)).inputFiles()
        assert all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def source(n):
    return "class A {\n" + "\n".join(f"    fun f{i}() {{\n        val x = {i}\n    }}" for i in range(n)) + "\n}\nfun other() = 1"


def test_read_code(spark):
    files = spark.createDataFrame([
        ("/big.kt", 1, 1, source(120)), ("/small.kt", 1, 2, source(2)), ("/notes.md", 1, 3, "# hi"), ("/none.kt", 1, 4, "val z = 1\n" * 400)],
        "path string, mtime_ms bigint, size_bytes bigint, source_text string")
    auto = {r.path: r for r in jobs.read_code(files).collect()}
    assert {p: r.returned for p, r in auto.items()} == {"/big.kt": "outline", "/small.kt": "full", "/notes.md": "full", "/none.kt": "outline"}
    assert auto["/notes.md"].text == "\n".join(["File: /notes.md", "Language: plain · 1 lines · ~1 tokens (full file)",
        "file_id: " + auto["/notes.md"].file_id, "Returning: full content", "", "```", "# hi", "```", "", "---",
        f'[file_id="{auto["/notes.md"].file_id}"]'])
    big = auto["/big.kt"].text.split("\n")
    assert big[5:9] == ["OUTLINE", "-" * 57, "class A [L1-L362]", "├─ method f0 [L2-L4]"] and len(big) == 80 + 1 + 3
    got = {r.path: r for r in jobs.read_code(files, focus="f7|^A$").collect()}
    assert {p: r.returned for p, r in got.items()} == {"/big.kt": "focused", "/small.kt": "focused", "/notes.md": "full", "/none.kt": "outline_note"}
    text = got["/big.kt"].text
    assert "Returning: outline + 12 focused symbols" in text and "├─ method f7 [L23-L25]   ← focused" in text
    assert "method A.f7 [L23-L25]\n```\nfun f7() {\n        val x = 7\n    }\n```\n" in text
    assert "class A [L1-L362]\n\nBody outline (362 lines, too large to inline):\n- [L2-L4] method f0\n" in text
    assert got["/none.kt"].text.endswith("[note] focus='f7|^A$' matched no symbols in this file.")


def test_runs_as_lines_give_the_same_digests(spark):
    texts = {"a": ("./gradlew build", "w: /x/A.kt:3:1 Unused\nBUILD FAILED in 2s"), "b": ("npm install", "\x1b[31mnpm ERR! code E1\x1b[0m\n\nadded 3 packages"),
             "c": ("make", "x\nx\nerror: bad\n" + "y" * 3000), "d": ("jest", "")}
    more = ["0 AS exit_code", "false AS timed_out", "5L AS duration_ms"]
    runs = spark.createDataFrame([(k, c, t, "") for k, (c, t) in texts.items()], "run_id string, command string, stdout string, stderr string").selectExpr("*", *more)
    lines = spark.createDataFrame([(k, i, x) for k, (_, t) in texts.items() if t for i, x in enumerate(t.split("\n"), 1)], "run_id string, line_no long, line string")
    whole, by_line = jobs.distill_runs(runs), jobs.distill_run_lines(runs.drop("stdout", "stderr"), lines)

    def rows(done):
        return sorted(map(tuple, done.digests.join(done.logs.select("log_id", "run_id"), "log_id").select(
            "run_id", "kind", "part_no", "summary", "body", "original_tokens", "outcome").collect()))

    assert rows(whole) == rows(by_line) and len(rows(by_line)) == 4
    assert by_line.responses.count() == 4 and "text" not in by_line.logs.columns


def test_heads_of_short_lines_and_runs_that_are_handed_on(spark, monkeypatch):
    """A run is known by what stands far down among short lines, a test run without tests keeps its build
    digest, and only runs with short lines have more than their first lines dealt for the head."""
    far = "\n" * 200 + "x.Y > z PASSED"
    texts = {"far": ("run", far), "long": ("run", "\n".join(["w" * 50] * 300) + "\nx.Y > z PASSED"), "on": ("./gradlew test", "BUILD FAILED in 2s")}
    more = ["0 AS exit_code", "false AS timed_out", "5L AS duration_ms"]
    runs = spark.createDataFrame([(k, c, t, "") for k, (c, t) in texts.items()], "run_id string, command string, stdout string, stderr string").selectExpr("*", *more)
    lines = spark.createDataFrame([(k, i, x) for k, (_, t) in texts.items() for i, x in enumerate(t.split("\n"), 1)], "run_id string, line_no long, line string")
    written = []
    monkeypatch.setattr(jobs, "stage", lambda df, *by, real=jobs.stage: written.append(real(df, *by)) or written[-1])
    whole = jobs.distill_runs(runs)
    del written[:]
    by_line = jobs.distill_run_lines(runs.drop("stdout", "stderr"), lines)
    rows = lambda done: sorted(map(str, done.digests.drop("log_id").collect()))
    assert rows(whole) == rows(by_line) and {r.kind for r in by_line.digests.collect()} == {"junit", "generic", "gradle"}
    assert [r.run_id for r in written[0].collect()] == ["far"]
