import random
import re

import pytest
from pyspark.sql import functions as F

from gistline.operators import retrieve as R
from gistline.plans import jobs
from gistline.sources.logs import explode_lines, stored_files, stored_lines, write_line_store


def texts(df, *order):
    return [r.text for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_grep_context_equals_a_loop(lines_of, context):
    rng = random.Random(context)
    log = [rng.choice(["x", "HIT", "a hit b", "y", "z", "w"]) for _ in range(50)]
    keep = sorted({j for i, t in enumerate(log) if "hit" in t.lower() for j in range(max(0, i - context), min(50, i + context + 1))})
    want = []
    for n, j in enumerate(keep):
        if n == 0 or j > keep[n - 1] + 1:
            want.append("---")
        want.append(f"{j + 1}: {log[j]}")
    assert texts(R.grep_context(lines_of({"a": log}), "hit", context), "line_no", "part") == want


def test_bad_pattern_is_a_row(lines_of):
    assert texts(R.grep_context(lines_of({"a": "x"}), "("), "line_no") == ["[error] invalid regex: ("]


def test_ranges(lines_of):
    lines = lines_of({"a": [f"l{i}" for i in range(1, 501)]})
    assert texts(R.slice_lines(lines, -3, 2), "line_no") == ["1: l1", "2: l2"]
    assert texts(R.slice_lines(lines, 499, 900), "line_no") == ["499: l499", "500: l500"]
    assert texts(R.slice_lines(lines, 9, 3), "line_no") == []
    assert R.head_lines(lines).count() == 200


@pytest.mark.parametrize("span", [3, None])
def test_cap_tokens(lines_of, span):
    lines = lines_of({"a": [f"entry {i}" for i in range(1, 301)], "b": ["short"]})
    rows = R.slice_lines(lines).withColumnRenamed("line_no", "ord")
    got = {}
    for r in R.cap_tokens(rows, 100, span=span).orderBy("log_id", "ord").collect():
        got.setdefault(r.log_id, []).append(r.text)
    want, spent = [], 0
    for i in range(1, 301):
        text = f"{i}: entry {i}"
        spent += -(-len(text) // 4) + 1
        if spent > 100:
            break
        want.append(text)
    assert got == {"a": [*want, "… [truncated at 100 tokens; use start_line/end_line to paginate]"], "b": ["1: short"]}


def sized(files):
    """Files with their number of lines, and their lines."""
    lines = explode_lines(files, "source_text", "file_key").withColumnRenamed("log_id", "file_key")
    return files.withColumn("n", F.size(F.split("source_text", "\n"))), lines


def test_a_range_reads_its_blocks_alone(spark, tmp_path):
    lines = spark.range(1, 100_001).selectExpr("'big' AS log_id", "id AS line_no", "concat('l', id) AS line").unionByName(
        spark.createDataFrame([("small", 1, "x"), ("small", 2, "y")], "log_id string, line_no long, line string"))
    write_line_store(lines, str(tmp_path), 1000)
    got = stored_lines(spark, str(tmp_path), 5001, 7000)
    plan = got._jdf.queryExecution().executedPlan()
    assert len({f.rsplit("/", 2)[1] for f in got.select("_metadata.file_path").distinct().toPandas()["file_path"]}) == 2 and "block" in plan.toString().split("PartitionFilters")[1][:200]
    assert got.count() == 2000 and stored_lines(spark, str(tmp_path), 1, 2).filter("log_id = 'small'").count() == 2
    files = stored_files(spark, str(tmp_path)).selectExpr("log_id AS file_key", "concat('/', log_id) AS path", "1 AS size_bytes", "n")
    shown = [r.text for r in R.read_lines(files, got.withColumnRenamed("log_id", "file_key"), 5001, 7000, 30).filter("file_key = 'big'").orderBy("seq").collect()]
    assert shown[:4] == ["File: /big", "Lines 5001-7000 of 100000", "", "5001: l5001"] and shown[-1].startswith("... [truncated")
    assert [r.text for r in R.read_lines(files, got.withColumnRenamed("log_id", "file_key"), 5001, 7000).filter("file_key = 'small'").collect()] == [
        "[error] end_line (2) < start_line (5001)"]


def test_reference_lists(spark):
    """The whole list, against the regular expression applied line by line."""
    text = ["class Post {", "  val id = Post(1)", "  fun Post_x() = a.b", "}", "", "Poster", "a.b + Post", "x==y", "x == y", "é Post"]
    lines = spark.createDataFrame([(1, "kotlin", i, t) for i, t in enumerate(text, 1)], "file_id int, language string, line_no long, line string")
    asked = ["Post", "a.b", "==", "nothing", "$", "b +", ""]
    requests = spark.createDataFrame([(1, "/p", i) for i in asked] + [(2, "/q", "Post"), (None, "/n", "Post")], "file_id int, path string, identifier string")
    hits = {}
    for r in R.indexed_references(lines, requests).collect():
        hits.setdefault((r.file_id, r.identifier), []).append(r.line_no)
    want = {(1, i): [n for n, t in enumerate(text, 1) if re.search(r"\b" + re.escape(i) + r"\b", t, re.ASCII)] for i in asked if i}
    assert {k: sorted(v) for k, v in hits.items()} == {k: v for k, v in want.items() if v}
    symbols = spark.createDataFrame([(1, "Post", 1, 4)], "file_id int, qualified_name string, line_lo long, line_hi long")
    got = {}
    for r in jobs.find_references(lines, requests, symbols, context=1, limit=3).orderBy("identifier", "ord").collect():
        got.setdefault((r.file_id, r.identifier), []).append(r.text)
    assert got[1, "Post"] == [
        "File: /p", "Identifier: Post", "3 matches (capped)", "", "---", "► 1: class Post {", "  2:   val id = Post(1)", "  (inside Post)", "  1: class Post {",
        "► 2:   val id = Post(1)", "  3:   fun Post_x() = a.b", "  (inside Post)", "---", "  6: Poster", "► 7: a.b + Post", "  8: x==y"]
    assert got[1, "nothing"] == ["[nothing] 0 matches in /p"] and got[2, "Post"] == ["[Post] 0 matches in /q"] and got[1, "=="][2] == "1 match"


def test_read_lines(spark):
    files = spark.createDataFrame(
        [(1, "/a", 9, "x\ny\nz"), (2, "/b", 9, "x"), (3, "/c", 11 * 2 ** 20, "x\ny"), (4, "/d", 9, "\n".join(["w" * 40] * 99))],
        "file_key int, path string, size_bytes bigint, source_text string")
    got = {}
    for r in R.read_lines(*sized(files), 2, 90, 60, max_bytes=10 << 20).orderBy("file_key", "seq").collect():
        got.setdefault(r.file_key, []).append(r.text)
    assert got[1] == ["File: /a", "Lines 2-3 of 3", "", "2: y", "3: z"]
    assert got[2] == ["[error] end_line (1) < start_line (2)"]
    assert got[3] == ["[error] /c is 11MB (limit 10MB)"]
    assert got[4] == ["File: /d", "Lines 2-90 of 99", "", *[f"{i}: {'w' * 40}" for i in range(2, 6)],
                      "... [truncated at 60 tokens; use a narrower range]"]


def test_large_files_are_read_unless_a_limit_is_set(spark):
    files = spark.createDataFrame([(1, "/c", 11 << 20, "a\nb")], "file_key int, path string, size_bytes bigint, source_text string")
    assert [r.text for r in R.read_lines(*sized(files), 1, 2).orderBy("seq").collect()][-2:] == ["1: a", "2: b"]


def test_references(lines_of):
    lines = lines_of({"a": ["foo()", "food", "b", "c", "x.foo", "Foo", "éfoo", "foo foo"], "b": ["$foo$"] * 60})
    assert [r.line_no for r in R.find_references(lines, "foo").filter("log_id = 'a'").orderBy("line_no").collect()] == [1, 5, 7, 8]
    some = R.find_references(lines, "foo", limit=50).filter("log_id = 'b'").collect()
    assert len(some) == 50 and {(r.total, r.capped) for r in some} == {(60, True)}
    every = R.find_references(lines, "foo").filter("log_id = 'b'").collect()
    assert sorted(r.seq for r in every) == list(range(1, 61)) and {(r.total, r.capped) for r in every} == {(60, False)}
    assert R.find_references(lines, "f.o").count() == 0
    got = texts(R.reference_context(lines.filter("log_id = 'a'"), "foo", 1), "seq", "line_no", "part")
    assert got == ["---", "► 1: foo()", "  2: food", "---", "  4: c", "► 5: x.foo", "  6: Foo", "  6: Foo", "► 7: éfoo", "  8: foo foo",
                   "  7: éfoo", "► 8: foo foo"]


def test_head_tail(lines_of):
    lines = lines_of({"long": [f"l{i}" for i in range(1, 12)], "short": ["a", "b"]})
    got = R.head_tail(lines, small=5, head=2, tail=3)
    assert texts(got.filter("log_id = 'long'"), "line_no") == ["1: l1", "2: l2", "... [6 lines omitted] ...", "9: l9", "10: l10", "11: l11"]
    assert texts(got.filter("log_id = 'short'"), "line_no") == ["a", "b"]
