import random

import pytest
from pyspark.sql import functions as F

from gistline.operators import symbols as S
from gistline.sources import store

SCHEMA = ("file_id int, name string, qualified_name string, parent_qualified_name string, kind string, line_lo bigint, line_hi bigint, "
          "modifiers array<string>, doc string")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([
        (1, "A", "A", None, "class", 1, 20, ["public", "final"], None),
        (1, "f", "A.f", "A", "method", 2, 5, [], "does f"),
        (1, "g", "A.f.g", "A.f", "function", 3, 3, [], None),
        (1, "x", "A.x", "A", "field", 6, 6, ["private"], None),
        (1, "B", "B", None, "type_alias", 22, 22, [], None),
        (2, "f", "f", None, "function", 1, 900, [], None),
    ], SCHEMA)


def test_outline_and_list(table):
    rows = [r.text for r in S.outline(table.filter("file_id = 1")).orderBy("seq").collect()]
    assert rows == ["public final class A [L1-L20]", "├─ method f [L2-L5]", "  ├─ fun g [L3-L3]", "├─ private field x [L6-L6]", "type B [L22-L22]"]
    cut = [r.text for r in S.outline(table.filter("file_id = 1"), cap=9).orderBy("seq").collect()]
    assert cut == rows[:2] + ["... (outline truncated; use list_symbols for full tree)"]
    listed = S.list_symbols(table, ["function", "field"]).filter("file_id = 1").orderBy("seq").collect()
    assert [r.text for r in listed] == ["    fun A.f.g [L3-L3]", "  private field A.x [L6-L6]"] and {r.listed for r in listed} == {2}
    assert S.list_symbols(table, depth=0).count() == 3
    with pytest.raises(ValueError):
        S.list_symbols(table, ["klass"])


def test_paths_and_preorder(table):
    assert {(r.path, r.depth) for r in S.symbol_paths(table).collect()} == {
        ("A", 0), ("A.f", 1), ("A.f.g", 2), ("A.x", 1), ("B", 0), ("f", 0)}
    assert [r.qualified_name for r in S.flatten_symbols(table).filter("file_id = 1").orderBy("seq").collect()] == ["A", "A.f", "A.f.g", "A.x", "B"]


def test_paths_of_orphans_and_cycles(spark):
    rows = [(1, "A", "A", None), (1, "f", "Gone.f", "Gone"), (1, "g", "Gone.f.g", "Gone.f"), (1, "p", "p", "q"), (1, "q", "q", "p")]
    symbols = spark.createDataFrame(rows, "file_id int, name string, qualified_name string, parent_qualified_name string")
    got = sorted(((r.path or "", r.depth) for r in S.symbol_paths(symbols).collect()), key=str)
    assert got == sorted([("A", 0), ("f", 0), ("f.g", 1), ("", None), ("", None)], key=str)


def test_equal_hits_stay_apart(spark, table):
    hits = spark.createDataFrame([(1, 3), (1, 3), (1, 21)], "file_id int, line_no bigint")
    assert sorted((r.line_no, r.qualified_name or "") for r in S.enclosing_symbol(hits, table).collect()) == [(3, "A.f.g"), (3, "A.f.g"), (21, "")]


def test_read_symbols(spark, table):
    asked = spark.createDataFrame([(1, "f"), (1, "A.x"), (2, "f"), (2, "A"), (1, "A")], "file_id int, requested string")
    got = S.read_symbols(table, asked)
    assert sorted((r.file_id, r.requested, r.header, r.note) for r in got.fillna("", ["note"]).collect()) == [
        (1, "A", "class A [L1-L20]", ""), (1, "A.x", "field A.x [L6-L6]", "// inside A"), (1, "f", "method A.f [L2-L5]", "// inside A"),
        (2, "f", "function f [L1-L900]", "")]
    assert [(r.file_id, r.error) for r in S.symbols_not_found(table, asked).collect()] == [(2, "[error] symbol not found: A")]


def test_paths_of_a_deep_chain_take_few_rounds(spark, monkeypatch):
    from gistline.operators import trees

    n, rounds, write = 3000, [], trees.stage
    monkeypatch.setattr(trees, "stage", lambda df: rounds.append(1) or write(df))
    rows = spark.range(n).selectExpr("1 AS file_id", "concat('s', id) AS name", "concat('q', id) AS qualified_name",
                                     "if(id = 0, null, concat('q', id - 1)) AS parent_qualified_name")
    got = {r.depth: r.n for r in S.symbol_paths(rows).selectExpr("depth", "length(path) AS n").collect()}
    assert sorted(got) == list(range(n)) and got[2] == len("s0.s1.s2") and got[n - 1] == len(".".join(f"s{i}" for i in range(n)))
    assert len(rounds) <= 14


def test_focus(table):
    assert {(r.file_id, r.qualified_name) for r in S.match_focus(table, "f").collect()} == {(1, "A.f"), (2, "f")}
    assert {r.qualified_name for r in S.match_focus(table, "^a\\.").collect()} == {"A.f", "A.f.g", "A.x"}
    assert S.match_focus(table, "(").count() == 0


@pytest.mark.parametrize("bucket", [4, 256])
def test_enclosing_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "LINES_PER_BUCKET", bucket)
    rng = random.Random(3)
    syms = []
    for f in range(3):
        for i in range(25):
            lo = rng.randint(1, 80)
            syms.append((f, f"s{i}", f"s{i}", None, "class", lo, lo + rng.randint(0, 30), [], None))
    hits = [(f, n) for f in range(4) for n in range(0, 120, 3)]
    df = spark.createDataFrame(syms, SCHEMA)
    got = {(r.file_id, r.line_no): r.qualified_name for r in
           S.enclosing_symbol(spark.createDataFrame(hits, "file_id int, line_no bigint"), df).collect()}
    want = {}
    for f, n in hits:
        around = [(s[6] - s[5], s[5], s[2]) for s in syms if s[0] == f and s[5] <= n <= s[6]]
        want[f, n] = min(around)[2] if around else None
    assert got == want


def test_structural_outline(table):
    got = [r.text for r in S.structural_outline(table).filter("file_id = 1 AND qualified_name = 'A'").orderBy("seq").collect()]
    assert got == ["class A [L1-L20]", "", "Body outline (20 lines, too large to inline):", "- [L2-L5] method f", "- [L6-L6] field x", "",
                   "Use read_lines(path, start, end) to fetch a specific range."]
    leaf = [r.text for r in S.structural_outline(table).filter("file_id = 2").orderBy("seq").collect()]
    assert leaf[3:5] == ["- (no nested symbols; use read_lines to zoom in)", ""]


def test_focused_missing(table):
    got = S.focused_missing(table, table.filter("kind = 'type_alias'"), cap=10).collect()
    assert [r.text for r in got] == ["  type B [L22-L22]   ← focused"]


def test_nested_symbols_round_trip_as_json(spark, table):
    back = store.symbols_from_json(store.symbols_to_json(table))
    assert back.columns == table.columns and back.exceptAll(table).count() == 0 and back.count() == table.count()


def test_symbol_store(spark, table, tmp_path):
    path = str(tmp_path / "symbols")
    named = table.withColumn("file_id", F.concat(F.lit("kt_"), F.col("file_id").cast("string")))
    store.write_symbol_store(named, path)
    assert store.read_symbol_store(spark, path).exceptAll(named).count() == 0
    one = store.read_symbol_store(spark, path, "kt_2")
    assert [r.name for r in one.collect()] == ["f"]
    assert "id_bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
