import random
import re

import pytest
from pyspark.sql import functions as F

from gistline.operators.scan import halo, scan


def rows(seed, logs=3, n=40):
    rng = random.Random(seed)
    return [(f"l{k}", i, rng.choice([None, None, 1, 2, 3]), rng.randint(0, 5)) for k in range(logs) for i in range(1, n - 7 * k)]


def expected(data):
    out = {}
    for log in {r[0] for r in data}:
        part = [r for r in data if r[0] == log]
        for i, (_, no, _ev, amount) in enumerate(part):
            last = [r[2] for r in part[:i] if r[2] is not None]
            incl = [r[2] for r in part[: i + 1] if r[2] is not None]
            later = [r[2] for r in part[i + 1:] if r[2] is not None]
            out[log, no] = (last[-1] if last else None, incl[-1] if incl else None, later[0] if later else None,
                            sum(r[3] for r in part[: i + 1]), sum(r[3] for r in part))
    return out


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_scan_equals_a_loop(spark, span):
    data = rows(span)
    df = spark.createDataFrame(data, "log_id string, line_no bigint, ev int, amount int")
    ev, amount = F.col("ev"), F.col("amount")
    got = scan(df, before={"b": ev}, through={"t": ev}, after={"a": ev}, running={"r": amount}, total={"s": amount}, span=span)
    assert {(r.log_id, r.line_no): (r.b, r.t, r.a, r.r, r.s) for r in got.collect()} == expected(data)


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_halo_sees_across_spans(spark, span):
    data = rows(7)
    df = spark.createDataFrame(data, "log_id string, line_no bigint, ev int, amount int")
    got = halo(df, lambda w: {"p": F.lag("amount", 2).over(w), "m": F.max("amount").over(w.rowsBetween(-2, 3))},
               left=2, right=3, span=span)
    by = {(r[0], r[1]): r[3] for r in data}
    result = {(r.log_id, r.line_no): (r.p, r.m) for r in got.collect()}
    assert len(result) == len(data) == got.count()
    for (log, no), (p, m) in result.items():
        assert p == by.get((log, no - 2))
        assert m == max(by[log, k] for k in range(no - 2, no + 4) if (log, k) in by)


def test_composite_order_numbers_rows(spark):
    data = [("a", i // 3, i % 3) for i in range(30)]
    df = spark.createDataFrame(data, "log_id string, x bigint, y bigint")
    got = scan(df, order=["x", "y"], bucket=F.expr("x div 4"), running={"n": F.lit(1)}, total={"m": F.lit(1)})
    assert [r.n for r in got.orderBy("x", "y").collect()] == list(range(1, 31))
    assert {r.m for r in got.collect()} == {30}
    with pytest.raises(ValueError):
        scan(df, order=["x"], bucket=F.col("x"), before={"b": F.col("y")})


def test_rows_of_a_hot_log_are_spread(spark):
    """One log with all rows: no window group holds more than a span."""
    df = spark.range(1, 2001).select(F.lit("hot").alias("log_id"), F.col("id").alias("line_no"))
    got = scan(df, running={"n": F.lit(1)}, span=100)
    assert got.filter("n != line_no").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"REPARTITION_BY_COL", plan) and re.search(r"hashpartitioning\([^)]*__span", plan)


def test_deals_are_not_merged_by_their_compressed_size(spark):
    """Lines that compress to nothing still go to as many tasks as the session's shuffles have."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = spark.range(1, 2001).selectExpr("id % 100 AS log_id", "id div 100 + 1 AS line_no", "'ok' AS line")
    near = halo(lines, lambda w: {"p": F.lag("line", 1).over(w)}, left=1)
    assert n > 1 and near.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_scan_of_a_scan_stays_where_its_rows_were_dealt_to(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(1, 12)] + [("b", 1, 1), (None, 2, 1)], "log_id string, line_no long, v long")
    first = scan(df, span=2, running={"s": "v"}, keep_span=True)
    again = scan(first, span=2, dealt=True, running={"t": F.col("s")}, before={"p": F.col("s")})
    known = {(r.log_id, r.line_no): (r.s, r.t, r.p) for r in again.collect()}
    s = [sum(j % 3 for j in range(1, i + 1)) for i in range(1, 12)]
    assert known == {("b", 1): (1, 1, None)} | {("a", i): (s[i - 1], sum(s[:i]), s[i - 2] if i > 1 else None) for i in range(1, 12)}
