"""State along ordered rows, without ever putting a whole log into one task.

Most operators here read a log from top to bottom and carry something along: "are we inside
a block", "which suite failed last", "how many tokens so far". A plain window over
``partitionBy(log_id)`` says that, but it sends a log to one task however long it is, and
window partitions are not split by AQE. So every log is cut into *spans* of consecutive
positions, and two building blocks work on spans:

``scan``
    unbounded frames. A span-local window gives the state inside a span; one summary row per
    span (partial aggregation, so the shuffle carries spans, not lines) is scanned per log;
    both meet in a join on (log, span). A log of n lines costs one summary row per
    ``SPAN`` lines.
``halo``
    bounded frames (lag, lead, a few lines around a hit). Rows near a span's edge are also
    given to the neighbouring span, so that a span-local window sees all it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions per span. A span is what one window group holds at most.
SPAN = 1 << 16

Exprs = Mapping[str, Column | str] | None


def span_of(pos: str, span: int | None = None) -> Column:
    return F.expr(f"({pos} - 1) div {span or SPAN}")


def deal(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hash-partition by ``by`` into as many partitions as the session's shuffles have.

    Without the number, partitions are merged by their compressed size, until there is one for a core;
    lines of logs compress so well that the sort of one task then holds millions of them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _shared(df: DataFrame, by: Sequence[str], even: bool = False) -> DataFrame:
    """Hash-partition by ``by`` such that every consumer reads the same shuffle.

    A scan reads its input twice (rows and summaries), and facts feed several branches of a
    digest. Spark reuses a shuffle only between equal plans, and column pruning makes them
    differ. Packed into one array column the rest of the row cannot be pruned apart.
    """
    rest = [c for c in df.columns if c not in by]
    packed = df.select(*by, F.array(F.struct(*rest)).alias("__row"))
    packed = deal(packed, by) if even else packed.repartition(*by)
    row = F.element_at("__row", 1)
    return packed.select(*by, *[row[c].alias(c) for c in rest])


def scan(
    df: DataFrame,
    *,
    before: Exprs = None,
    through: Exprs = None,
    after: Exprs = None,
    running: Exprs = None,
    total: Exprs = None,
    key: Sequence[str] = ("log_id",),
    pos: str = "line_no",
    order: Sequence[str | Column] | None = None,
    bucket: Column | None = None,
    span: int | None = None,
    dealt: bool = False,
    keep_span: bool = False,
    even: bool = False,
    late: bool = False,
) -> DataFrame:
    """Add columns that depend on the other rows of the same key.

    before   last non-null value strictly before the row
    through  last non-null value up to and including the row
    after    first non-null value strictly after the row
    running  sum up to and including the row (nulls count as 0)
    total    sum over the whole key

    A value may be an expression or the name of a column; a named column travels once, an expression
    beside the row's own columns.

    ``pos`` is a unique bigint position within the key. For an order that is not one column,
    pass ``order`` and a ``bucket`` that never decreases along it; then only ``running`` and
    ``total`` are available. ``dealt`` says that ``df`` comes from :func:`halo` or :func:`scan` with the
    same key, span and ``keep_span``: its rows are already dealt by key and span, and are not shuffled again.
    ``even`` is for costly work on the result: rows go into as many partitions as by :func:`deal`.
    ``late`` says that the values are cheap: they are made of the row's columns where it was dealt to, and do not travel.
    """
    before, through, after = dict(before or {}), dict(through or {}), dict(after or {})
    running, total = dict(running or {}), dict(total or {})
    if order is not None and (bucket is None or before or through or after):
        raise ValueError("a composite order needs a bucket and gives sums only")
    keys = list(key)
    kept = [c for c in df.columns if c != "__span"]
    # Rows without a key belong to no log. Filtering here, and not in one branch of the join
    # below, keeps the two branches' shuffles equal.
    df = df.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    groups = [*keys, "__span"]
    events = {**{f"__b_{n}": c for n, c in before.items()}, **{f"__t_{n}": c for n, c in through.items()},
              **{f"__a_{n}": c for n, c in after.items()}}
    amounts = {**{f"__r_{n}": c for n, c in running.items()}, **{f"__s_{n}": c for n, c in total.items()}}
    home = F.col("__span") if dealt else F.coalesce(bucket if bucket is not None else span_of(pos, span), F.lit(-1)).cast("bigint")
    amounts = {n: c if isinstance(c, str) else F.coalesce(c, F.lit(0)).cast("bigint") for n, c in amounts.items()}
    values = {**events, **amounts}
    made = [c.alias(n) for n, c in values.items() if not isinstance(c, str)]
    work = df.select(*kept, home.alias("__span"), *([] if late else made))
    work = work if dealt else _shared(work, groups, even)
    work = work.select("*", *made) if late else work
    named = {n: F.col(c) if n in events else F.coalesce(c, F.lit(0)).cast("bigint") for n, c in values.items() if isinstance(c, str)}
    work = work.select("*", *[c.alias(n) for n, c in named.items()])

    def at(n: str) -> Column:
        return F.when(F.col(n).isNotNull(), F.col(pos))

    last = [n for n in events if not n.startswith("__a_")]
    first = [n for n in events if n.startswith("__a_")]
    summary = work.groupBy(*groups).agg(
        *[F.max_by(n, at(n)).alias(n) for n in last],
        *[F.min_by(n, at(n)).alias(n) for n in first],
        *[F.sum(n).alias(n) for n in amounts],
    )
    spans = Window.partitionBy(*keys).orderBy("__span")
    earlier = spans.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("__span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    summary = summary.select(
        *groups,
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_x") for n in last],
        *[F.last(n, ignorenulls=True).over(later).alias(f"{n}_x") for n in first],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_x") for n in amounts if n.startswith("__r_")],
        *[F.sum(n).over(whole).alias(f"{n}_x") for n in amounts if n.startswith("__s_")],
    )

    along = Window.partitionBy(*groups).orderBy(*(order or [pos]))
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    incl = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*groups).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = work.select(
        *kept,
        "__span",
        *[F.last(f"__b_{n}", ignorenulls=True).over(upto).alias(f"__b_{n}") for n in before],
        *[F.last(f"__t_{n}", ignorenulls=True).over(incl).alias(f"__t_{n}") for n in through],
        *[F.last(f"__a_{n}", ignorenulls=True).over(back).alias(f"__a_{n}") for n in after],
        *[F.sum(f"__r_{n}").over(incl).alias(f"__r_{n}") for n in running],
    )
    joined = local.join(summary, groups, "inner")
    return joined.select(
        *[F.col(c) for c in kept],
        *([F.col("__span")] if keep_span else []),
        *[F.coalesce(f"__b_{n}", f"__b_{n}_x").alias(n) for n in before],
        *[F.coalesce(f"__t_{n}", f"__t_{n}_x").alias(n) for n in through],
        *[F.coalesce(f"__a_{n}", f"__a_{n}_x").alias(n) for n in after],
        *[(F.col(f"__r_{n}") + F.col(f"__r_{n}_x")).alias(n) for n in running],
        *[F.col(f"__s_{n}_x").alias(n) for n in total],
    )


def halo(
    df: DataFrame,
    make,
    *,
    left: int = 0,
    right: int = 0,
    key: Sequence[str] = ("log_id",),
    pos: str = "line_no",
    span: int | None = None,
    keep_span: bool = False,
) -> DataFrame:
    """Add windowed columns that look at most ``left`` positions back and ``right`` ahead.

    ``make(window)`` gets an ordered window spec and returns the new columns by name.
    Positions must be 1..n without gaps. With ``keep_span`` the rows keep the span that they are dealt by.
    """
    width = max(span or SPAN, left, right)
    home = span_of(pos, width)
    offset = F.expr(f"({pos} - 1) % {width}")
    targets = [home]
    if left:
        targets.append(F.when(offset >= width - left, home + 1))
    if right:
        targets.append(F.when((offset < right) & (home > 0), home - 1))
    wide = df.withColumn("__span", F.explode(F.array_compact(F.array(*targets))))
    wide = deal(wide, [*key, "__span"])
    cols = make(Window.partitionBy(*key, "__span").orderBy(pos))
    out = wide.select("*", *[c.alias(n) for n, c in cols.items()])
    out = out.filter(F.col("__span") == home)
    return out if keep_span else out.drop("__span")


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    Spark pushes a filter on a projected column below the projection as a copy of its
    expression; for a long chain of regexes that doubles the work and the generated code.
    Filters do not pass a generator's output.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def first_k(df: DataFrame, k: int | None, key: Sequence[str], order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """The first k rows of each key, or all of them ranked if k is None. Spark limits each map task's
    rows before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = df.withColumn(name, F.row_number().over(w))
    if k is not None:
        first = first.filter(F.col(name) <= k)
    return first.withColumn(name, F.col(name).cast("bigint"))


def first_lines(df: DataFrame, k: int | None, key: Sequence[str] = ("log_id",), name: str = "seq") -> DataFrame:
    """The first k rows of each key by line_no, or all of them; numbering all goes by spans, not by whole keys."""
    return first_k(df, k, key, ["line_no"], name) if k is not None else scan(df, key=key, running={name: F.lit(1)})
