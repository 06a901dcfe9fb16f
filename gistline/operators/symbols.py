"""Code as symbol tables: trees as adjacency rows (file_id, qualified_name, parent_qualified_name,
name, kind, line_lo, line_hi), one row per symbol.

Preorder is the order by (line_lo, line_hi descending, depth, qualified_name).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gistline.functions import text as T
from gistline.operators.retrieve import pattern_error
from gistline.operators.scan import first_k, once, scan, span_of
from gistline.operators.trees import paths
from gistline.sources.staging import stage

OUTLINE_CAP = 80
FOCUSED_CAP = 200
HEADER_LINES = 7
RESERVED_TOKENS = 300
LEAST_BUDGET = 400
LINES_PER_BUCKET = 256


def _preorder() -> list[Column]:
    return [F.col("line_lo"), F.col("line_hi").desc(), F.col("depth"), F.col("qualified_name")]


def with_depth(symbols: DataFrame) -> DataFrame:
    """Depth from the qualified name, which is the parent's, a dot and a name without dots."""
    return symbols.withColumn("depth", (F.size(F.split("qualified_name", r"\.")) - 1).cast("bigint"))


def in_preorder(symbols: DataFrame, **total: Column) -> DataFrame:
    """Symbols with ``depth`` and ``seq``, their preorder position in the file."""
    return scan(with_depth(symbols), key=["file_id"], order=_preorder(), bucket=span_of("line_lo"),
                running={"seq": F.lit(1)}, total=total)


def flatten_symbols(symbols: DataFrame) -> DataFrame:
    return in_preorder(symbols).select("file_id", "seq", "depth", "qualified_name", "kind", "line_lo", "line_hi")


def symbol_paths(symbols: DataFrame) -> DataFrame:
    """Qualified names and depths rebuilt from names and parents, by doubled pointers.

    A symbol whose parent is not in the table stands as a root. Symbols that are their own ancestors,
    and those below them, have no root and come out with a null path. Of symbols with one qualified
    name (overloads) the first by parent and name stands for all as a parent.
    """
    own = symbols.select("file_id", "name", F.col("qualified_name").alias("declared"), F.col("parent_qualified_name").alias("up"))
    parents = own.groupBy("file_id", "declared").agg(F.min(F.struct("up", "name")).alias("n")).select("file_id", "declared", "n.up", "n.name")
    known = stage(paths(parents, "file_id", "declared", "up", "name").select(
        "file_id", F.col("declared").alias("up"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.lit(True).alias("there")))
    found = own.join(known, ["file_id", "up"], "left")
    nested = F.coalesce("there", F.lit(False))
    return found.select(
        "file_id", F.when(nested, F.concat("up_path", F.lit("."), "name")).otherwise(F.col("name")).alias("path"),
        F.when(nested, F.col("up_depth") + 1).otherwise(F.lit(0)).cast("bigint").alias("depth"))


def _label(name: str, indent: Column, modifiers: bool) -> Column:
    tags = F.when(F.size("modifiers") > 0, F.concat(F.array_join("modifiers", " "), F.lit(" "))).otherwise("") \
        if modifiers else F.lit("")
    return F.concat(indent, tags, T.kind_label("kind"), F.lit(" "), name, F.lit(" "),
                    T.line_range_label("line_lo", "line_hi"))


def list_symbols(symbols: DataFrame, kinds: Sequence[str] | None = None, depth: int = -1) -> DataFrame:
    """Listed symbols in order with their indented line, and how many the file lists. A filtered
    parent does not hide its children."""
    unknown = set(kinds or ()) - set(T.SYMBOL_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    found = with_depth(symbols)
    if kinds:
        found = found.filter(F.col("kind").isin(*kinds))
    if depth >= 0:
        found = found.filter(F.col("depth") <= depth)
    listed = scan(found, key=["file_id"], order=_preorder(), bucket=span_of("line_lo"),
                  running={"seq": F.lit(1)}, total={"listed": F.lit(1)})
    indent = F.repeat(F.lit("  "), F.col("depth").cast("int"))
    return listed.select("file_id", "seq", "listed",
                         _label("qualified_name", indent, "modifiers" in symbols.columns).alias("text"))


def read_symbols(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """Symbols asked for by name or qualified name: requests has (file_id, requested).

    Two equi joins, since one join on either name could not be hashed.
    """
    by_path = symbols.join(requests.select("file_id", F.col("requested").alias("qualified_name")).distinct(),
                           ["file_id", "qualified_name"]).withColumn("requested", F.col("qualified_name"))
    by_name = symbols.join(requests.select("file_id", F.col("requested").alias("name")).distinct(),
                           ["file_id", "name"]).withColumn("requested", F.col("name"))
    # A top-level symbol has one name for both.
    found = by_path.unionByName(by_name.filter("name != qualified_name"))
    header = F.concat("kind", F.lit(" "), "qualified_name", F.lit(" "), T.line_range_label("line_lo", "line_hi"))
    note = F.concat(F.lit("// inside "), "parent_qualified_name")
    return found.withColumn("header", header).withColumn("note", note)


def symbols_not_found(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    asked = requests.select("file_id", "requested").distinct()
    missing = asked.join(symbols.select("file_id", F.col("qualified_name").alias("requested")),
                         ["file_id", "requested"], "left_anti")
    missing = missing.join(symbols.select("file_id", F.col("name").alias("requested")),
                           ["file_id", "requested"], "left_anti")
    return missing.withColumn("error", F.concat(F.lit("[error] symbol not found: "), "requested"))


def match_focus(symbols: DataFrame, focus: str) -> DataFrame:
    """Per file: the symbols named exactly so if there are any, else those the pattern finds."""
    exact = symbols.filter((F.col("qualified_name") == focus) | (F.col("name") == focus))
    if pattern_error(symbols, focus):
        return exact.withColumn("exact", F.lit(True))
    pattern = f"(?i){focus}"
    loose = symbols.filter(F.col("name").rlike(pattern) | F.col("qualified_name").rlike(pattern))
    settled = exact.select("file_id").distinct()
    return exact.withColumn("exact", F.lit(True)).unionByName(
        loose.join(settled, "file_id", "left_anti").withColumn("exact", F.lit(False)))


def enclosing_symbol(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (file_id, line_no) with the innermost symbol around them, null if none.

    A range join by buckets of lines: a symbol goes to every bucket it reaches into, a hit to
    its own, so a bucket holds few rows of either side however large the file is. Spans of
    nested symbols add up to the file's length per level, so the copies stay linear.
    """
    def bucket(c: str) -> Column:
        return F.expr(f"{c} div {LINES_PER_BUCKET}")

    spread = with_depth(symbols).select(
        "file_id", "qualified_name", "depth", "line_lo", "line_hi",
        F.explode(F.sequence(bucket("line_lo"), bucket("line_hi"))).alias("bucket"))
    # Places are looked up once each and joined back, so that equal hits stay as many as they are.
    h = hits.select("file_id", "line_no").distinct().withColumn("bucket", bucket("line_no"))
    on = [h["file_id"] == spread["file_id"], h["bucket"] == spread["bucket"],
          h["line_no"] >= spread["line_lo"], h["line_no"] <= spread["line_hi"]]
    order = F.struct((F.col("line_hi") - F.col("line_lo")).alias("span"), "line_lo", "depth", "qualified_name")
    innermost = h.join(spread, on).groupBy(h["file_id"], h["line_no"]).agg(F.min(order).alias("s")).select(
        "file_id", "line_no", F.col("s.qualified_name").alias("qualified_name"))
    return hits.join(innermost, ["file_id", "line_no"], "left").select(*hits.columns, "qualified_name")


def outline(symbols: DataFrame, cap: int = OUTLINE_CAP) -> DataFrame:
    """(file_id, seq, text): the tree's first lines; ``cap`` counts the header's lines too.

    A column ``mark``, if there is one, is put after a symbol's line.

    Unlike the reference, a cut outline ends in one note, not one per open level.
    """
    rows = cap - HEADER_LINES
    first = first_k(with_depth(symbols), rows + 1, ["file_id"], _preorder())
    indent = F.when(F.col("depth") == 0, "").otherwise(
        F.concat(F.repeat(F.lit("  "), (F.col("depth") - 1).cast("int")), F.lit("├─ ")))
    label = _label("name", indent, "modifiers" in symbols.columns)
    if "mark" in symbols.columns:
        label = F.concat(label, F.coalesce("mark", F.lit("")))
    text = F.when(F.col("seq") <= rows, label).otherwise(
        "... (outline truncated; use list_symbols for full tree)")
    return first.select("file_id", "seq", text.alias("text"))


def pack_focus(matches: DataFrame, max_tokens: int = 2000, span: int | None = None) -> DataFrame:
    """Which matches fit the budget, in preorder: columns ``cost`` (body) and ``outline_cost``.

    A body over half the budget is replaced by its outline, which always goes in; the first body
    that does not fit ends the list.
    """
    budget = max(LEAST_BUDGET, max_tokens)
    oversized = F.col("cost") > budget // 2
    spent = scan(
        once(with_depth(matches), "oversized", oversized), key=["file_id"], order=_preorder(), bucket=span_of("line_lo", span),
        running={"seq": F.lit(1), "spent": F.when(F.col("oversized"), F.col("outline_cost")).otherwise(F.col("cost"))})
    over = ~F.col("oversized") & (F.col("spent") + RESERVED_TOKENS > budget)
    ended = scan(spent, key=["file_id"], pos="seq", span=span, through={"stop": F.when(over, 1)})
    return ended.filter("stop IS NULL").drop("stop").withColumn("spent", F.col("spent") + RESERVED_TOKENS)


def structural_outline(symbols: DataFrame) -> DataFrame:
    """(file_id, qualified_name, line_lo, seq, text): each symbol's direct children with their ranges."""
    size = F.col("line_hi") - F.col("line_lo") + 1
    key = ["file_id", "qualified_name", "line_lo"]
    children = symbols.filter("parent_qualified_name IS NOT NULL").select(
        "file_id", F.col("parent_qualified_name").alias("qualified_name"), F.col("line_lo").alias("child_lo"),
        F.col("line_hi").alias("child_hi"), F.concat(
            F.lit("- "), T.line_range_label("line_lo", "line_hi"), F.lit(" "), T.kind_label("kind"), F.lit(" "), "name")
        .alias("text"))
    inside = symbols.select(*key, "line_hi").join(children, ["file_id", "qualified_name"]).filter(
        (F.col("child_lo") >= F.col("line_lo")) & (F.col("child_hi") <= F.col("line_hi")))
    counted = scan(inside.select(*key, "child_lo", "text"), key=key, order=["child_lo", "text"],
                   bucket=span_of("child_lo"), running={"k": F.lit(1)}, total={"n": F.lit(1)})
    parents = counted.filter("k = 1").select(*key, "n")
    frame = symbols.join(parents, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    row = lambda seq, text: F.struct(seq.cast("bigint").alias("seq"), text.alias("text"))
    end = F.greatest(F.col("n"), F.lit(1)) + 3
    rows = F.array_compact(F.array(
        row(F.lit(1), F.concat(T.kind_label("kind"), F.lit(" "), "qualified_name", F.lit(" "), T.line_range_label("line_lo", "line_hi"))),
        row(F.lit(2), F.lit("")),
        row(F.lit(3), F.concat(F.lit("Body outline ("), size.cast("string"), F.lit(" lines, too large to inline):"))),
        F.when(F.col("n") == 0, row(F.lit(4), F.lit("- (no nested symbols; use read_lines to zoom in)"))),
        row(end + 1, F.lit("")),
        row(end + 2, F.lit("Use read_lines(path, start, end) to fetch a specific range."))))
    return frame.select(*key, F.inline(rows)).unionByName(
        counted.select(*key, (F.col("k") + 3).alias("seq"), "text"))


def focused_missing(symbols: DataFrame, focused: DataFrame, cap: int = FOCUSED_CAP) -> DataFrame:
    """Focused symbols that the capped outline does not show, as stub lines."""
    shown = first_k(with_depth(symbols), cap - HEADER_LINES, ["file_id"], _preorder())
    missing = focused.join(shown.select("file_id", "qualified_name"), ["file_id", "qualified_name"], "left_anti")
    stub = F.concat(F.lit("  "), T.kind_label("kind"), F.lit(" "), "qualified_name", F.lit(" "),
                    T.line_range_label("line_lo", "line_hi"), F.lit("   ← focused"))
    return missing.select("file_id", "qualified_name", stub.alias("text"))


def outline_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of a rendered text given as rows (file_id, text)."""
    return rows.groupBy("file_id").agg(
        T.tokens_of_length(F.sum(F.length("text")) + F.count("*") - 1).alias("returned_tokens"))
