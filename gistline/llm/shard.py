"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region has racks, a rack has shards; a shard has a weight, and a rack or region
weighs what it holds. A row descends from the root: at each level every child draws
``-ln(u) / weight`` with u a hash of (child, key) in (0, 1), and the least draw wins. A draw depends
on its child alone, so when weights change, rows move only into subtrees that became heavier and out
of subtrees that became lighter. Inside a subtree whose children keep their weights nothing moves.

All draws are column expressions over the tree as a literal, so placing rows needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gistline.llm.common import number_rows

Tree = dict[str, dict[str, dict[int, float]]]  #: region -> rack -> shard -> weight


@dataclass(frozen=True)
class Shape:
    """How many racks a region and how many shards a rack of a full tree has."""

    racks: int = 2
    shards: int = 2


def standard_tree(shards: int, base: int = 16, shape: Shape = Shape()) -> Tree:
    """The tree for a shard count: ``base`` shards in full regions, every further shard in a region of its own.

    A further shard adds a new child of the root and changes no other weight, so it takes rows from
    everywhere and moves none between the others.
    """
    tree: Tree = {}
    for s in range(min(shards, base)):
        region, inside = divmod(s, shape.racks * shape.shards)
        tree.setdefault(f"region{region}", {}).setdefault(f"region{region}/rack{inside // shape.shards}", {})[s] = 1.0
    for s in range(base, shards):
        tree[f"added{s}"] = {f"added{s}/rack0": {s: 1.0}}
    return tree


def weight(node: dict | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def _children(nodes: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("at"))
                     for i, (name, w) in enumerate(nodes) if w > 0])


def _draw(children: Column, key: Column) -> Column:
    """Index of the child with the least draw."""
    def drawn(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(c["name"], key), 11).cast("double")
        return F.struct((-F.ln((bits + 0.5) / F.lit(float(2**53))) / c["weight"]).alias("draw"), c["at"].alias("at"))

    return F.array_min(F.transform(children, drawn))["at"]


def place(df: DataFrame, tree: Tree, key: str, name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; a null key is a key like any other."""
    regions = list(tree)
    racks = [list(tree[r]) for r in regions]
    leaves = [[list(tree[r][k].items()) for k in tree[r]] for r in regions]
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    rack_nodes = F.array(*[_children([(k2, weight(tree[r][k2])) for k2 in tree[r]]) for r in regions])
    shard_nodes = F.array(*[F.array(*[_children([(f"shard{s}", w) for s, w in rack]) for rack in region]) for region in leaves])
    ids = F.array(*[F.array(*[F.array(*[F.lit(s) for s, _ in rack]) for rack in region]) for region in leaves])
    assert all(racks) and all(all(x) for x in leaves), "a region needs a rack, a rack a shard"
    return (
        df.withColumn("_region", _draw(_children([(r, weight(tree[r])) for r in regions]), k))
        .withColumn("_rack", _draw(F.get(rack_nodes, F.col("_region")), k))
        .withColumn("_leaf", _draw(F.get(F.get(shard_nodes, F.col("_region")), F.col("_rack")), k))
        .withColumn(name, F.get(F.get(F.get(ids, F.col("_region")), F.col("_rack")), F.col("_leaf")))
        .drop("_region", "_rack", "_leaf"))


def shard_rows(docs: DataFrame, shards: int = 16, buckets: int = 1024) -> DataFrame:
    """Every row with its shard, its slot there, and its shard if there were one more.

    In: doc_id, text (more columns are ignored). Out: doc_id, size, text_crc32, law, shard, slot,
    grown_shard. Null and empty texts have size 1 and checksum 0; repeated rows share a shard and get
    slots of their own; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(rows, standard_tree(shards), "doc_id", "shard")
    rows = place(rows, standard_tree(shards + 1, base=min(shards, 16)), "doc_id", "grown_shard")
    return number_rows(rows, ["shard"], ["doc_id"], "slot", buckets).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
