"""Paths in forests given by parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gistline.sources.staging import stage


def paths(nodes: DataFrame, key: str, node: str, up: str, name: str) -> DataFrame:
    """``nodes`` (key, node, up, name) with ``path``, the names from the root down with dots, and ``depth``.

    Pointers are doubled: a round puts the path of the node above before the own one and jumps to
    where that one pointed, so a forest of depth d takes log2(d) + 1 rounds. A pointer to nowhere
    makes a root. While trees remain, every round finishes some node; the first that finishes none
    leaves the cycles and what hangs on them, which get a null path and depth. (key, node) is unique.
    """
    known = nodes.select(F.col(key).alias("_k"), F.col(node).alias("_n"))
    known = known.select("*", F.lit(True).alias("_there"))
    base = stage(
        nodes.select(F.col(key).alias("k"), F.col(node).alias("n"), F.col(up).alias("declared"), F.col(name).alias("path"))
        .join(known, (F.col("k") == F.col("_k")) & (F.col("declared") == F.col("_n")), "left")
        .select("k", "n", F.when(F.col("_there"), F.col("declared")).alias("u"), "path", F.lit(0).cast("bigint").alias("depth")))
    left = base.filter("u IS NOT NULL").count()
    while left:
        above = base.select(F.col("k").alias("_k"), F.col("n").alias("_n"), F.col("u").alias("_u"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        base = stage(
            base.join(above, (F.col("k") == F.col("_k")) & (F.col("u") == F.col("_n")), "left")
            .select("k", "n", F.col("_u").alias("u"), F.concat_ws(".", "_path", "path").alias("path"),
                    (F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0))).alias("depth")))
        now = base.filter("u IS NOT NULL").count()
        if now == left:
            break
        left = now
    done = F.col("u").isNull()
    found = base.select(F.col("k").alias(key), F.col("n").alias(node), F.when(done, F.col("path")).alias("path"), F.when(done, F.col("depth")).alias("depth"))
    return nodes.join(found, [key, node])
