"""Near-duplicate components by a prefix-tree join of word n-gram sets.

Two sets link when their Jaccard similarity is at least ``num / den``. Then each of them shares at
least that part of its own members with the other, and that is used in three steps:

1. All sets are hashed; documents with equal sets form one class. Members are dealt by hash, and a
   class is dropped when too few of its members occur in any other class. What travels is four bytes
   a member; members that several classes of one task share travel once per task.
2. For the classes left, members are ordered by how many classes hold them, rarest first. Similar
   sets share a member among the first few of each, so classes are clustered by those.
3. A cluster is dealt into blocks of bounded size. In a task, the sets of a block, with members in
   one order, form a prefix tree; the other sets are run down the tree together, overlaps of a shared
   path are counted once, and a subtree is left when the members that remain cannot reach the bound.

Clusters of several blocks first meet the cluster's most shared classes and themselves; only classes
outside the largest component so found meet the other blocks, so that a large group of copies does
not cost the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gistline.llm.common import batch, free, ship, slices, small, stage
from gistline.llm.graph import components, find
from gistline.llm.words import grams, mix, text_bytes, word_hashes, word_spans

WORDS = 5
NUM, DEN = 4, 5  #: Similarity 0.8.
BUCKET_MEMBERS = 1_000_000  #: Set members that one task counts, about.
BLOCK = 512  #: Sets in a block.
PIVOTS = 64  #: Most shared classes of a large cluster that every block meets first.
VECTOR_BYTES = 64 << 20


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each text's begin."""
    raw, offsets = text_bytes(column)
    starts, stops, first = word_spans(raw, offsets)
    g, before = grams(word_hashes(raw, starts, stops), first, size)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(before))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(first)))


def digests(members: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets; 0 for empty ones."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(members ^ np.uint64(0x5851F42D4C957F2D)), begin[some]) + n[some].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64())])


def set_table(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            members, begin = shingle_sets(b.column("text"), size)
            yield batch(_SETS, doc_id=b.column("doc_id"), n=np.diff(begin), set_id=digests(members, begin))

    return docs.mapInArrow(run, "doc_id long, n long, set_id long")


_DEALT = pa.schema([(c, pa.int32() if c == "bucket" else pa.binary()) for c in ("bucket", "owners", "sizes", "members", "shared", "local", "counts")])


def deal_members(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Members by bucket: those of one class with the class, those of several classes of a task's step alone.

    For the latter, how many such members each class has goes to the class's own bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            members, begin = shingle_sets(b.column("text"), size)
            ids = digests(members, begin)
            _, keep = np.unique(ids, return_index=True)
            keep = np.sort(keep[np.diff(begin)[keep] > 0])
            own = np.zeros(len(ids), bool)
            own[keep] = True
            doc = np.repeat(np.arange(len(ids)), np.diff(begin))
            chosen = own[doc]
            m, doc = members[chosen], doc[chosen]
            order = np.argsort(m, kind="stable")
            m, doc = m[order], doc[order]
            same = np.zeros(len(m) + 1, bool)
            same[1:-1] = m[1:] == m[:-1]
            several = same[:-1] | same[1:]
            where = ((m >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            low = m.astype(np.uint32)
            single = ~several
            first_of = several & ~same[:-1]
            at = np.lexsort((doc[single], where[single]))
            w1, d1, v1 = where[single][at], doc[single][at], low[single][at]
            w2, v2 = where[first_of], low[first_of]
            local, counts = np.unique(doc[several], return_counts=True)
            w3 = local % buckets
            o3 = np.argsort(w3, kind="stable")
            w3, local, counts = w3[o3], local[o3], counts[o3]
            edges = np.arange(buckets + 1)
            s1, s2, s3 = (np.searchsorted(w, edges) for w in (w1, w2, w3))
            out = {f.name: [] for f in _DEALT}
            for k in range(buckets):
                if s1[k] == s1[k + 1] and s2[k] == s2[k + 1] and s3[k] == s3[k + 1]:
                    continue
                d, c = np.unique(d1[s1[k]:s1[k + 1]], return_counts=True)
                for name, value in zip(_DEALT.names, (
                        k, ids[d].tobytes(), c.astype(np.int32).tobytes(), v1[s1[k]:s1[k + 1]].tobytes(), v2[s2[k]:s2[k + 1]].tobytes(),
                        ids[local[s3[k]:s3[k + 1]]].tobytes(), counts[s3[k]:s3[k + 1]].astype(np.int64).tobytes())):
                    out[name].append(value)
            yield batch(_DEALT, **out)

    return docs.select("text").mapInArrow(run, ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in _DEALT))


_COUNTED = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
_REPEATED = pa.schema([("set_id", pa.int64()), ("repeated", pa.int64())])


def count_repeated(dealt: DataFrame, parts: int) -> DataFrame:
    """For each class, how many of its members other classes hold (a class seen by several tasks may get more).

    A bucket's counts travel packed, by parts of the classes, and are added up there.
    """
    def all_of(group: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    def run(group: pa.Table) -> pa.Table:
        owner = np.repeat(all_of(group, "owners", np.int64), all_of(group, "sizes", np.int32))
        member, shared = all_of(group, "members", np.uint32), np.unique(all_of(group, "shared", np.uint32))
        order = np.lexsort((owner, member))
        owner, member = owner[order], member[order]
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (owner[1:] != owner[:-1])
        owner, member = owner[new], member[new]
        again = np.zeros(len(member) + 1, bool)
        again[1:-1] = member[1:] == member[:-1]
        hit = again[:-1] | again[1:]
        if len(shared):
            hit |= shared[np.minimum(np.searchsorted(shared, member), len(shared) - 1)] == member
        ids, counts = np.unique(owner[hit], return_counts=True)
        ids, counts = np.concatenate([ids, all_of(group, "local", np.int64)]), np.concatenate([counts, all_of(group, "counts", np.int64)])
        part = (ids.view(np.uint64) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, order[cuts[p]:cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1]]
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([ids[o].tobytes() for _, o in rows], pa.binary()),
                         pa.array([counts[o].astype(np.int32).tobytes() for _, o in rows], pa.binary())], schema=_COUNTED)

    def add(group: pa.Table) -> pa.Table:
        ids, back = np.unique(all_of(group, "ids", np.int64), return_inverse=True)
        sums = np.bincount(back, all_of(group, "counts", np.int32), len(ids)).astype(np.int64)
        return pa.table([ids, sums], schema=_REPEATED)

    return dealt.groupBy("bucket").applyInArrow(run, "part int, ids binary, counts binary").groupBy("part").applyInArrow(add, "set_id long, repeated long")


_MEMBERS = pa.schema([("set_id", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])


def members_of(docs: DataFrame, size: int) -> DataFrame:
    """The sets of documents whose class (``set_id``) is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            members, begin = shingle_sets(b.column("text"), size)
            keep = np.flatnonzero(digests(members, begin) == b.column("set_id").to_numpy())
            n = np.diff(begin)[keep]
            at = np.arange(int(n.sum())) + np.repeat(begin[keep] - (np.cumsum(n) - n), n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(members[at].view(np.int64)))
            yield batch(_MEMBERS, set_id=b.column("set_id").take(pa.array(keep)), n=n, members=lists)

    return docs.select("set_id", "text").mapInArrow(run, "set_id long, n long, members array<long>")


def tree_links(targets: list[np.ndarray], probes: list[np.ndarray], num: int = NUM, den: int = DEN) -> Iterator[tuple[int, int]]:
    """Pairs (target, probe) of similar sets.

    Members are ranked by how many targets hold them, most first, so that similar targets share the
    beginning of their paths; the targets in order of their ranked members are the prefix tree read
    depth first. Along a path, ``over[d]`` has the overlap of each probe with the first d members. A
    probe of size m can still link with a target of size n when
    (num + den) * (overlap so far + members left) >= num * (n + m).
    """
    every = np.concatenate([*targets, np.zeros(0, np.int64)])
    names, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -counts))] = np.arange(len(names))
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in targets])])
    paths = [np.sort(rank[inverse[cuts[i]:cuts[i + 1]]]) for i in range(len(targets))]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i8").tobytes())
    longest = max([1, *map(len, paths)])
    step = max(1, min(len(probes), VECTOR_BYTES // (4 * (longest + 1))))
    for lo in range(0, len(probes), step):
        chunk = probes[lo:lo + step]
        sizes = np.array([len(p) for p in chunk], np.int64)
        flat = np.concatenate([*chunk, np.zeros(0, np.int64)])
        who = np.repeat(np.arange(len(chunk)), sizes)
        at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
        known = names[at] == flat if len(names) else np.zeros(0, bool)
        r, who = rank[at[known]], who[known]
        by = np.argsort(r, kind="stable")
        r, who = r[by], who[by]
        heads = np.searchsorted(r, np.arange(len(names) + 1))
        over = np.zeros((longest + 1, len(chunk)), np.int32)
        need = num * sizes
        best = np.full(longest + 1, -num * (sizes.min() if len(sizes) else 0), np.int64)  # of (num + den) * over - num * m
        previous, valid = np.zeros(0, np.int64), 0
        for i in order:
            path, n = paths[i], len(paths[i])
            common = min(n, len(previous), valid)
            if common:
                differs = np.flatnonzero(path[:common] != previous[:common])
                common = int(differs[0]) if len(differs) else common
            d, open_ = common, True
            # The bound along the shared part: deeper nodes only get worse for this target.
            if best[d] + (num + den) * (n - d) < num * n:
                previous, valid = path, d
                continue
            while d < n:
                a, z = heads[path[d]], heads[path[d] + 1]
                over[d + 1] = over[d]
                if a < z:
                    over[d + 1][who[a:z]] += 1
                d += 1
                if d % 8 == 0 or d == n:
                    best[d] = int(((num + den) * over[d].astype(np.int64) - need).max())
                    if best[d] + (num + den) * (n - d) < num * n:
                        open_ = False
                        break
                else:
                    best[d] = best[d - 1] + num + den  # an upper bound
            previous, valid = path, d
            if open_:
                o = over[n].astype(np.int64)
                for j in np.flatnonzero((num + den) * o >= num * (n + sizes)).tolist():
                    yield i, lo + j


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links of one task that connect its sets; ``side`` 0 are targets, 1 probes, 2 both."""
    side = group.column("side").to_numpy()
    ids = group.column("set_id").to_numpy()
    lists = group.column("members").combine_chunks()
    begin, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [values[begin[i]:begin[i + 1]] for i in range(len(ids))]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    up = {int(x): int(x) for x in ids}
    out = []
    for i, j in tree_links([sets[k] for k in left], [sets[k] for k in right], num, den):
        a, b = int(ids[left[i]]), int(ids[right[j]])
        x, y = find(up, a), find(up, b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=_LINKS)


def near_components(docs: DataFrame, size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Components of documents whose n-gram sets are similar.

    In: doc_id, text (more columns are ignored). Out: one row per row: doc_id, n_shingles,
    component_id. Equal sets share a component; texts without words, and null, have 0 shingles and
    their own doc_id as component; a null doc_id gets the least known doc_id of its component, or null;
    rows with equal doc_id are compared each with its own text; an empty table gives no rows.
    Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = stage(set_table(docs, size))
    classes = stage(sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))

    members = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-members // BUCKET_MEMBERS))
    repeated = count_repeated(deal_members(docs, size, buckets), max(1, buckets // 4))
    alive = stage(classes.join(repeated, "set_id").filter(F.col("repeated") * den >= F.col("n") * num).select("set_id", "doc_id"))
    wanted = small(alive.withColumnRenamed("doc_id", "_id"), 16)
    held = stage(members_of(docs.join(wanted, docs.doc_id.eqNullSafe(wanted["_id"])), size))

    links = stage(_cluster_links(held, num, den))
    roots = components(links)
    own = classes.join(roots, classes.set_id == roots.node, "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = own.join(least, "root").select("set_id", "component")
    return sets.join(named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _cluster_links(held: DataFrame, num: int, den: int) -> DataFrame:
    each = held.select("set_id", "n", F.explode("members").alias("member"))
    often = each.groupBy("member").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rest = each.join(often, "member")
    by_set = Window.partitionBy("set_id")
    # Members that no other set holds come first in the order; the others fill what is left of the
    # n - ceil(n * num / den) + 1 first places.
    first = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    heads = (
        rest.withColumn("place", F.row_number().over(by_set.orderBy("df", "member")))
        .withColumn("alone", F.col("n") - F.count(F.lit(1)).over(by_set))
        .filter(F.col("place") + F.col("alone") <= first).select("member", "set_id", "alone"))
    heads = stage(heads)
    pivots = heads.groupBy("member").agg(F.min(F.struct("alone", "set_id"))["set_id"].alias("pivot"))
    near = stage(heads.join(pivots, "member").filter("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("n")))
    clusters = components(near.select("set_id", "pivot")).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = stage(
        clusters.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")))

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(held.select("set_id", "members"), "set_id").groupBy("cluster", "x", "y").applyInArrow(
            lambda group: _linked(group, num, den), "a long, b long")

    inside = placed.select("cluster", F.col("block").alias("x"), F.lit(-1).alias("y"), "set_id", F.lit(2).alias("side"))
    if placed.filter("blocks > 1").isEmpty():
        return joined(inside)
    large = placed.filter("blocks > 1")
    rank = Window.partitionBy("cluster").orderBy(F.desc("n"), "pivot")
    popular = (
        near.groupBy("pivot").agg(F.sum("n").alias("n")).join(clusters.withColumnRenamed("set_id", "pivot"), "pivot")
        .withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= PIVOTS))
    blocks = large.select("cluster", "block").distinct()
    guests = popular.join(blocks, "cluster").select(
        "cluster", F.col("block").alias("x"), F.lit(-1).alias("y"), F.col("pivot").alias("set_id"), F.lit(0).alias("side"))
    found = stage(joined(inside.unionByName(guests)))
    roots = components(found)
    labelled = large.join(roots, large.set_id == roots.node, "left").select("cluster", "block", "set_id", F.coalesce("root", "set_id").alias("root"))
    groups = labelled.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    others = labelled.join(main, "cluster").filter("root <> main").select("cluster", "set_id")
    dealt = others.join(others.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "cluster").withColumn(
        "y", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col("parts")).cast("int"))
    dealt = stage(dealt)
    probes = dealt.join(blocks, "cluster").select("cluster", F.col("block").alias("x"), "y", "set_id", F.lit(1).alias("side"))
    targets = labelled.join(dealt.select("cluster", "y").distinct(), "cluster").select("cluster", F.col("block").alias("x"), "y", "set_id", F.lit(0).alias("side"))
    return found.unionByName(joined(probes.unionByName(targets)))


def one_of_each(docs: DataFrame, size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` (with all its columns), of each component only the row with the least doc_id, null last.

    Rows are told apart by doc_id and text, so two texts under one doc_id are two documents, and a row
    without a doc_id stays only where no named row is like it. Of rows equal in both one stays. Texts
    without words, and null, are like nothing and stay.
    """
    row, name = free(docs, "_row"), free(docs, "_id")
    ids = docs.doc_id.cast("long")
    keyed = docs.withColumn(row, F.xxhash64(ids.isNull(), ids, F.coalesce("text", F.lit(""))))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    again = stage(keyed.filter(~wordless).groupBy(F.col(row).alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(name))
    repeats = small(again, 8)
    once = keyed.join(repeats, F.col(row) == F.col(name), "left_anti").unionByName(
        keyed.join(repeats, F.col(row) == F.col(name), "left_semi").dropDuplicates([row]))
    known = near_components(once.select(F.col(row).alias("doc_id"), "text"), size, num, den).filter("n_shingles > 0")
    named = once.select(F.col(row).alias("_r"), F.col("doc_id").cast("long").alias("_d"))
    members = stage(known.join(named, known.doc_id == named["_r"]).select("component_id", "_r", "_d"))
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("_d").isNull().alias("unnamed"), "_d", "_r"))["_r"].alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = stage(members.join(first, "component_id").filter("_r <> _first").select(F.col("_r").alias(name)))
    return once.join(small(gone, 8), F.col(row) == F.col(name), "left_anti").drop(row)
