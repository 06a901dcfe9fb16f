"""The prefix trie of conversations, by vertical bitmaps.

A shard holds a range of conversations and, for very long ones, a range of positions. It indexes each
(position, turn) to the bitset of the conversations that have that turn there. Starting from all its
conversations, a bitset is intersected with the postings of the next position, depth first; each
intersection is a child, its popcount the members, its meeting with the conversations that end there
the end list. A node's name, a 128-bit hash of its turns, is the same in every shard, so counts of
shards add up. Numbers below a node are summed over the nodes that have at least two members, by
doubling the steps upwards; below a node with one member there is a single path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gistline.llm.common import batch, number_in_order, small, stage

ROWS = 8192  #: Turns of the conversations of one shard, about.
DEPTH = 8192  #: Positions of one shard; longer conversations go on in the next.
STRANGERS = 100  #: Conversations that share a beginning: those with the same number of hundreds.
HEADS = 6  #: A beginning has fewer turns than this.
_NOTHING = hashlib.sha256().hexdigest()
_NODE = "ka long, kb long, depth long, pa long, pb long, n long, conv long, chars long, ends string, shard long"
_NODE_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODE.split(", ")])


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, a, b, chars, row): turns as 128-bit hashes, numbered by conversation and turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    return number_in_order(turns, "row", *order).drop("turn")


def rebuild(turns: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed beginnings: (conv_id, shard, total), and their turns by position.

    Conversation c takes the first h turns of c - c % 100 in place of its own first h. Rows of the
    second table: conv_id, shard, pos (from 1), total, a, b, chars; a conversation without turns has
    one row with pos 0.
    """
    first = Window.partitionBy("conv_id").orderBy("row")
    heads = (
        turns.filter(F.col("conv_id") % STRANGERS == 0).withColumn("_at", F.row_number().over(first)).filter(F.col("_at") < HEADS)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("_at", "a", "b", "chars"))).alias("head")))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(HEADS)).cast("int")
    convs = turns.groupBy("conv_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("own")).select(
        "*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % STRANGERS).alias("base"))
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least(F.col("h"), F.size("head")))
    convs = stage(
        convs.join(heads, "base", "left").withColumn("taken", taken)
        .select("conv_id", "first", "h", "taken", F.floor(F.col("first") / rows).alias("shard"),
                (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"),
                F.when(F.col("taken") > 0, F.slice("head", F.lit(1), F.col("taken"))).alias("head")))
    at = F.col("row") - F.col("first") + 1
    own = turns.join(convs.drop("head"), "conv_id").filter(at > F.col("h")).select(
        "conv_id", "shard", (F.col("taken") + at - F.col("h")).alias("pos"), "total", "a", "b", "chars")
    borrowed = convs.filter("taken > 0").select("conv_id", "shard", "total", F.explode("head").alias("t")).select(
        "conv_id", "shard", F.col("t._at").cast("long").alias("pos"), "total", "t.a", "t.b", "t.chars")
    none = convs.filter("total = 0").select(
        "conv_id", "shard", F.lit(0).cast("long").alias("pos"), "total", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "chars")])
    return convs.select("conv_id", "shard", "total"), own.unionByName(borrowed).unionByName(none)


def local_nodes(turns: DataFrame, longest: int, depth: int = DEPTH) -> DataFrame:
    """The nodes of each shard, with its own members, ends and least conversation."""
    name = [F.xxhash64(F.lit(k), "pos", "a", "b") for k in (3, 4)]
    some = F.col("pos") > 0
    rows = turns.select(
        "conv_id", "shard", "pos", "chars", (F.col("pos") == F.col("total")).alias("last"),
        *[F.when(some, n).otherwise(F.lit(0)).alias(c) for n, c in zip(name, ("ma", "mb"))],
        F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / depth).alias("block"))
    if longest > depth:  # a conversation goes on where its turns of the blocks before lead
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        lead = (
            rows.groupBy("conv_id", "block").agg(F.bit_xor("ma").alias("xa"), F.bit_xor("mb").alias("xb"))
            .select("conv_id", "block", F.bit_xor("xa").over(before).alias("ea"), F.bit_xor("xb").over(before).alias("eb"))
            .filter("block > 0"))
        rows = rows.join(lead, ["conv_id", "block"], "left").fillna(0, ["ea", "eb"])
    else:
        rows = rows.withColumns({"ea": F.lit(0).cast("long"), "eb": F.lit(0).cast("long")})

    def run(piece: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_shard(piece, depth)])

    return rows.groupBy("shard", "block").applyInArrow(run, _NODE)


def _bitset(members: np.ndarray) -> int:
    if len(members) == 1:
        return 1 << int(members[0])
    bits = np.zeros(int(members.max()) + 1, np.uint8)
    bits[members] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _members(bits: int) -> np.ndarray:
    if bits.bit_count() == 1:
        return np.array([bits.bit_length() - 1])
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _postings(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A number for each row, the same where all columns agree, and the rows of each number."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.split(order, np.flatnonzero(new)[1:])


def _shard(piece: pa.Table, depth: int) -> pa.RecordBatch:
    col = {c: piece.column(c).to_numpy() for c in ("conv_id", "pos", "ma", "mb", "chars", "last", "ea", "eb")}
    block, shard = piece.column("block")[0].as_py(), piece.column("shard")[0].as_py()
    order = np.lexsort((col["pos"], col["conv_id"]))
    col = {c: v[order] for c, v in col.items()}
    ids, begin, member = np.unique(col["conv_id"], return_index=True, return_inverse=True)
    top = block * depth  # depth of the nodes this shard starts from
    turn = col["pos"] > 0
    row_of = np.flatnonzero(turn)
    number, rows = _postings(col["mb"][turn], col["ma"][turn], col["pos"][turn])
    posting = np.zeros(len(member), np.int64)
    posting[row_of] = number
    index = [_bitset(member[row_of[r]]) for r in rows if len(r)]
    ends: dict[int, int] = {}
    lasts = np.flatnonzero(col["last"])
    for p in np.unique(col["pos"][lasts]):
        ends[int(p)] = _bitset(member[lasts[col["pos"][lasts] == p]])
    _, starts = _postings(col["eb"][begin], col["ea"][begin])
    begin, posting = begin.tolist(), posting.tolist()
    ma, mb, chars, all_ids = col["ma"].tolist(), col["mb"].tolist(), col["chars"].tolist(), ids.tolist()
    out: list[tuple] = []
    stack: list[tuple] = []
    for who in starts:
        ea, eb = (int(col[c][begin[who[0]]]) for c in ("ea", "eb"))
        stack.append((_bitset(who), top, ea, eb, None, None, 0))
    while stack:
        here, d, ka, kb, pa_, pb_, size = stack.pop()
        ended = here & ends.get(d, 0)
        if d > top or not block:  # the shard above has given the nodes that this one starts from
            done = ",".join(map(str, ids[_members(ended)].tolist())) if ended else None
            out.append((ka, kb, d, pa_, pb_, here.bit_count(), all_ids[(here & -here).bit_length() - 1], size, done, shard))
        rest = here & ~ended if d < top + depth else 0
        while rest:
            one = (rest & -rest).bit_length() - 1
            row = begin[one] + d - top
            child = rest & index[posting[row]]
            stack.append((child, d + 1, ka ^ ma[row], kb ^ mb[row], ka, kb, chars[row]))
            rest ^= child
    return batch(_NODE_ARROW, **dict(zip(_NODE_ARROW.names, map(list, zip(*out)) if out else [[]] * len(_NODE_ARROW))))


def _end_hashes(chunks: DataFrame) -> DataFrame:
    """(ka, kb, depth, sha) of end lists that come in parts, part by part, so that no list is ever held whole."""
    schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            done = []
            for ka, kb, d, text in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "depth", "ends"))):
                if (ka, kb, d) != node:
                    if node:
                        done.append((*node, h.hexdigest()))
                    node, h = (ka, kb, d), hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, h.hexdigest())))], schema)

    dealt = chunks.select("ka", "kb", "depth", "shard", "ends").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "depth", "shard")
    return dealt.mapInArrow(run, "ka long, kb long, depth long, sha string")


def sums_below(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """(ka, kb, *sums) summed over each node and all below it; ``nodes`` has pa, pb, null at the top.

    Each round adds what is exactly so many steps below and doubles the steps, so a tree of depth d
    takes log2(d) + 1 rounds. Partial sums come before the shuffle: a node with very many children is
    no hot spot there.
    """
    tree = stage(nodes.select("ka", "kb", F.col("pa").alias("ua"), F.col("pb").alias("ub"), *sums))
    for _ in range(deepest.bit_length()):
        more = tree.filter("ua is not null").groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        above = tree.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("ua").alias("_ua"), F.col("ub").alias("_ub"))
        tree = stage(
            tree.join(more, ["ka", "kb"], "left").join(above, ["ua", "ub"], "left")
            .select("ka", "kb", F.col("_ua").alias("ua"), F.col("_ub").alias("ub"), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]))
    return tree.drop("ua", "ub")


def trie(conversations: DataFrame, rows: int = ROWS, depth: int = DEPTH) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    In: conv_id, turn, role, text (more columns are ignored). Out, one row per node: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns of a conversation
    come by turn, null first, equal ones by a hash of role and text; a repeated row is a further turn. Null role
    or text is empty. Rows without a conv_id belong to no conversation and are left out. A remainder
    has the sign of its number, so conversation -7 begins like 0. An empty table has no
    node. Turns are told apart by 128 bits. ``rows`` and ``depth`` bound what one task holds.
    """
    convs, turns = rebuild(own_turns(conversations), rows)
    longest = convs.agg(F.max("total")).first()[0] or 0
    local = stage(local_nodes(turns, longest, depth))
    merged = stage(
        local.groupBy("ka", "kb", "depth").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("chars").alias("chars"),
            F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max(F.col("ends").isNotNull()).alias("ended")))
    shared = stage(merged.filter("n > 1"))
    parents = shared.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("up"))
    # A node whose parent is not shared has that parent's only member.
    named = stage(merged.join(small(parents, 64), ["pa", "pb"], "left"))
    children = named.filter("up is not null").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("alone"))
    shared = stage(
        shared.join(children, ["ka", "kb"], "left").fillna(0, ["n_children", "alone"])
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("alone")).cast("long"))
        .withColumn("saved_tokens", (F.col("n") - 1) * F.col("chars")))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    below = sums_below(shared, ["n_leaves", "saved_tokens"], deepest)
    keys = shared.filter("ended").select("ka", "kb")
    hashes = _end_hashes(local.filter("ends is not null").join(small(keys, 48), ["ka", "kb"], "left_semi"))
    many = (
        named.filter("n > 1").join(shared.select("ka", "kb", "n_children"), ["ka", "kb"]).join(below, ["ka", "kb"])
        .join(hashes.drop("depth"), ["ka", "kb"], "left"))
    one = named.filter("n = 1").select(
        "*", F.when(F.col("ended"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("ended"), F.sha2(F.col("conv").cast("string"), 256)).alias("sha"))

    def out(df: DataFrame) -> DataFrame:
        parent: Column = F.when(F.col("depth") > 0, F.coalesce("up", "conv"))
        return df.select(
            F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
            "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"))

    return out(many).unionByName(out(one))
