import collections
import hashlib
import random
import zlib

from gistline.llm import forest

SCHEMA = "conv_id long, turn int, role string, text string, pos long, shard string, a int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in who if full[c] == p))).encode()).hexdigest())
        for p, who in members.items())


def got(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def conversations(seed, n, words=3, longest=9):
    r = random.Random(seed)
    rows = []
    for c in [*r.sample(range(600), n), -7, -250, 10**15 + 3]:
        turns = list(range(r.randrange(1, longest)))
        rows += [(c, None if t == 0 and r.random() < 0.1 else t, r.choice(["user", None]), r.choice(["é" * 5, "b", "", None][:words])) for t in turns]
    return rows


def test_nodes_equal_brute_force(spark):
    rows = conversations(1, 120)
    rows += [(None, 1, "user", "nobody's"), (700, None, None, None)]
    assert got(forest.trie(table(spark, rows))) == brute(rows)


def test_shards_and_blocks_add_up(spark):
    """Many small shards, conversations over several blocks of positions, copies, very common turns."""
    rows = conversations(2, 60, words=2, longest=14)
    copies = [(c, t, "user", f"t{t}") for c in range(1000, 1120) for t in range(7)]
    long = [(c, t, "user", "x" * (t % 3)) for c in (2000, 2300, 2301) for t in range(90 + c % 7)]
    rows += copies + long + [(2500, 3, "user", "twice"), (2500, 3, "user", "twice")]
    assert got(forest.trie(table(spark, rows), rows=40, depth=4)) == brute(rows)


def test_one_conversation_and_none(spark):
    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", "yes")]
    assert got(forest.trie(table(spark, rows))) == brute(rows)
    assert forest.trie(table(spark, rows).limit(0)).collect() == []


def test_a_conversation_with_most_turns_is_in_many_tasks(spark):
    rows = spark.range(20000).selectExpr("if(id % 3 = 0, id, 9) AS conv_id", "id AS turn", "'u' AS role", "'same' AS text")
    turns = forest.own_turns(rows.repartition(8))
    assert turns.count() == 20000 and turns.agg({"row": "max"}).first()[0] == 19999
    assert forest.trie(rows, rows=500, depth=500).filter("depth = 0").first()["n_convs"] == turns.select("conv_id").distinct().count()
