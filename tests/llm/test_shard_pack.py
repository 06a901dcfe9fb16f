import collections
import math
import zlib

import xxhash
import zlib as crc

from gistline.llm import pack, shard
from gistline.llm.tokens import default_path, encoder


def draw(name, key):
    seed = 42
    for part in (name, key):
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return -math.log(((seed >> 11) + 0.5) / 2**53)


def walk(tree, key):
    node = tree
    while True:
        named = [(k if isinstance(k, str) else f"shard{k}", k) for k in node if shard.weight(node[k]) > 0]
        best = min(named, key=lambda n: draw(n[0], key) / shard.weight(node[n[1]]))[1]
        if not isinstance(node[best], dict):
            return best
        node = node[best]


def test_place_follows_the_draws_and_weights(spark):
    tree = {"a": {"a/1": {0: 1.0, 1: 3.0}, "a/2": {2: 2.0}}, "b": {"b/1": {3: 2.0, 4: 0.0}}}
    rows = {r["k"]: r["s"] for r in shard.place(spark.range(4000).withColumnRenamed("id", "k"), tree, "k", "s").collect()}
    assert all(rows[k] == walk(tree, str(k)) for k in range(0, 4000, 7))
    n = collections.Counter(rows.values())
    assert 4 not in n and abs(n[1] / n[0] - 3) < 0.6 and abs((n[0] + n[1] + n[2]) / n[3] - 3) < 0.4


def test_movement_stays_in_changed_subtrees(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    before = shard.standard_tree(16)
    heavier = {r: {k: dict(s) for k, s in x.items()} for r, x in before.items()}
    heavier["region1"]["region1/rack0"][4] = 3.0
    old = {r["k"]: r["s"] for r in shard.place(rows, before, "k", "s").collect()}
    new = {r["k"]: r["s"] for r in shard.place(rows, heavier, "k", "s").collect()}
    moved = [(old[k], new[k]) for k in old if old[k] != new[k]]
    assert moved and all(z in (4, 5, 6, 7) for _, z in moved)  # all inside the region that became heavier
    more = {r["k"]: r["s"] for r in shard.place(rows, shard.standard_tree(18), "k", "s").collect()}
    one = {r["k"]: r["s"] for r in shard.place(rows, shard.standard_tree(17), "k", "s").collect()}
    assert all(one[k] in (old[k], 16) and more[k] in (one[k], 17) for k in old)


def test_shard_rows(docs_of, odd_pairs):
    got = shard.shard_rows(docs_of(odd_pairs), buckets=3).collect()
    assert len(got) == len(odd_pairs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (d, len((t or "").encode()) + 1, crc.crc32((t or "").encode())) for d, t in odd_pairs)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert shard.shard_rows(docs_of([(1, "x")]).limit(0)).collect() == []


def test_patterns_hold_every_piece_once():
    for histogram in ({5: 3, 4: 9, 1: 40}, {10: 2}, {7: 5, 3: 1}, {1: 25}, {6: 100, 4: 101, 2: 1}):
        patterns = pack.shortest_pack_first(histogram, 10)
        assert all(sum(p) <= 10 and c > 0 for c, p in patterns)
        held = collections.Counter()
        for c, p in patterns:
            for x in p:
                held[x] += c
        assert held == collections.Counter(histogram)


def test_pack(docs_of, odd_pairs):
    got = pack.pack(docs_of(odd_pairs), size=64).collect()
    enc = encoder(default_path())
    want = collections.Counter()
    for d, t in odd_pairs:
        ids = [*enc.plain([t or ""])[0].tolist(), 1]
        for a in range(0, len(ids), 64):
            part = ids[a:a + 64]
            want[d, a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack.pack(docs_of([(1, "x")]).limit(0)).collect() == []
