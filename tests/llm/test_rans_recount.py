import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistline.llm import rans, recount
from gistline.llm.tokens import default_path, encoder


@pytest.mark.parametrize("n", [0, 1, 5, rans.LANES, rans.LANES + 1, 200_000])
def test_block_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = rans.encode_block(ids, np.array([3, 9]), np.array([n // 2, n - n // 2]), table)
    docs, counts, back = rans.decode_block(block, table)
    assert np.array_equal(back, ids) and docs.tolist() == [3, 9] and counts.sum() == n
    p = rans.parts_of(block)
    parts = [rans.decode_from(p, k, table) for k in range(len(p["places"]))]  # each checkpoint by itself
    assert np.array_equal(np.concatenate([*parts, np.zeros(0, np.uint32)]), ids)


def test_table_with_many_rare_ids():
    table = rans.Table(np.arange(60_000), np.r_[10**9, np.ones(59_999, np.int64)])
    assert int(table.freq.sum()) == 1 << table.bits and table.freq.min() == 1


def test_damage_is_seen():
    ids = np.arange(1000, dtype=np.uint32) % 7
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = bytearray(rans.encode_block(ids, np.array([1]), np.array([1000]), table))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block), table)
    other = rans.Table(np.arange(7), np.arange(1, 8) * 100)
    with pytest.raises(ValueError):
        rans.decode_block(rans.encode_block(ids, np.array([1]), np.array([1000]), other), table)


def test_files(docs_of, odd_pairs, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 500)
    got = rans.round_trip(docs_of(odd_pairs)).collect()
    enc = encoder(default_path())
    want = sorted(((-1 if d is None else d), len(i := [*enc.plain([t or ""])[0].tolist(), 2]), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for d, t in odd_pairs)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or last <= r.doc_id)
        at, last = at + r.n_tokens, r.doc_id
    assert rans.round_trip(docs_of([(1, "x")]).limit(0)).collect() == []


def test_edits_against_full_encoding():
    r = random.Random(3)
    parts = ["word ", "a", "B", "é ", "1", "12 ", " ", "  ", "\n", "\n\n", "'", "'s", "'ll ", "don't ", "!! ", "thing, "]
    make = lambda n: "".join(r.choice(parts) for _ in range(n))
    enc = encoder(default_path())
    for _ in range(150):
        text = make(r.choice([0, 3, 40, 700, 1500]))
        ((chars, tree),) = recount.build(enc, [text])
        for _ in range(4):
            a = r.randint(0, len(text))
            z = min(len(text), a + r.choice([0, 1, 5, 300]))
            text, chars, tree, encoded = recount.apply_edit(enc, text, chars, tree, a, z, make(r.choice([0, 1, 4, 50])))
            assert tree[0] == len(enc.plain([text])[0]) and chars.sum() == len(text)
            width = (len(tree) + 1) // 2
            assert all(tree[i] == tree[2 * i + 1] + tree[2 * i + 2] for i in range(width - 1))


def test_small_edit_of_a_long_text_reads_little():
    enc = encoder(default_path())
    text = "some words of a text, " * 20_000
    ((chars, tree),) = recount.build(enc, [text])
    edited, _, tree, encoded = recount.apply_edit(enc, text, chars, tree, 200_000, 200_003, "new")
    assert encoded < 2500 and tree[0] == len(enc.plain([edited])[0])


def test_recount(docs_of, odd_pairs):
    docs = docs_of(odd_pairs)
    edits = recount.own_edits(docs)
    got = recount.recount(recount.count_trees(edits)).collect()
    enc = encoder(default_path())
    want = []
    for e in edits.collect():
        t = e.text or ""
        a, z = e.edit_start, min(e.edit_stop, len(t))
        new = t[:a] + e.edit_text + t[z:]
        want.append((e.doc_id or -1, len(t), len(enc.plain([t])[0]), len(new), len(enc.plain([new])[0])))
    assert sorted((r.doc_id or -1, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in got) == sorted(want)
    wild = edits.withColumn("edit_start", F.lit(None).cast("long")).withColumn("edit_stop", F.lit(10**9)).withColumn("edit_text", F.lit(None).cast("string"))
    assert {r.edited_tokens for r in recount.recount(recount.count_trees(wild)).collect()} == {0}
    assert recount.recount(recount.count_trees(edits.limit(0))).collect() == []
