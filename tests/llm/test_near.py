import collections
import random

import numpy as np
import pytest

from gistline.llm import graph, trie
from tests.llm.conftest import prose


def shingles(text, size=5):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(pairs):
    """(doc_id, set size, component) of each row; the least id that is not null names a component."""
    sets = [shingles(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(pairs):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets))]


def same(got, want):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_tree_links(monkeypatch):
    r, rng = random.Random(1), np.random.default_rng(2)
    for _ in range(40):
        base = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(6)]
        sets = []
        for _ in range(40):
            b = base[rng.integers(6)]
            s = set(b[rng.random(len(b)) > rng.choice([0, .05, .15])].tolist()) | set(rng.choice(400, rng.integers(0, 4)).tolist())
            if s:
                sets.append(np.array(sorted(s)))
        left, right = sets[:20], sets[20:]
        monkeypatch.setattr(trie, "VECTOR_BYTES", r.choice([1, 5000, 1 << 20]))
        want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)))
        assert sorted(trie.tree_links(left, right)) == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1030)] + [(-5, 7), (-5, -5)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()}
    up = graph.union(e for e in edges if e[0] != e[1])
    assert got == {x: graph.find(up, x) for x in up}
    assert graph.components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_near_components(docs_of, odd_pairs):
    same(trie.near_components(docs_of(odd_pairs)).collect(), brute(odd_pairs))
    assert trie.near_components(docs_of([(1, "x")]).limit(0)).collect() == []
    same(trie.near_components(docs_of([(1, None), (2, "")])).collect(), [(1, 0, 1), (2, 0, 2)])


@pytest.mark.parametrize("block", [4, 512])
def test_near_copies_in_blocks(docs_of, monkeypatch, block):
    """Chains of edits, copies, and a passage that all texts share; clusters of several blocks."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PIVOTS", 2)
    monkeypatch.setattr(trie, "BUCKET_MEMBERS", 500)
    r = random.Random(8)
    passage, pairs = prose(77, 40), []
    for g in range(4):
        text = prose(100 + g, 80).split(" ")
        for _ in range(14):
            if r.random() < 0.6:
                text = list(text)
                text[r.randrange(len(text))] = f"x{r.randrange(9)}"
            pairs.append((r.randrange(10_000) * 100 + len(pairs), " ".join(text) + " " + passage))
    same(trie.near_components(docs_of(pairs, 4)).collect(), brute(pairs))


def survivors(pairs):
    """One row of each component of rows, the least doc_id, null last; rows equal in both count once, wordless ones each."""
    rows = [p for i, p in enumerate(pairs) if p not in pairs[:i] or not (p[1] or "").strip()]
    least = {}
    for i, n, c in brute(list(enumerate(t for _, t in rows))):
        key = (rows[i][0] is None, rows[i][0] or 0, i)
        least[c if n else (i,)] = min(key, least.get(c if n else (i,), key))
    return collections.Counter(rows[k[2]] for k in least.values())


def test_one_of_each(docs_of, odd_pairs):
    text, other = prose(40, 80), prose(41, 60)
    lost = [(None, text), (None, text), (90, text), (91, other), (91, text + " more"), (None, other), (92, "same words"), (92, "other words"),
            (None, prose(42, 30)), (93, prose(42, 30) + "  "), (None, ""), (None, "")]
    for pairs in (odd_pairs, odd_pairs + lost, [(1, None), (1, None)]):
        docs = docs_of(pairs)
        kept = trie.one_of_each(docs)
        assert kept.columns == docs.columns
        assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == survivors(pairs)
    assert trie.one_of_each(docs_of([(1, "x")]).limit(0)).collect() == []
