import collections
import hashlib
import random

import numpy as np
import pytest

from gistline.llm import suffix


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return data, out


def expected(pairs, length):
    rows = []
    for (d, _), b, gone in zip(pairs, *covered([t for _, t in pairs], length)):
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return rows


def same(got, want):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_difference_cover(spark, monkeypatch):
    monkeypatch.setattr(suffix, "FEW", 0)  # recursion to the end
    monkeypatch.setattr(suffix, "HALO", 8)
    r = random.Random(2)
    for symbols, sizes in ((2, [1, 2, 3, 7, 20]), (1, [9, 4, 4])):
        strings = {i: [r.randrange(1, symbols + 1) for _ in range(n)] for i, n in enumerate(sizes)}
        got = {x.sid: x.ranks for x in suffix.difference_cover(spark.createDataFrame([(k, s, [1] * len(s)) for k, s in strings.items()], "sid long, syms array<long>, sizes array<long>")).collect()}
        suffixes = sorted((s[i:], got[k][i]) for k, s in strings.items() for i in range(len(s)))
        for (a, x), (b, y) in zip(suffixes, suffixes[1:]):
            assert a == b or x < y


def test_last_step():
    r = random.Random(3)
    for symbols in (1, 2, 9):
        strings = [np.array([r.randrange(symbols) for _ in range(n)]) for n in (0, 1, 5, 30, 12, 12)]
        ranks = suffix.local_ranks(strings)
        suffixes = sorted((s[i:].tolist(), int(x[i])) for s, x in zip(strings, ranks) for i in range(len(s)))
        assert [x for _, x in suffixes] == list(range(60)) and all(a == b or x < y for (a, x), (b, y) in zip(suffixes, suffixes[1:]))


def test_window_minima():
    h = np.random.default_rng(1).integers(0, 5, 60).astype(np.uint64) << np.uint64(50)
    for w in (1, 2, 5, 7, 16, 60, 61):
        want = [max(j for j in range(i, i + w) if h[j] == h[i:i + w].min()) for i in range(60 - w + 1)]
        assert suffix.window_minima(h, w).tolist() == want


@pytest.mark.parametrize(("length", "seed", "few"), [(20, 1, 1 << 16), (40, 2, 200), (9, 3, 1 << 16)])
def test_against_brute_force(docs_of, monkeypatch, length, seed, few):
    """Shared passages at any place, edits, copies, periodic texts and overlaps inside one text."""
    monkeypatch.setattr(suffix, "FEW", few)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(1, 9)))
    passages = ["".join(word() for _ in range(r.randrange(3, 40))) for _ in range(6)]
    pairs = []
    for i in range(40):
        parts = [r.choice(passages)[r.randrange(5):] if r.random() < 0.4 else word() * r.choice([1, 1, 1, 9]) for _ in range(r.randrange(12))]
        pairs.append((i, "".join(parts)))
    pairs += [(100, pairs[3][1]), (101, "ab" * 60), (102, "xab" + "ab" * 40 + "y"), (103, "z" * 200)]
    same(suffix.remove_repeats(docs_of(pairs), length).collect(), expected(pairs, length))


def test_odd_rows(docs_of, odd_pairs):
    same(suffix.remove_repeats(docs_of(odd_pairs), 120).collect(), expected(odd_pairs, 120))
    assert suffix.remove_repeats(docs_of([(1, "x")]).limit(0)).collect() == []


def test_without_passages(docs_of, odd_pairs):
    docs = docs_of(odd_pairs)
    out = suffix.without_passages(docs, 120, 20)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    want = collections.Counter()
    for (d, t), b, gone in zip(odd_pairs, *covered([t for _, t in odd_pairs], 120)):
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2)
        cut = [(a, z) for a, z in edges if len(b[a:z].split()) >= 20]
        kept = b"".join(b[a:z] for a, z in zip([0, *[z for _, z in cut]], [*[a for a, _ in cut], len(b)])).decode("utf-8", "ignore")
        if not cut:
            want[d, t] += 1
        elif kept.strip():
            want[d, kept] += 1
    assert got == want


def test_agreements_hold_only_whole_matches(spark, monkeypatch):
    """Suffixes that agree for fewer bytes give no rows, equal ones do across the borders of tasks."""
    monkeypatch.setattr(suffix, "FEW", 0)
    strings = [(i, i, [5, 6, 7 + i % 2, 9], [10, 10, 10, 10], [0, 10, 20, 30]) for i in range(40)]
    rows = spark.createDataFrame(strings, "sid long, tid long, syms array<long>, sizes array<long>, pos array<int>")
    got = {tuple(x) for x in suffix.agreements(rows, 25).collect()}
    assert got == {(i, p, 30) for i in range(40) for p in (0, 10)}


def test_recursion_takes_open_names_only(spark, monkeypatch):
    """Names that occur once, or cover the length, are not handed down."""
    monkeypatch.setattr(suffix, "FEW", 0)
    handed, solve = [], suffix.difference_cover

    def counted(strings, length):
        handed.append(sum(len(x.syms) for x in strings.collect()))
        return solve(strings, length)

    monkeypatch.setattr(suffix, "difference_cover", counted)
    alone = list(range(1000, 1300))
    strings = [(0, alone + [1, 2, 3, 4, 5], [9] * 305), (1, list(range(2000, 2300)) + [1, 2, 3, 4, 6], [9] * 305)]
    out = suffix._ranks(spark.createDataFrame(strings, "sid long, syms array<long>, sizes array<long>"), 40)
    got = {x.sid: x.ranks for x in out.collect()}
    suffixes = sorted((s[i:], got[k][i]) for k, s, _ in strings for i in range(len(s)))
    assert all(x < y for (_, x), (_, y) in zip(suffixes, suffixes[1:]))
    assert handed and sum(handed) < 20
