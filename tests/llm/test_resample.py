import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gistline.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, longest=1, buckets=10000):
    def count(texts):
        out = collections.Counter()
        for t in texts:
            out.update(zlib.crc32(f.encode()) % buckets for f in features(t, longest)[1])
        return out

    s, t = count(x for _, x in docs), count(target)
    a, b = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        words, fs = features(text, longest)
        w = sum(math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in (zlib.crc32(f.encode()) % buckets for f in fs))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    ranks = collections.defaultdict(list)
    for i, r in enumerate(able[:drawn], 1):
        ranks[r].append(i)
    return collections.Counter((*r[:4], ranks[r].pop() if ranks[r] else None) for r in rows)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 45)])
def test_equals_brute_force(spark, docs_of, odd_pairs, longest, percent):
    pairs = odd_pairs + [(100 + i, "Same Words here, " * 9) for i in range(12)] + [(13, "ÀB\x00c9—d " * 30), (60, "x" * 200_000 + " y")]
    target = ["Some w1 w2 words w3", None, "", "w5 " * 40]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample.resample(docs_of(pairs), bench, percent=percent, longest=longest).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == brute(pairs, target, percent, longest=longest)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs_of([(1, "a")]).limit(0), none).collect() == []
    pairs = [(i, "a b " * i) for i in range(40)]
    assert collections.Counter(tuple(r) for r in resample.resample(docs_of(pairs), none).collect()) == brute(pairs, [])


def test_pieces_do_not_change_words(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice("abz09éß漢😀AZ \t\n.,-_~\x00{@") for _ in range(5000)).lower()
    whole = [(m.group(), m.start()) for m in WORD.finditer(text)]
    for piece in (1, 7, 100):
        monkeypatch.setattr(resample, "PIECE", piece)
        assert [x for ws, at in resample.words_of(text) for x in zip(ws, at)] == whole


def test_parts_do_not_change_counts(monkeypatch):
    texts = [t.encode() for t in ("a b c d e f g h " * 30, "", "x", "a b " * 50)]
    for longest in (1, 2, 4):
        monkeypatch.setattr(resample, "PART", 1 << 17)
        whole = resample.Features(longest, 50).count(texts)
        monkeypatch.setattr(resample, "PART", 3)
        monkeypatch.setattr(resample, "PIECE", 5)
        for x, y in zip(whole, resample.Features(longest, 50).count(texts)):
            assert np.array_equal(x, y)
