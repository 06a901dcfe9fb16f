import collections
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gistline.llm import queries, toxic, trie
from tests.llm.conftest import prose

BAD = ["grobble", "snarfy", "vexilish"]
LABELS = "doc_id long, quality int, toxic int, text string, lang string"


def corpus(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.25
        words = prose(seed * 100_000 + i, r.randrange(15, 160)).split(" ")
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD) if r.random() < 0.7 else "Quorv" + r.choice("abcdef") + r.choice("xyz"))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def small(spark, docs_of):
    rows = corpus(900)
    return rows, docs_of([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y, None, "zz") for i, _, y in rows], LABELS)


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(small):
    rows, docs, labels = small
    got = {r.doc_id: r for r in toxic.classify(docs, labels).collect()}
    assert {d: r.held_out for d, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    scores, truth = np.array([s for s, _ in held]), np.array([y for _, y in held])
    assert auc(scores, truth) > 0.95 and ((scores >= 0.7) == (truth == 1)).mean() > 0.9
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 and r.rejected == (r.score >= r.threshold) for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(small):
    from pyspark.sql import functions as F

    _, docs, labels = small
    flipped = labels.withColumn("toxic", F.when(toxic.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxic.train(docs, labels) == toxic.train(docs, flipped)


def test_share_and_thresholds_of_all_labelled_rows(spark, docs_of):
    """A sample with as many rows of either label changes neither the share that scores aim at nor the rows that set thresholds."""
    rows = corpus(500, 9)
    noisy = {i: 1 - y if i % 7 == 0 else y for i, _, y in rows}
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y, None, "zz") for i, y in noisy.items()] + [(90_000 + i, 1, 1, None, "zz") for i in range(300)], LABELS)
    model = toxic.Model.from_bytes(toxic.train(docs, labels, 60))
    got = {r.doc_id: r.score for r in toxic.score(docs, model.to_bytes()).collect()}
    learned = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    score, truth = np.array([got[i] for i in learned]), np.array([noisy[i] for i in learned])
    f1 = {c: 2 * ((score >= c) & (truth == 1)).sum() / max(truth.sum() + (score >= c).sum(), 1) for c in toxic.CUTS}
    best = [c for c, v in f1.items() if v >= max(f1.values()) - 1e-9]
    assert model.thresholds == {"en": min(best, key=lambda c: abs(c - toxic.PREDICTED))}
    usable = toxic.learnable(labels)
    counts = toxic.label_counts(docs, usable)
    assert counts == {0: int((truth == 0).sum()), 1: int(truth.sum())}
    chosen = sorted((r.doc_id, r.text, r.toxic) for r in toxic.sample(docs, usable, counts, 60).collect())
    y = np.array([x[2] for x in chosen])
    data = [t.encode() for _, t, _ in chosen]
    plain = toxic.fit(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]), y)
    assert 30 < y.sum() < 90 and 30 < (1 - y).sum() < 90
    assert model.bias - plain.bias == pytest.approx(np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum()))


def test_scores_depend_on_the_text_alone(small, docs_of, odd_pairs):
    from pyspark.sql import functions as F

    rows, docs, labels = small
    model = toxic.train(docs, labels)
    odd = docs_of(odd_pairs + [(50, rows[0][1]), (51, rows[0][1])])
    got = [(r.doc_id, r.score) for r in toxic.score(odd, model).collect()]
    assert len(got) == len(odd_pairs) + 2 and all(0 <= s <= 1 for _, s in got)
    other = [(r.doc_id, r.score) for r in toxic.score(odd.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")), model).collect()]
    assert sorted(got, key=str) == sorted(other, key=str)
    assert len({s for d, s in got if d in (50, 51)}) == 1
    assert toxic.score(odd.limit(0), model).collect() == []


def test_sparse_labels(docs_of, spark, odd_pairs):
    docs = docs_of(odd_pairs)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 1, None, None), (2, None, None, None, None), (None, 1, 1, None, None), (3, 1, 9, None, None)], LABELS)
    for labels in (none, one):
        assert all(0 <= r.score <= 1 for r in toxic.classify(docs, labels).collect())


def test_convolution_against_loops():
    rng = np.random.default_rng(3)
    texts = ["a b c", "", "d", "a a b d e f g", "b c"]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    starts, stops, first = toxic.word_spans(raw, offsets)
    feats = toxic.features(raw, starts, stops)
    known = np.unique(feats)[::2]
    total = toxic.FILTERS * len(toxic.WIDTHS)
    embed = rng.normal(size=(len(known) + 1, toxic.DIM)).astype(np.float32)
    embed[0] = 0
    m = toxic.Model(known, embed, [rng.normal(size=(w, toxic.DIM, toxic.FILTERS)).astype(np.float32) for w in toxic.WIDTHS],
                    rng.normal(size=total).astype(np.float32), rng.normal(size=total).astype(np.float32), 0.3, {})
    got = m.scores(raw, offsets, m.responses())
    for i in range(len(texts)):
        words = [sum((embed[np.searchsorted(known, f) + 1] if f in known else embed[0]) for f in row) for row in feats[first[i]:first[i + 1]]]
        best = np.zeros(total)
        for j, width in enumerate(toxic.WIDTHS):
            for f in range(toxic.FILTERS):
                k = j * toxic.FILTERS + f
                found = [sum(words[a + o] @ m.filters[j][o][:, f] for o in range(width)) + m.shifts[k] for a in range(len(words) - width + 1)]
                best[k] = max([0, *found])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(best @ m.weights + 0.3))), abs=1e-5)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark that hold what each stage looks for."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t) for i, t, _ in corpus(400, 5)]
    passage, item = prose(70, 90), prose(71, 30)
    rows += [(1000 + k, prose(80 + k, 60) + "\n" + passage + "\n" + prose(90 + k, 60)) for k in range(3)]
    rows += [(1100 + k, prose(110 + k, 80) + " " + item + " " + prose(120 + k, 50)) for k in range(2)]
    rows += [(1200, prose(130, 200)), (1201, prose(130, 200)), (1202, prose(130, 200) + " tail"), (1300, None), (1301, ""), (None, prose(140, 40))]
    docs = [(d, t, "en", "src", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in corpus(400, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage, item


def test_stages(spark, tables):
    folder, passage, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    truth = {i: y for i, _, y in corpus(400, 5)}
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, folder))
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    kept = seen["toxicity"]
    gone = [d for d in before if d not in kept]
    assert np.mean([truth.get(d, 0) for d in gone]) > 0.9 and len(gone) > 0.7 * sum(truth.values())
    near = seen["n-gram Jaccard join"]
    want = {r.component_id for r in trie.near_components(spark.createDataFrame([(d, r.text) for d, r in kept.items()], "doc_id long, text string")).collect()}
    assert set(near) == want and 1200 in near and not {1201, 1202} & set(near) and {1300, 1301, None} <= set(near)
    cut = seen["suffix-array dedup"]
    assert all(passage not in r.text for r in cut.values() if r.text) and {1000, 1001, 1002} <= set(cut)
    assert all(cut[d].text.startswith(prose(80 + d - 1000, 60)[:200]) and cut[d].n_chars == len(cut[d].text) for d in (1000, 1001, 1002))
    assert all(cut[d].text == near[d].text for d in set(near) - {1000, 1001, 1002, 1100, 1101})
    final = seen["benchmark decontamination"]
    assert {d for d in cut if d not in final} == {1100, 1101}


def test_passages_of_short_words(spark, docs_of, tmp_path):
    """51 words of two bytes repeat, 49 do not count, nor do three shorter repeats side by side."""
    def words(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("0123456789") for _ in range(n))

    long, short, parts = words(1, 51), words(2, 49), [words(3 + k, 40) for k in range(3)]
    assert len(long.encode()) < 240
    rows = [(k, f"{words(20 + k, 60)}\n{long}\n{words(30 + k, 60)}") for k in range(2)]
    rows += [(10 + k, f"{words(40 + k, 60)}\n{short}\n{words(50 + k, 60)}") for k in range(2)]
    rows += [(20, f"{words(60, 60)}\n" + " ".join(parts))] + [(21 + k, f"{words(61 + k, 60)}\n{p} {words(70 + k, 60)}") for k, p in enumerate(parts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_passages(spark, docs_of(rows), str(tmp_path)).collect()}
    assert set(got) == {d for d, _ in rows}
    assert all(long[2:-2] not in got[k] and got[k].startswith(words(20 + k, 60)) and got[k].endswith(words(30 + k, 60)) for k in range(2))
    assert all(got[d] == t for d, t in rows if d >= 10)


def test_whole_run(spark, tables):
    folder, _, _ = tables
    got = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got[0].asDict())
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in got if r.doc_id is not None)


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES) and len(corpus_pipeline.STAGES) == 5
