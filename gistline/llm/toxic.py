"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings of the word, its first bytes and its last bytes. Filters over
one, two and three words run along the whole text, the largest response of each filter is kept, and a
logistic layer gives the score. The fit is made in numpy, in one task, on a bounded sample of
labelled rows (``SAMPLE``); rows whose crc32 of doc_id leaves 1 modulo 3 are never learned from.
The sample cuts each label on its own, so the bias is shifted by the log odds of the labels among all
these rows against those of the sample. All of them are then scored, and the label counts at each cut
give a rejection threshold for each language; the score itself sees the text alone.

Since filters are linear, the response of each embedding row to each filter position is laid out once,
and scoring a text is a sum of table rows per word.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import batch, give_back, slices, small, stage
from gistline.llm.words import mix, text_bytes, word_hashes, word_spans

SAMPLE = 3000  #: Labelled rows of each label that are learned from, at most about.
BUCKET_BITS = 22
WIDTHS = (1, 2, 3)
FILTERS = 8  #: Per width.
DIM = 8
EPOCHS = 6
SCORED_BYTES = 256 << 10  #: Text scored in one step.
PRIOR = 10.0  #: A bucket's share of label 1 starts as if seen in so many average texts.
PREDICTED = 0.7
CUTS = tuple(round(0.3 + 0.05 * k, 2) for k in range(13))  #: Thresholds that a language may get.
_EDGE = 4  #: Bytes of the beginning and the end of a word.
_KINDS = 4


def features(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Buckets of each word: the word, its first three and four bytes, its last four bytes."""
    if not len(starts):
        return np.zeros((0, _KINDS), np.int64)
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in ".,;:!?%$#&*|\"()"]] = True
    # Signs around a word do not belong to it; a word of signs alone stays as it is.
    a, z = starts.copy(), stops.copy()
    for _ in range(4):
        a += (z - a > 1) & sign[raw[a]]
        z -= (z - a > 1) & sign[raw[z - 1]]
    cols = [word_hashes(raw, a, z)]
    for tag, lo, hi in ((1, a, np.minimum(a + 3, z)), (2, a, np.minimum(a + 4, z)), (3, np.maximum(z - _EDGE, a), z)):
        with np.errstate(over="ignore"):
            cols.append(mix(word_hashes(raw, lo, hi) + np.uint64(tag)))
    return (np.stack(cols, axis=1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray  # ascending; row 0 of the embeddings stands for all others and is zero
    embed: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    shifts: np.ndarray  # of each filter
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def rows(self, feats: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(feats.shape, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, feats), len(self.buckets) - 1)
        return np.where(self.buckets[at] == feats, at + 1, 0)

    def responses(self) -> np.ndarray:
        """For each embedding row, its share in every filter position."""
        return np.concatenate([self.embed @ w[k] for w in self.filters for k in range(len(w))], axis=1)

    def pooled(self, rows: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each text, and the word where it begins (-1: none)."""
        texts = len(first) - 1
        best = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        word = table[rows[:, 0]].copy()
        for k in range(1, rows.shape[1]):
            word += table[rows[:, k]]
        at = 0
        for j, width in enumerate(WIDTHS):
            n = len(rows) - width + 1
            out = slice(j * FILTERS, (j + 1) * FILTERS)
            if n > 0:
                total = sum(word[k:n + k, at + k * FILTERS:at + (k + 1) * FILTERS] for k in range(width)) + self.shifts[out]
                # A window must end inside its text; texts with enough words have one.
                have = np.flatnonzero(np.diff(first) >= width)
                if len(have):
                    spans = np.stack([first[have], first[have + 1] - width + 1], axis=1).ravel()
                    padded = np.concatenate([total, np.full((1, FILTERS), -np.inf, np.float32)])
                    peak = np.maximum.reduceat(padded, spans, axis=0)[::2]
                    best[have, out] = np.maximum(peak, 0)
                    where[have, out] = np.where(peak > 0, 0, -1)
                    if self.learning:
                        for i, (a, z) in enumerate(spans.reshape(-1, 2).tolist()):
                            top = padded[a:z].argmax(axis=0) + a
                            where[have[i], out] = np.where(peak[i] > 0, top, -1)
            at += width * FILTERS
        return best, where

    learning = False

    def scores(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        starts, stops, first = word_spans(raw, offsets)
        best, _ = self.pooled(self.rows(features(raw, starts, stops)), first, table)
        return self.logistic(best)

    def logistic(self, best: np.ndarray) -> np.ndarray:
        # Summed row by row, so that a text's score does not depend on the texts beside it.
        return 1 / (1 + np.exp(-((best.astype(np.float64) * self.weights).sum(axis=1) + self.bias)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, buckets=self.buckets, embed=self.embed, shifts=self.shifts, weights=self.weights, bias=self.bias,
                 langs=np.array(list(self.thresholds), dtype=str), cuts=np.array(list(self.thresholds.values()), float),
                 **{f"w{i}": w for i, w in enumerate(self.filters)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(z["buckets"], z["embed"], [z[f"w{i}"] for i in range(len(WIDTHS))], z["shifts"], z["weights"], float(z["bias"]),
                   dict(zip(z["langs"].tolist(), z["cuts"].tolist())))


def fit(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, true: dict[int, int] | None = None, seed: int = 7) -> Model:
    """Train on these texts. With one label only, every score is that label's share.

    ``true``: rows of each label where these texts come from; the bias is set for that share.
    """
    rng = np.random.default_rng(seed)
    starts, stops, first = word_spans(raw, offsets)
    feats = features(raw, starts, stops)
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    width = len(labels) + 1
    # Buckets of three texts at least; the first dimension begins with how much more often they go with label 1.
    pairs = np.unique((feats * width + doc[:, None]).ravel()) if len(feats) else np.zeros(0, np.int64)
    bucket, text = pairs // width, pairs % width
    known, inverse, texts = np.unique(bucket, return_inverse=True, return_counts=True)
    ones = np.bincount(inverse, labels[text], len(known)) if len(known) else np.zeros(0)
    often = texts >= 3
    known, texts, ones = known[often], texts[often], ones[often]
    share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    p = (ones + PRIOR * share) / (texts + PRIOR)
    odds = np.log(p / (1 - p)) - np.log(share / (1 - share))
    embed = np.zeros((len(known) + 1, DIM), np.float32)
    embed[1:] = rng.normal(0, 0.05, (len(known), DIM))
    embed[1:, 0] = np.clip(odds, 0, 4) / 4
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, 0] = 1.0 / len(w)
        w[:, 0, 1] = 0.6 / len(w)
    total = FILTERS * len(WIDTHS)
    model = Model(known, embed, filters, np.zeros(total, np.float32), np.zeros(total, np.float32), float(np.log(share / (1 - share))), {})
    if 0 < labels.sum() < len(labels):
        model.weights[::FILTERS] = 0.5
        _train(model, model.rows(feats), first, labels.astype(np.float32), rng)
    n = [int((labels == y).sum()) for y in (0, 1)]
    if true and all(n) and true.get(0) and true.get(1):
        model.bias += float(np.log(true[1] / true[0]) - np.log(n[1] / n[0]))
    norms = np.abs(model.embed).max(axis=1) > 1e-3
    norms[0] = True
    model.buckets, model.embed = model.buckets[norms[1:]], model.embed[norms]
    return model


def _train(model: Model, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, rng: np.random.Generator, size: int = 100) -> None:
    """Adam over batches of texts; only the words where a filter peaks get a gradient."""
    model.learning = True
    params = [model.embed, *model.filters, model.shifts, model.weights, np.array([model.bias], np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = 0.02 * (1 - epoch / EPOCHS)
        for a in range(0, len(order), size):
            chosen = order[a:a + size]
            counts = np.diff(first)[chosen]
            f = np.concatenate([[0], np.cumsum(counts)])
            own = rows[np.arange(f[-1]) - np.repeat(f[:-1], counts) + np.repeat(first[:-1][chosen], counts)]
            used, back = np.unique(own, return_inverse=True)
            table = np.concatenate([model.embed[used] @ w[k] for w in model.filters for k in range(len(w))], axis=1)
            best, where = model.pooled(back.reshape(own.shape), f, table)
            p = 1 / (1 + np.exp(-(best @ model.weights + params[-1][0])))
            err = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(x) for x in params[1:]]
            grads[-2] += best.T @ err + 1e-4 * model.weights
            grads[-1] += err.sum()
            into = err[:, None] * model.weights[None, :] * (where >= 0)
            grads[-3] += into.sum(axis=0)
            touched, values = [], []
            for j, width in enumerate(WIDTHS):
                out = slice(j * FILTERS, (j + 1) * FILTERS)
                t, c = np.nonzero(where[:, out] >= 0)
                at, g = where[:, out][t, c], into[:, out][t, c]
                for k in range(width):
                    r = own[at + k]  # (peaks, kinds)
                    e = model.embed[r].sum(axis=1)
                    np.add.at(grads[j].transpose(0, 2, 1)[k], c, g[:, None] * e)
                    touched.append(r.ravel())
                    values.append(np.repeat(g[:, None] * model.filters[j][k].T[c], r.shape[1], axis=0))
            step += 1
            hit, inv = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(hit), DIM), np.float32)
            np.add.at(ge, inv, np.concatenate(values))
            some = hit > 0
            updates = [(0, hit[some], ge[some])] + [(i + 1, slice(None), g) for i, g in enumerate(grads)]
            for i, at, g in updates:
                m[i][at] = 0.9 * m[i][at] + 0.1 * g
                v[i][at] = 0.99 * v[i][at] + 0.01 * g * g
                params[i][at] -= rate * (m[i][at] / (1 - 0.9**step)) / (np.sqrt(v[i][at] / (1 - 0.99**step)) + 1e-6)
    model.bias = float(params[-1][0])
    model.learning = False


def thresholds(scored: DataFrame, least: int = 50) -> dict[str, float]:
    """For each language with enough rows (lang, toxic, score), the cut that splits its labels best by F1."""
    counts = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones"),
        F.array(*[F.count(F.when(F.col("score") >= c, 1)) for c in CUTS]).alias("above"),
        F.array(*[F.count(F.when((F.col("score") >= c) & (F.col("toxic") == 1), 1)) for c in CUTS]).alias("hits"))
    out, cuts = {}, np.array(CUTS)
    for r in counts.filter((F.col("n") >= least) & (F.col("ones") > 0) & (F.col("ones") < F.col("n"))).orderBy("lang").collect():
        f1 = np.array([2 * h / max(r["ones"] + a, 1) for h, a in zip(r["hits"], r["above"])])
        good = cuts[f1 >= f1.max() - 1e-9]
        out[r["lang"]] = float(good[np.argmin(np.abs(good - PREDICTED))])
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and label of the labelled rows that are not held out."""
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    return stage(rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))


def label_counts(docs: DataFrame, usable: DataFrame) -> dict[int, int]:
    """Rows of ``docs`` with each label."""
    return {r["toxic"]: r["n"] for r in docs.select("doc_id").join(small(usable, 16), "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}


def sample(docs: DataFrame, usable: DataFrame, counts: dict[int, int], per_label: int = SAMPLE) -> DataFrame:
    """About ``per_label`` labelled rows of each label, chosen by a hash, with their texts."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    keep = F.lit(False)
    for label, count in counts.items():
        keep = keep | ((F.col("toxic") == label) & (part < int(min(1.0, per_label / count) * (1 << 30))))
    # Labels may be of rows that are not in ``docs``, so their number is known only by ``small``.
    return docs.select("doc_id", "text", "lang").join(small(stage(usable.filter(keep)), 16), "doc_id")


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> bytes:
    usable = learnable(labels)
    counts = label_counts(docs, usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The order of rows must not matter: a retry may read them in another.
        rows = sorted((r["doc_id"], r["text"] or "", r["toxic"], r["lang"]) for b in batches for r in
                      b.set_column(3, "lang", b.column("lang").fill_null("")).to_pylist())
        data = [t.encode() for _, t, _, _ in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)])
        model = fit(np.frombuffer(b"".join(data), np.uint8), offsets, np.array([y for _, _, y, _ in rows], np.int64), counts)
        found = model.to_bytes()
        del rows, data, model
        give_back()
        yield pa.record_batch([pa.array([found], pa.binary())], names=["model"])

    # Written first: the scan stays parallel, and the one training task reads only the sample.
    chosen = stage(sample(docs, usable, counts, per_label).select("doc_id", "text", "toxic", "lang"))
    got = chosen.coalesce(1).mapInArrow(run, "model binary").first()
    # A table without rows may have no partition at all, and then no task.
    model = Model.from_bytes(bytes(got["model"])) if got else fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
    model.thresholds = thresholds(_labelled_scores(docs, usable, model))
    return model.to_bytes()


def _labelled_scores(docs: DataFrame, usable: DataFrame, model: Model) -> DataFrame:
    """lang, toxic and score of every row of ``docs`` that has a label in ``usable``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = Model.from_bytes(shared.value)
        weights = own.responses()
        for b in slices(batches, "text", SCORED_BYTES):
            yield batch(_LABELLED, lang=b.column("lang"), toxic=b.column("toxic"), score=own.scores(*text_bytes(b.column("text")), weights))

    rows = docs.select("doc_id", "text", F.col("lang").cast("string")).join(small(usable, 16), "doc_id").select("text", "lang", "toxic")
    return rows.mapInArrow(run, "lang string, toxic int, score double")


_LABELLED = pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("score", pa.float64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])


def score(docs: DataFrame, model: bytes, per_label: int = SAMPLE) -> DataFrame:
    """Score of every text, with its language's threshold and whether that rejects it.

    Out: doc_id, score, threshold, rejected. Null and empty texts score like any text without words;
    languages with few labelled rows, and null, have the threshold 0.7; repeated rows are scored
    each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = Model.from_bytes(shared.value)
        weights = own.responses()
        for b in slices(batches, "text", SCORED_BYTES):
            yield batch(_SCORED, doc_id=b.column("doc_id"), lang=b.column("lang"), score=own.scores(*text_bytes(b.column("text")), weights))

    scored = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(run, "doc_id long, lang string, score double")
    cuts = Model.from_bytes(model).thresholds
    known = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.lit(None).cast("map<string,double>")
    cut = F.coalesce(F.try_element_at(known, F.col("lang")), F.lit(PREDICTED))
    return scored.select("doc_id", "score", cut.alias("threshold"), (F.col("score") >= cut).alias("rejected"))


def accepted(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject for their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = Model.from_bytes(shared.value)
        weights = own.responses()
        for b in slices(batches, "text", SCORED_BYTES):
            cuts = np.array([own.thresholds.get(x or "", PREDICTED) for x in b.column("lang").to_pylist()])
            yield b.filter(pa.array(own.scores(*text_bytes(b.column("text")), weights) < cuts))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """Train on the labelled rows that are not held out, and score all documents.

    In: doc_id, text, lang and doc_id, toxic (more columns are ignored; null or other labels are not
    learned from). Out: doc_id, held_out, score, predicted, threshold, rejected.
    """
    return score(docs, train(docs, labels, per_label)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "threshold", "rejected")
