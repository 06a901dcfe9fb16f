"""Resampling of documents towards a target distribution, by hashed n-gram features.

Words and their offsets come from an untrained Split pre-tokenizer of the tokenizers library over
text with A-Z lowered. Windows over the offsets give the features, CRC-32 their buckets. Each text
leaves its bucket counts, so it is cut into words once; the counts of all texts give each bucket's
gain, a document weighs the sum of its features' gains, and Gumbel noise of a hash of its id turns
weights into a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import batch, number_in_order, slices, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
PIECE = 1 << 15  #: Characters given to the pre-tokenizer at once; a longer word stays whole.
PART = 1 << 17  #: Words whose features are counted at once.
MEMORY = 1 << 18  #: Words whose bucket one task remembers.
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
_COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def words_of(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """The words of a text that is already lowered, with where they begin, piece by piece."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    at = 0
    while at < len(text):
        border = _BETWEEN.search(text, at + PIECE)
        to = border.end() if border else len(text)
        got = split.pre_tokenize_str(text[at:to])
        yield [w for w, _ in got], [at + a for _, (a, _) in got]
        at = to


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, where = np.unique(keys, return_inverse=True)
    return one, np.bincount(where, counts, len(one)).astype(np.int64)


class Features:
    """Bucket counts of texts; remembers the buckets of words it has seen."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.seen = longest, buckets, {}

    def _buckets(self, words: list[str], text_of: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and bucket of every feature that ends behind the first ``carried`` words."""
        seen = self.seen
        if len(seen) > MEMORY:
            seen.clear()
        for w in set(words[carried:]):
            if w not in seen:
                seen[w] = zlib.crc32(w.encode()) % self.buckets
        own, found = [text_of[carried:]], [np.fromiter(map(seen.__getitem__, words[carried:]), np.int64)]
        if self.longest > 1:
            joined = " ".join(words).encode()
            size = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            begin = end - size
            for n in range(2, self.longest + 1):
                last = np.arange(max(carried, n - 1), len(words))
                last = last[text_of[last] == text_of[last - n + 1]]  # a window lies in one text
                pairs = zip(begin[last - n + 1].tolist(), end[last].tolist())
                own.append(text_of[last])
                found.append(np.fromiter((zlib.crc32(joined[a:b]) % self.buckets for a, b in pairs), np.int64, len(last)))
        return np.concatenate(own), np.concatenate(found)

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (text * buckets + bucket) in ascending order with their counts, and the words of each text."""
        lowered = [t.lower().decode() for t in texts]  # bytes.lower changes A-Z alone
        starts = np.cumsum([0] + [len(t) + 1 for t in lowered])
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_words = np.zeros(len(texts), np.int64)
        words: list[str] = []
        text_of = np.zeros(0, np.int64)
        carried = 0

        def add() -> None:
            nonlocal keys, counts, words, text_of, carried
            own, bucket = self._buckets(words, text_of, carried)
            keys, counts = _merged(np.concatenate([keys, own * self.buckets + bucket]), np.concatenate([counts, np.ones(len(own), np.int64)]))
            np.add.at(n_words, text_of[carried:], 1)
            keep = min(len(words), self.longest - 1)
            words, text_of, carried = words[len(words) - keep:], text_of[len(words) - keep:], keep

        for some, at in words_of("\n".join(lowered)):
            words += some
            text_of = np.concatenate([text_of, np.searchsorted(starts, np.array(at, np.int64), side="right") - 1])
            if len(words) >= PART:
                add()
        add()
        return keys, counts, n_words


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of every row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(longest, buckets)
        for b in slices(batches, "text"):
            text = b.column(1).cast(pa.large_binary()).fill_null(b"")
            keys, counts, n_words = features.count(text.to_pylist())
            of = np.searchsorted(keys, np.arange(b.num_rows + 1) * buckets)
            total = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(x, pa.int32())) for x in (keys % buckets, counts)]
            yield batch(_COUNTS_ARROW, doc_id=b.column(0), n_words=n_words, n_features=total[of[1:]] - total[of[:-1]], buckets=lists[0], counts=lists[1])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _COUNTS)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts, and where each row begins."""
    lists = [b.column(b.schema.get_field_index(c)) for c in ("buckets", "counts")]
    offsets = lists[0].offsets.to_numpy()
    return lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(np.int64), offsets - offsets[0]


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; each task sends one row for each of its buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            bucket, count, _ = _flat(b)
            np.add.at(total, bucket, count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed target share to the smoothed source share), for each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, count, at = _flat(b)
            total = np.concatenate([[0], np.cumsum(gain[bucket] * count)])
            own = dict(zip(b.schema.names, b.columns))
            yield batch(schema, **{c: own[c] for c in schema.names[:3]}, weight=total[at[1:]] - total[at[:-1]])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Every document with its weight towards ``target``, its score, and its rank if it is drawn.

    In: doc_id, text of ``docs``; text of ``target`` (more columns are ignored). Out: doc_id,
    n_features, weight, score, rank, all long. Drawn are floor(percent * N / 100) of the N documents
    with at least ``least_words`` words, by falling score, ties by rising doc_id, null last. A null or
    empty text has no feature and weight 0; a repeated row counts, and may be drawn, each time; a null
    doc_id is hashed as an empty one. An empty target leaves the gains of an empty histogram; an empty
    table gives no rows. Texts of any length are cut into words piece by piece.
    """
    counted = stage(bucket_counts(docs, longest, buckets))
    wanted = histogram(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), buckets)
    gain = gains(histogram(counted, buckets), wanted)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(counted, gain).withColumn("score", F.col("weight") + noise).withColumn("_enough", F.col("n_words") >= least_words)
    ranked = number_in_order(scored, "_row", F.col("_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drawn = percent * counted.filter(F.col("n_words") >= least_words).count() // 100
    rank = F.when(F.col("_enough") & (F.col("_row") < drawn), F.col("_row") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
