"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraphs (lines, and sentences in a line) and each distinct one has a 64-bit
digest. A sketch has three subtables of cells; a digest falls into one cell of each, and a cell holds
how many digests it got, their XOR and the XOR of their check hashes. Sketches of two texts are
subtracted cell by cell, common paragraphs vanish, and cells that hold a single digest are peeled
until none is left; that gives the paragraphs of either text that the other lacks, and with them
their likeness. Where cells are left, the pair is tried again with a sketch twice as large.

Cells are rows. All rows of a document and of its neighbour in doc_id order share a partition, so
that building, subtracting and every peeling round are aggregations inside a partition: the texts are
shuffled once. A round peels one subtable, where each digest has one cell, so none is peeled twice.

The ``fingerprint`` column is the smallest sketch of a text (three subtables of four cells), written in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gistline.llm.common import small, stage

TABLES = 3
SMALL = 4  #: Cells of a subtable in the written fingerprint.
ROUNDS = 15
BUCKET_ROWS = 1024
MAX_BUCKETS = 4096
_FIRST = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """Distinct digests of the lines and sentences of a text."""
    cut = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda p: p != "")
    return F.array_distinct(F.transform(cut, lambda p: F.xxhash64(p)))


def _in_cell(t: int, c: int):
    return lambda d: F.shiftrightunsigned(d, 2 * t + 7).bitwiseAND(F.lit(SMALL - 1)) == c


def small_sketch(digests: Column) -> list[Column]:
    """The cells of the smallest sketch: for each its number of digests and their XOR."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x"))
    out = []
    for t in range(TABLES):
        for c in range(SMALL):
            cell = F.aggregate(F.filter(digests, _in_cell(t, c)), start, lambda s, d: F.struct((s["n"] + 1).alias("n"), s["x"].bitwiseXOR(d).alias("x")))
            out += [cell["n"], cell["x"]]
    return out


def written(cells: list[Column]) -> Column:
    """A small sketch in hex."""
    return F.concat(*[F.lpad(F.hex(c), 16 if i % 2 else 4, "0") for i, c in enumerate(cells)])


def neighbours(docs: DataFrame, partitions: int) -> DataFrame:
    """Each document with the text and paragraphs of the next one by descending doc_id (after the last: the first).

    Documents are dealt by ranges of doc_id; the first of each range is sent to the range before it, too.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    rows = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    buckets = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    cuts = []
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, F.lit(20 * buckets)).alias("q")).first()["q"]))
    # At most 4096 bounds, searched in two steps: first among every 64th.
    heads = cuts[::64]
    if cuts:
        coarse = F.size(F.filter(F.array(*map(F.lit, heads)), lambda b: b < F.col("key")))
        groups = F.array(F.array().cast("array<bigint>"), *[F.array(*map(F.lit, cuts[i:i + 64])).cast("array<bigint>") for i in range(0, len(cuts), 64)])
        bucket = F.greatest(coarse - 1, F.lit(0)) * 64 + F.size(F.filter(F.get(groups, coarse), lambda b: b < F.col("key")))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect())  # one row per bucket
    if not tops:
        tops = [(0, _FIRST)]
    place = {b: i for i, (b, _) in enumerate(tops)}
    above = F.create_map(*[F.lit(x) for b, _ in tops for x in (b, tops[(place[b] + 1) % len(tops)][0])])
    top = F.create_map(*[F.lit(x) for b, t in tops for x in (b, t)])
    own, copy = F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.element_at(above, F.col("bucket")).alias("bucket"), F.lit(1).alias("copy"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("key") == F.element_at(top, F.col("bucket")), F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("to.bucket").alias("bucket"), F.col("to.copy").alias("copy"), "key", "doc_id", "text").repartition(partitions, "bucket")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), F.xxhash64("text"))
    return (
        dealt.withColumn("own", paragraphs(F.col("text")))
        .withColumn("next", F.lead(F.struct("key", "text", "own")).over(order)).withColumn("pos", F.row_number().over(order))
        .filter("copy = 0"))


FIELDS = ("key", "known", "text_hash", "next_key", "n_chars", "n_own", "n_changed", "n_other", "sha0", "sha1", "sha2", "sha3")


def with_edits(near: DataFrame) -> DataFrame:
    """The edited texts (second half replaced by the beginning of the next document): the digests of
    each text, its edited text and its next one, and all other results as an array of numbers."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.char_length("text") - half), F.left(F.col("next.text"), half))
    rows = near.withColumn("edited", edited).withColumn("changed", paragraphs(F.col("edited"))).withColumn("other", F.col("next.own"))
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    values = [
        F.col("key"), F.col("doc_id").isNotNull().cast("long"), F.xxhash64("text"), F.col("next.key"), F.char_length("text").cast("long"),
        *[F.size(c).cast("long") for c in ("own", "changed", "other")],
        *[F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]]
    return rows.select("bucket", "pos", "own", "changed", "other", F.array(*values, *small_sketch(F.col("own")), *small_sketch(F.col("changed"))).alias("given"))


def peel(rows: DataFrame, attempt: int) -> DataFrame:
    """Differences of pairs of texts.

    In: bucket, pos (a row's name), own, changed, other (digests), given (numbers to hand through).
    Out: bucket, pos, given, and for pair 0 (own, changed) and 1 (own, other) only_first, only_second
    (how many digests the other side lacks) and left (cells that could not be peeled). The given
    numbers go along as rows of a third pair, so that nothing has to be joined to the result.
    """
    def side(pair: int, sign: int, digests: str, size: Column) -> Column:
        return F.transform(digests, lambda d: F.struct(F.lit(pair).alias("pair"), F.lit(sign).alias("sign"), d.alias("d"), size.alias("third")))

    # A third of twice as many cells as there are digests on both sides, doubled with each attempt.
    def third(a: str, b: str) -> Column:
        return (F.ceil((F.size(a) + F.size(b)) * 2 / 3) + 6).cast("long") * (1 << attempt)

    first, second = third("own", "changed"), third("own", "other")
    handed = F.transform(F.col("given"), lambda d, i: F.struct(F.lit(2).alias("pair"), F.lit(0).alias("sign"), d.alias("d"), (i + 1).cast("long").alias("third")))
    digests = F.concat(side(0, 1, "own", first), side(0, -1, "changed", first), side(1, 1, "own", second), side(1, -1, "other", second), handed)
    through = F.col("pair") == 2

    def cell(d: Column, t: Column | int, size: Column) -> Column:
        t = F.lit(t) if isinstance(t, int) else t
        return t * size + F.pmod(F.xxhash64(d, t, F.lit(attempt)), size)

    def check(d: Column) -> Column:
        return F.xxhash64(d, F.lit(77))

    key = ["bucket", "pos", "pair", "third", "cell"]
    sums = [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("h").alias("h"), F.sum("first").alias("first"), F.sum("second").alias("second")]
    zero = F.lit(0).cast("long")
    cells = (
        rows.select("bucket", "pos", F.explode(digests).alias("e")).select("bucket", "pos", "e.*")
        .withColumn("t", F.explode(F.when(through, F.array(F.lit(0))).otherwise(F.array(*[F.lit(t) for t in range(TABLES)]))))
        .select("bucket", "pos", "pair", "third", F.when(through, F.col("third")).otherwise(cell(F.col("d"), F.col("t"), F.col("third"))).alias("cell"),
                F.col("sign").cast("long").alias("n"), F.col("d").alias("x"), F.when(through, zero).otherwise(check(F.col("d"))).alias("h"),
                zero.alias("first"), zero.alias("second"))
        .groupBy(*key).agg(*sums))
    kept = (F.col("n") != 0) | (F.col("x") != 0) | (F.col("h") != 0) | (F.col("cell") < 0) | through
    fields = ("cell", "n", "x", "h", "first", "second")

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(f) for v, f in zip(values, fields)])

    for step in range(ROUNDS):
        t = step % TABLES
        c = {f: F.col(f) for f in fields}
        pure = (F.floor(F.col("cell") / F.col("third")) == t) & (F.abs("n") == 1) & (check(F.col("x")) == F.col("h")) & (cell(F.col("x"), t, F.col("third")) == F.col("cell"))
        # A peeled digest leaves its two other cells and is counted in cell -1.
        gone = [row(cell(F.col("x"), o, F.col("third")), -c["n"], c["x"], c["h"], zero, zero) for o in range(TABLES) if o != t]
        counted = row(F.lit(-1).cast("long"), zero, zero, zero, (c["n"] == 1).cast("long"), (c["n"] == -1).cast("long"))
        same = row(*[c[f] for f in fields])
        cells = (
            cells.filter(kept).withColumn("e", F.explode(F.when(pure, F.array(*gone, counted)).otherwise(F.array(same))))
            .select("bucket", "pos", "pair", "third", "e.*").groupBy(*key).agg(*sums))
    totals = [F.sum(F.when(F.col("pair") == p, F.col(c))).alias(f"only_{c}{p}") for p in (0, 1) for c in ("first", "second")]
    return cells.groupBy("bucket", "pos").agg(
        *totals, F.count_if(~through & (F.col("cell") >= 0) & kept).alias("left"),
        F.sort_array(F.collect_list(F.when(through, F.struct("cell", "x"))))["x"].alias("given"))


def _attempt(docs: DataFrame, partitions: int, attempt: int) -> DataFrame:
    got = peel(with_edits(neighbours(docs, partitions)), attempt)
    return stage(got.select(
        *[F.col("given")[i].alias(f) for i, f in enumerate(FIELDS)], F.slice("given", len(FIELDS) + 1, 4 * TABLES * SMALL).alias("cells"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("only_first0", "only_second0", "only_first1", "only_second1")], "left", F.lit(attempt).alias("attempt")))


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness of each to the next document's.

    In: doc_id, text (more columns are ignored). Out: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, paragraphs_lost, paragraphs_gained, attempt. Null texts
    are empty; two texts without paragraphs have likeness 1; a null doc_id stands below all others;
    rows with equal doc_id follow each other by a hash of their texts; a single document is its own
    next; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    partitions = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, docs.count() // BUCKET_ROWS))
    done, rest, attempt = None, docs, 0
    while True:
        got = _attempt(rest, partitions, attempt)
        if attempt:
            got = stage(got.join(failed, ["key", "text_hash"], "left_semi"))
        open_ = got.filter("left > 0")
        failed = stage(open_.select("key", "text_hash").distinct())
        fine = got.join(failed, ["key", "text_hash"], "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if failed.isEmpty():
            break
        # The rows once more with a larger sketch; their next documents come along.
        wanted = stage(got.join(failed, ["key", "text_hash"], "left_semi").select(F.explode(F.array("key", "next_key")).alias("_key")).distinct())
        rest = docs.join(small(wanted, 16), F.coalesce("doc_id", F.lit(_FIRST)) == F.col("_key"), "left_semi")
        attempt += 1
    def near(p: int, other: str) -> Column:
        shared = F.col("n_own") - F.col(f"only_first{p}")
        union = F.col("n_own") + F.col(other) - shared
        return F.when(union == 0, 1.0).otherwise(shared / union)

    half = 2 * TABLES * SMALL
    sketches = [written([F.col("cells")[i] for i in range(a, a + half)]) for a in (0, half)]
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    return done.select(
        F.when(F.col("known") == 1, F.col("key")).alias("doc_id"), "n_chars", sha.alias("edited_sha256"), sketches[0].alias("fingerprint"),
        sketches[1].alias("edited_fingerprint"), near(0, "n_changed").alias("near_edited"), near(1, "n_other").alias("near_next"),
        F.col("only_first0").alias("paragraphs_lost"), F.col("only_second0").alias("paragraphs_gained"), "attempt")
