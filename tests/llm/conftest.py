import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, shard int, _id long, ranges string, tid long, length int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    def make(pairs, parts=3):
        rows = [(d, t, "en" if t else None, None if i % 3 else "src", None if t is None else len(t), i, None, i, "x", 7, None) for i, (d, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make


def prose(seed, words, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", "", ".", ",", "\n", " é"]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty texts, ties, repeated rows, near copies, a very long text."""
    base = prose(1, 300)
    near = base.split(" ")
    near[7] = "changed"
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, "   \n\t"), (None, prose(2, 120)), (None, None), (7, "one"), (8, "one two three"),
        (9, "one two three"), (10, prose(3, 90) + " " + base[:700] + " " + prose(4, 60)), (11, "a" * 3000), (12, "Ab " * 900), (13, prose(5, 30000)), (14, "é" * 1200), (14, "other text")]
