import itertools
import textwrap

import numpy as np
import pytest

from gistline.llm import licenses, seeds
from tests.llm.conftest import prose

ITEMS = "item_id long, text string, seed long, doc_id long"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, prose(900, 30)), (2, prose(901, 15)), (3, "short item of five"), (4, None), (5, ""), (None, prose(902, 20)), (6, prose(903, 40)), (6, prose(903, 40)), (7, "Single")]
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], ITEMS), rows


def test_masks_survive_scattered_substitutions():
    """Some window of a passage keeps a seed whichever single word, or two words, of 24 are exchanged."""
    picks = [[i for i, c in enumerate(m) if c == "1"] for m in seeds.MASKS]
    for gone in itertools.chain(itertools.combinations(range(24), 1), itertools.combinations(range(24), 2)):
        assert any(not any(at + k in gone for k in p) for p in picks for at in range(24 - seeds.SPAN + 1))


def brute(docs, items, least=seeds.MIN_WORDS):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = set()
    for d, t in docs:
        own = np.array((t or "").translate(lower).split())
        for i, s in items:
            words = np.array((s or "").translate(lower).split())
            if i is None or not len(words) or not len(own):
                continue
            for shift in range(-len(words) + 1, len(own)):
                if seeds.best_overlap(own, words, shift, least):
                    found.add((d, i))
                    break
    return found


def test_overlaps_against_brute_force(docs_of, benchmark):
    items, rows = benchmark
    one, two, six = (rows[k][1].split() for k in (0, 1, 6))
    swapped = list(one)
    for k in (4, 17, 25):
        swapped[k] = "other"
    torn = list(one)
    for k in range(0, 30, 2):
        torn[k] = "other"
    pairs = [
        (1, prose(1, 50) + " " + " ".join(one) + " " + prose(2, 20)), (2, prose(3, 30) + " " + " ".join(swapped)), (3, " ".join(torn)), (4, " ".join(six[10:30]).upper()),
        (5, prose(4, 200)), (6, "a short item of five words"), (7, "short item of four"), (8, None), (9, ""), (10, " ".join(two)), (10, " ".join(two)),
        (11, prose(5, 4000) + " " + " ".join(one) + " " + " ".join(one) + " " + prose(6, 3000)), (None, " ".join(one)), (12, "only SINGLE here"), (13, "filler " * 500)]
    got = seeds.overlaps(docs_of(pairs), items).collect()
    assert {(g.doc_id, g.item_id) for g in got} == brute(pairs, rows) and len(got) == len({(g.doc_id, g.item_id) for g in got})
    by = {(g.doc_id, g.item_id): g for g in got}
    assert (by[1, 1].doc_word, by[1, 1].item_word, by[1, 1].n_words, by[1, 1].n_equal) == (len(prose(1, 50).split()), 0, len(one), len(one))
    assert 20 <= by[2, 1].n_equal <= len(one) - 3 and (3, 1) not in by and by[11, 1].doc_word == len(prose(5, 4000).split())
    assert (6, 3) in by and (7, 3) not in by and (12, 7) in by
    assert seeds.overlaps(docs_of(pairs).limit(0), items).collect() == []
    assert seeds.overlaps(docs_of(pairs), items.limit(0)).collect() == []


def plain_overlap(own, words):
    """Most equal words of any stretch with at least min(12, item) equal and a fifth differing at most; by trying all."""
    best = 0
    for shift in range(-len(words) + 1, len(own)):
        same = [0 <= k + shift < len(own) and own[k + shift] == w for k, w in enumerate(words)]
        for a in range(len(words)):
            for z in range(a + 1, len(words) + 1):
                n = sum(same[a:z])
                if a + shift >= 0 and z + shift <= len(own) and n >= min(12, len(words)) and 5 * (z - a - n) <= z - a:
                    best = max(best, n)
    return best


def test_exchanged_words_of_short_items(spark, docs_of):
    """Items of 13 to 21 words with any one word, or any two words, exchanged."""
    lengths = range(13, 22)
    texts = {n: [f"i{n}w{k}" for k in range(n)] for n in lengths}
    pairs = []
    for n in lengths:
        for gone in [*itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            own = [f"x{k}" if k in gone else w for k, w in enumerate(texts[n])]
            pairs.append((n * 10_000 + len(pairs), " ".join(["before", "it", *own, "and", "after"])))
    items = spark.createDataFrame([(n, " ".join(t), 0, 0) for n, t in texts.items()], ITEMS)
    want = {}
    for d, t in pairs:
        n = plain_overlap(t.split(), texts[d // 10_000])
        if n:
            want[d, d // 10_000] = n
    assert len(want) > 1200
    assert {(g.doc_id, g.item_id): g.n_equal for g in seeds.overlaps(docs_of(pairs), items).collect()} == want


def test_license_scan(docs_of):
    mit = licenses.WORDINGS["MIT"]
    pairs = [
        (1, "text\nReleased under the MIT License.\nmore text"), (2, "intro\n" + mit.replace("subject to the following conditions:", "as follows:") + "\n"),
        (3, "Copyright 2020 Somebody"), (4, "nothing here"), (5, None), (6, ""), (7, "Licensed under the Apache License, Version 3.7."),
        (8, "\n".join(mit[i:i + 80] for i in range(0, len(mit), 80))), (9, "All rights reserved.\nAll rights reserved."), (None, "Licensed under CC BY-NC 4.0."),
        (10, "x" * 200_000 + "\n" + licenses.WORDINGS["ISC"])]
    got = licenses.scan(docs_of(pairs)).collect()
    best = {}
    for g in got:
        if g.doc_id not in best or (g.confirmed, g.reduction or 0) > (best[g.doc_id].confirmed, best[g.doc_id].reduction or 0):
            best[g.doc_id] = g
    assert (best[1].license, best[1].n_differences, best[1].confirmed, best[1].line_no) == ("MIT notice", 0, True, 2)
    assert best[2].license == "MIT" and best[2].confirmed and "-conditions" in best[2].differences and "+follows" in best[2].differences
    assert not best[3].confirmed and best[7].license == "Apache-2.0 notice" and best[7].differences == ["-2.0", "+3.7"]
    assert best[None].license == "CC-BY-NC-4.0 notice" and best[10].license == "ISC" and best[10].line_no == 2
    assert sorted(g.line_no for g in got if g.doc_id == 9) == [1, 2] and all(g.license == "All rights reserved" for g in got if g.doc_id == 9)
    assert not {4, 5, 6} & set(best)
    assert licenses.scan(docs_of(pairs).limit(0)).collect() == []


def test_wordings_wrapped_and_inside_long_lines(docs_of):
    """Every wording wrapped at 70 columns, in paragraphs, and inside a line of 5 KB, under comment signs too."""
    pairs, want = [], {}
    for name, text in licenses.WORDINGS.items():
        wrapped = textwrap.wrap(text, 70)
        for block in ("\n".join(wrapped), "\n\n".join(wrapped), "\n".join("    # " + x for x in wrapped), f"{prose(5, 450)} {text} {prose(6, 450)}".replace("\n", " ")):
            want[len(pairs)] = name
            pairs.append((len(pairs), f"{prose(7, 30)}\n{block}\n\n{prose(8, 30)}"))
    got = licenses.scan(docs_of(pairs)).collect()
    found = {(g.doc_id, g.license): g.n_differences for g in got if g.confirmed}
    assert [(d, n) for d, n in want.items() if found.get((d, n)) != 0] == []
    assert {g.license for g in got if g.confirmed and g.doc_id in {d for d, n in want.items() if n == "Apache-2.0"}} == {"Apache-2.0"}


def test_ranking_against_every_wording():
    """The ranking is by what each wording saves, tried one by one."""
    import zstandard

    scanner = licenses._scanner(tuple(sorted(licenses.WORDINGS.items())))
    for name, text in licenses.WORDINGS.items():
        block = text.replace("Software", "Program")
        data, base = block.encode(), len(zstandard.ZstdCompressor(level=licenses.LEVEL).compress(block.encode()))
        saved = {n: 1 - len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=zstandard.ZstdCompressionDict(w.encode(), zstandard.DICT_TYPE_RAWCONTENT)).compress(data)) / base
                 for n, w in licenses.WORDINGS.items()}
        assert [round(s, 9) for s, _ in scanner.rank(block)] == sorted((round(s, 9) for s in saved.values()), reverse=True)
        assert scanner.best(block)[0] == name
