import hashlib
import re

import pytest

from gistline.llm import sketch
from tests.llm.conftest import prose


def parts(text):
    return {p for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", text) if p}


def likeness(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, pairs):
    rows = sorted(((d, t or "") for d, t in pairs), key=lambda x: -x[0])
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) == len(by_id)
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(t, edited)) and r.near_next == pytest.approx(likeness(t, nxt))
        assert r.paragraphs_lost == len(parts(t) - parts(edited)) and r.paragraphs_gained == len(parts(edited) - parts(t))
    same = {}
    for d, t in rows:
        assert same.setdefault(t, by_id[d].fingerprint) == by_id[d].fingerprint


def test_against_sets(docs_of, odd_pairs, monkeypatch):
    pairs = [(i * 3, t) for i, (_, t) in enumerate(odd_pairs)] + [(1000 + i, prose(i, 50 + 7 * i)) for i in range(25)]
    check(sketch.fingerprints(docs_of(pairs), 3).collect(), pairs)
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 4)  # several ranges of doc_id
    check(sketch.fingerprints(docs_of(pairs), 3).collect(), pairs)


def test_larger_after_failure(docs_of, monkeypatch):
    pairs = [(i, prose(i, 400)) for i in range(6)]
    monkeypatch.setattr(sketch, "ROUNDS", 5)  # too few for most
    got = sketch.fingerprints(docs_of(pairs), 2).collect()
    assert max(r.attempt for r in got) > 0
    check(got, pairs)


def test_odd_rows(docs_of, odd_pairs):
    got = sketch.fingerprints(docs_of(odd_pairs), 2).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((d or -1, len(t or "")) for d, t in odd_pairs)
    assert sketch.fingerprints(docs_of([(1, "x")]).limit(0), 2).collect() == []
    (one,) = sketch.fingerprints(docs_of([(4, "A b. C d.")]), 2).collect()
    assert one.near_next == 1.0


def test_no_python_in_the_plan(docs_of, odd_pairs, capsys):
    sketch.with_edits(sketch.neighbours(docs_of(odd_pairs), 2)).explain()
    plan = capsys.readouterr().out.split("Scan ExistingRDD")[0]
    assert not re.search("Python|Pandas|Arrow", plan)
