import base64
import collections
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from gistline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int, kept string, value string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, None, "v") for r in rows], SCHEMA).repartition(3)


def odd_pages():
    big = "<p>" + "é€𐍈 " * 400
    quoted = "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [
        (1, "http://a.example/x?q=1#top", big), (2, "http://a.example/y", big), (3, None, big), (4, "http://a.example", "small"), (5, "http://a b.example/\r\nHost: evil", "small"),
        (6, "not a url", None), (7, "http://c.example/", ""), (8, "http://d.example/", quoted), (9, "http://d.example/", quoted), (10, "http://e.example/", "ends\r\n\r\n"),
        (11, "http://e.example/", "\r\n\r\n"), (None, "http://f.example/", "n" * 2000), (None, "http://f.example/", "n" * 2000), (None, None, big), (12, "http://g.example/", "m" * 1000),
        (12, "http://g.example/", "m" * 1000), (13, "http://h.example/", "k" * 999), (14, "http://h.example/", "k" * 999), (-3, "http://h.example/", "m" * 1000), (15, "http://i.example/", "z" * 3_000_000)]


def brute(rows, least=1000):
    body = [((h or "").encode()) for _, _, h in rows]
    best = {}
    for (p, _, _), b in zip(rows, body):
        if p is not None and len(b) >= least:
            best[b] = max(best.get(b, p), p)
    out = []
    for (p, _, _), b in zip(rows, body):
        again = len(b) >= least and best.get(b, p) != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None, True))
    return collections.Counter(out)


def test_round_trip(spark):
    rows = odd_pages()
    got = warc.round_trip(pages_of(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).collect() == []


def parse(raw):
    """Records of a WARC file by their lengths, the way any reader does."""
    at, out = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        assert lines[0].startswith("WARC/1.")
        head = [x.split(": ", 1) for x in lines[1:]]
        size = int(dict(head)["Content-Length"])
        out.append((dict(head), raw[end + 4:end + 4 + size]))
        assert raw[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    return out


def test_files_are_warc(spark):
    rows = odd_pages()
    folder, boundary = warc.write_archives(pages_of(spark, rows))
    records = []
    where = folder.removeprefix("file:")
    for f in os.listdir(where):
        if f.endswith(".gz"):
            with gzip.open(f"{where}/{f}") as g:
                records += parse(g.read())
    assert collections.Counter(h["WARC-Type"] for h, _ in records) == collections.Counter(
        {"request": len(rows), "metadata": len(rows), **collections.Counter(t for _, _, _, t, _, _ in brute(rows).elements())})
    ids = [h["WARC-Record-ID"] for h, _ in records]
    assert len(set(ids)) == len(ids) == 3 * len(rows)
    assert all("evil" not in h for h, _ in records)  # a URL makes no header of its own
    bodies = {b.split(b"\r\n\r\n", 1)[1] for h, b in records if h["WARC-Type"] == "response"}
    assert bodies == {(h or "").encode() for _, _, h in rows}
    captures = warc.assemble(warc.read_records(spark, folder, boundary)).collect()
    assert len(captures) == len(rows) and all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    assert {c.record.target_uri for c in captures} >= {None, "not%20a%20url"}


def record(kind, ident, block, *headers, version="1.0"):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *([f"WARC-Record-ID: {ident}"] if ident else []), *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Both directions of concurrent-to, several metadata records, orphans, binary payloads, split files."""
    http = "Content-Type: application/http; msgtype=response"
    body = bytes(range(256)) * 40 + b"\r\n\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    parts = [
        record("warcinfo", "<w>", b"software: x\r\n"),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", "<r1>", b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n" + body, http, "WARC-Concurrent-To: <q1>", f"WARC-Payload-Digest: sha1:{digest}", version="1.1"),
        record("metadata", "<m1>", b"a: 1\r\n", "WARC-Concurrent-To: <r1>", "Content-Type: application/warc-fields"),
        record("metadata", "<m2>", b"b: 2\r\n", "warc-concurrent-to:   <r1>  "),
        record("metadata", "<m3>", b"c: 3\r\n", "WARC-Concurrent-To: <gone>"),
        record("metadata", None, b"d: 4\r\n"), record("resource", "<s1>", b"plain")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"".join(record("response", f"<x{i}>", b"HTTP/1.1 200 OK\r\n\r\n" + b"\r\n" * (i % 5) + b"y" * i, http) for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        records = warc.http_parts(warc.read_records(spark, str(tmp_path)))
        assert records.rdd.getNumPartitions() > 30
        rows = {r.capture_id: r for r in warc.assemble(records).filter("capture_id is not null").collect()}
        lost = warc.assemble(records).filter("capture_id is null").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = rows["<r1>"]
    assert bytes(one.record.payload) == body and one.record.payload_digest == hashlib.sha1(body).hexdigest() and one.record.complete
    assert [q.record_id for q in one.requests] == ["<q1>"] and [m.record_id for m in one.metadata] == ["<m1>", "<m2>"]
    assert rows["<gone>"].record is None and [m.record_id for m in rows["<gone>"].metadata] == ["<m3>"]
    assert [bytes(r.metadata[0].block) for r in lost] == [b"d: 4\r\n"]
    assert bytes(rows["<s1>"].record.payload) == b"plain"
    assert all(bytes(rows[f"<x{i}>"].record.payload) == b"\r\n" * (i % 5) + b"y" * i for i in range(300))


def test_a_record_cut_by_a_quoted_version_line_is_marked(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("response", "<r>", b"x\r\n\r\nWARC/1.0\r\ny") + record("response", "<s>", b"z"))
    got = {r.record_id: r.complete for r in warc.read_records(spark, str(tmp_path)).filter(F.col("record_id").isNotNull()).collect()}
    assert got == {"<r>": False, "<s>": True}
