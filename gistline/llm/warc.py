"""Web archives: records written as WARC files, read back, and assembled to one nested row per capture.

A capture is written as three records that name each other through WARC-Concurrent-To: the request,
the response (or a revisit, where an equal payload is archived elsewhere) and metadata. Files are
written and read by Spark's text source with the records' border as its line separator, so they are
split, committed and found in any store like other tables. Every record of an archive carries a
boundary of its own after the version line; a page that quotes a WARC record does not cut another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistline.llm.common import new_folder, small, stage

LEAST = 1000  #: Payloads of fewer bytes are archived each time.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_EOL, _GAP = "\r\n", "\r\n\r\n"
_CONTROLS = "".join(map(chr, [*range(0x21), 0x7F]))
PRIMARY = ("response", "revisit", "resource")  #: Records that a capture is named by.


def _first_lines(boundary: str) -> str:
    return f"WARC/1.1{_EOL}Archive-Boundary: {boundary}{_EOL}"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_EOL)), F.lit(""))


def _escaped(url: Column) -> Column:
    """The URL on one line: blanks and control characters in percent form."""
    coded = F.aggregate(
        F.array(*[F.lit(c) for c in _CONTROLS]), url,
        lambda done, c: F.replace(done, c, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c).cast("long")), 2, "0"))))
    return F.when(url.rlike("[\\x00-\\x20\\x7F]"), coded).otherwise(url)


def _record(boundary: str, kind: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    return F.concat(
        F.lit(_first_lines(boundary) + "WARC-Type: "), kind, F.lit(_EOL), *headers,
        F.lit(f"WARC-Date: {DATE}{_EOL}Content-Type: {content_type}{_EOL}"),
        _line("Content-Length", F.octet_length(block)), F.lit(_EOL), block)


def page_records(pages: DataFrame, boundary: str, least: int = LEAST) -> DataFrame:
    """One text per WARC record (column ``value``), three for each row of ``pages``.

    Of rows with equal payloads (by SHA-1) of at least ``least`` bytes the one with the largest
    page_id is a response and the others revisit it; a row that repeats the largest page_id is a
    response too. A null page_id is the smallest. Null html is an empty payload, a null url an absent header.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), _escaped(F.col("url")).alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    kept = (
        rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("_digest"))
        .agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    kept = small(kept, 64 + F.coalesce(F.octet_length("kept.url"), F.lit(0)))
    rows = rows.join(kept, (rows.digest == kept["_digest"]) & (rows["size"] >= least), "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    ids = {f"{kind}_id": F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")) for kind in ("capture", "request", "metadata")}
    rows = rows.withColumn("again", again).withColumns(ids)
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    uri = _line("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}"), _line("Content-Length", F.col("size")), F.lit(_EOL))
    response = _record(
        boundary, F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        [_line("WARC-Record-ID", F.col("capture_id")), uri, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
         F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {PROFILE}{_EOL}"), _line("WARC-Refers-To-Target-URI", F.col("kept.url")))).otherwise(F.lit(""))],
        "application/http; msgtype=response", F.when(F.col("again"), http).otherwise(F.concat(http, "html")))
    together = _line("WARC-Concurrent-To", F.col("capture_id"))
    request = _record(
        boundary, F.lit("request"), [_line("WARC-Record-ID", F.col("request_id")), uri, together], "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{_EOL}"), _line("Host", host), F.lit(_EOL)))
    metadata = _record(
        boundary, F.lit("metadata"), [_line("WARC-Record-ID", F.col("metadata_id")), uri, together], "application/warc-fields",
        _line("page_id", F.col("page_id")))
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[str, str]:
    """Write gzipped WARC files, one for each task, with all rows of ``pages``; gives their folder and boundary."""
    boundary = uuid.uuid4().hex
    folder = folder or new_folder(pages.sparkSession)
    page_records(pages, boundary, least).write.option("lineSep", _GAP).option("compression", "gzip").text(folder)
    return folder, boundary


def read_records(spark: SparkSession, path: str, boundary: str | None = None) -> DataFrame:
    """The records of WARC files (plain or gzipped), one row each.

    Out: record_id, type, concurrent_to (array), target_uri, date, recorded_digest, refers_to_uri,
    content_type, block (binary), complete. With the boundary that ``write_archives`` gave, a record
    ends nowhere else than written. Without it (archives of others) a record ends before a version
    line after an empty line; ``complete`` is false where its block is then shorter than its header says.
    """
    ends = _GAP + (_first_lines(boundary) if boundary else "WARC/1.")
    begin = ends[len(_GAP):]
    lines = spark.read.option("lineSep", ends).text(path)
    whole = F.when(F.col("value").startswith(begin), F.substr("value", F.lit(len(begin) + 1))).otherwise(F.col("value"))
    parts = lines.select(whole.alias("v")).withColumn("head", F.substring_index("v", _GAP, 1))

    def header(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))

    length = F.coalesce(header("Content-Length").try_cast("int"), F.lit(0))
    block = F.substring(F.col("v").cast("binary"), F.octet_length("head") + 5, length)
    return parts.filter("trim(head) <> ''").select(
        header("WARC-Record-ID").alias("record_id"), F.lower(header("WARC-Type")).alias("type"),
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*?)[ \t]*$"), F.lit(1)).alias("concurrent_to"),
        header("WARC-Target-URI").alias("target_uri"), header("WARC-Date").alias("date"),
        header("WARC-Payload-Digest").alias("recorded_digest"), header("WARC-Refers-To-Target-URI").alias("refers_to_uri"),
        header("Content-Type").alias("content_type"), block.alias("block"), length.alias("_length"),
    ).withColumn("complete", F.octet_length("block") == F.col("_length")).drop("_length")


def http_parts(records: DataFrame) -> DataFrame:
    """``records`` with http_head, payload and its digest and size; a block that is no HTTP message is all payload.

    For revisits, payload is null, and digest and size are those recorded with them.
    """
    http = F.coalesce(F.col("content_type").startswith("application/http"), F.lit(False))
    text = F.col("block").cast("string")
    records = records.withColumn("http_head", F.when(http, F.substring_index(text, _GAP, 1)))
    payload = F.when(http, F.substring(F.col("block"), F.octet_length("http_head") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    records = records.withColumn("payload", F.when(F.col("type") != "revisit", payload))
    said = F.regexp_extract("http_head", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")
    return records.withColumns({
        "payload_digest": F.coalesce(F.sha1("payload"), F.lower(F.regexp_replace("recorded_digest", "^(?i)sha1:", ""))),
        "payload_bytes": F.when(F.col("payload").isNull(), said).otherwise(F.octet_length("payload").cast("long"))})


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, record (struct), requests and metadata (arrays of structs by record id).

    A request or metadata record belongs to the response, revisit or resource that it names in
    WARC-Concurrent-To or that names it; several such records of one capture are all in its row. Those
    whose capture is not in the archive come in a row without record, so nothing is lost. Records
    without an id cannot be named and are captures of their own; a repeated record gives a repeated row.
    """
    fields = [c for c in records.columns]
    primary = records.filter(F.col("type").isin(*PRIMARY))
    others = records.filter(F.col("type").isin("request", "metadata"))
    named = others.select(F.explode("concurrent_to").alias("capture_id"), F.col("record_id").alias("_id"))
    naming = primary.filter("record_id is not null").select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("_id"))
    naming = naming.join(others.select(F.col("record_id").alias("_id")).distinct(), "_id", "left_semi").select("capture_id", "_id")
    links = named.unionByName(naming).filter("_id is not null").distinct()
    linked = links.join(others.withColumn("_id", F.col("record_id")), "_id").drop("_id")
    alone = others.join(links.select(F.col("_id").alias("record_id")), "record_id", "left_anti").withColumn("capture_id", F.lit(None).cast("string"))

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", *[c for c in fields if c != "record_id"]))))

    sides = linked.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    record = F.struct(*fields)
    whole = primary.select(F.col("record_id").alias("capture_id"), record.alias("record")).join(sides, "capture_id", "full")
    nothing = F.array().cast(whole.schema["requests"].dataType)
    single = F.array(F.struct("record_id", *[c for c in fields if c != "record_id"]))
    lost = alone.select(
        "capture_id", F.lit(None).cast(whole.schema["record"].dataType).alias("record"),
        F.when(F.col("type") == "request", single).otherwise(nothing).alias("requests"),
        F.when(F.col("type") == "metadata", single).otherwise(nothing).alias("metadata"))
    filled = [F.coalesce(c, nothing).alias(c) for c in ("requests", "metadata")]
    return whole.select("capture_id", "record", *filled).unionByName(lost)


def field(block: Column, name: str) -> Column:
    """A field of a warc-fields block, or null."""
    return F.nullif(F.regexp_extract(block.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Every page as found in the archives that it was written to.

    In: page_id, url, html (more columns are ignored). Out: page_id, payload_bytes, payload_digest,
    record_type, refers_to, intact (the digest of what was read is the recorded one; true for
    revisits). A revisit leads to the response that has its digest. Nulls, ties and repeated rows: see
    ``page_records``; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder, boundary = write_archives(pages, least=least)
    read = http_parts(read_records(spark, folder, boundary))
    found = assemble(stage(read.select(
        "record_id", "type", "concurrent_to", "recorded_digest", "payload_digest", "payload_bytes",
        F.when(F.col("type") == "metadata", field(F.col("block"), "page_id")).cast("long").alias("page_id"), "complete")))
    rows = stage(found.select(
        F.col("metadata")[0]["page_id"].alias("page_id"), F.col("record.payload_bytes").alias("payload_bytes"),
        F.col("record.payload_digest").alias("payload_digest"), F.col("record.type").alias("record_type"),
        (F.col("record.complete") & (F.col("record.recorded_digest") == F.concat(F.lit("sha1:"), "record.payload_digest"))).alias("intact")))
    revisit = F.col("record_type") == "revisit"
    kept = (
        rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max(F.when(~revisit, F.col("page_id"))).alias("_kept"), F.count_if(revisit).alias("_again")).filter("_again > 0").drop("_again"))
    return rows.join(small(stage(kept), 64), revisit & (F.col("payload_digest") == F.col("_digest")), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("_kept").alias("refers_to"), "intact")
