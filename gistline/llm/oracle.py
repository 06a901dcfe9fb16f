"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations


def _crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, byte: {step}), 4294967295::BIGINT)"


_DIGITS = "list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)"
_HEX = "list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT)"

ORACLE: dict[str, str] = {
    "op11_bitmap_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_crc32(_DIGITS)} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars,
    sha256(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY part, p))::VARCHAR) AS node
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)),
path AS (SELECT conv_id, d, chars, node FROM rebuilt UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
lasts AS (SELECT conv_id, max(d) AS total FROM path GROUP BY conv_id),
nodes AS (
  SELECT node, d, min(p.conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, max(total) = d AS leaf,
    string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (total = d) AS ends
  FROM path p JOIN lasts USING (conv_id) GROUP BY node, d),
up AS (
  SELECT n.node, p.node AS parent FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n - 1) * n.chars) AS saved
  FROM nodes n JOIN path p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.node)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN up USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes q ON q.node = up.parent""",

    "op12_warc_captures": """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, max(page_id) AS kept FROM rows WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to, true AS intact
FROM rows LEFT JOIN kept USING (payload_digest)""",

    "op13_importance_resampling": f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT 's' AS kind, id, text FROM docs UNION ALL SELECT 't', NULL, text FROM benchmark)),
buckets AS (SELECT word, {_crc32(_HEX)} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words)),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + 10000) / ((c.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM counts c, totals a),
weights AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 's' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
}
