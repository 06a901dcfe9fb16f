"""Carriers in SQL, for the DuckDB oracle: the given tables in the shape of logs, projects and symbols.

``carriers.py`` builds the same rows as DataFrames; the oracle comparison checks one against the other.
"""

CARRIER_SQL: dict[str, str] = {}

CARRIER_SQL["log_lines"] = """
SELECT doc_id AS log_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
       unnest(string_split(text, chr(10))) AS line FROM documents
"""

CARRIER_SQL["runs"] = """
SELECT o_orderkey AS log_id,
 CASE o_orderkey % 12 WHEN 0 THEN './gradlew assembleDebug' WHEN 1 THEN './gradlew :app:testDebugUnitTest'
  WHEN 2 THEN 'pytest tests/' WHEN 3 THEN 'npx jest' WHEN 4 THEN 'vitest run' WHEN 5 THEN 'npm install'
  WHEN 6 THEN 'pnpm i' WHEN 7 THEN 'make all' WHEN 8 THEN 'python -m x' WHEN 9 THEN 'some-runner'
  WHEN 10 THEN 'ci.sh' ELSE 'echo hello' END AS command,
 CASE o_orderkey % 12 WHEN 7 THEN 'ok' || chr(10) || 'BUILD SUCCESSFUL in 2s'
  WHEN 8 THEN '===== test session starts =====' WHEN 9 THEN 'com.foo.BarTest > testBaz PASSED'
  WHEN 10 THEN 'PASS src/a.ts' || chr(10) || 'Tests: 1 passed' ELSE o_orderpriority END AS head,
 CASE WHEN o_orderkey % 97 = 0 THEN 124 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS exit_code,
 o_orderkey % 97 = 0 AS timed_out, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, o_orderdate AS ended_at
FROM orders
"""

CARRIER_SQL["build_lines"] = """
WITH b AS (SELECT user_id AS log_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events),
u AS (SELECT log_id, max(n) AS m FROM b GROUP BY log_id)
SELECT log_id, n AS line_no, CASE
 WHEN event_type = 'error' AND log_id % 3 <> 0 THEN 'e: file:///src/mod' || CAST(event_id % 4 AS VARCHAR(10)) || '/File' || CAST(event_id % 13 AS VARCHAR(10)) || '.kt:' || CAST(event_id % 400 + 1 AS VARCHAR(10)) || ':' || CAST(event_id % 80 + 1 AS VARCHAR(10)) || ' Unresolved reference: sym' || CAST(event_id % 7 AS VARCHAR(10))
 WHEN event_type = 'click' THEN 'w: /src/File' || CAST(event_id % 13 AS VARCHAR(10)) || '.kt:' || CAST(event_id % 400 + 1 AS VARCHAR(10)) || ' Parameter p' || CAST(event_id % 17 AS VARCHAR(10)) || ' is never used'
 WHEN event_type = 'purchase' THEN '/src/Foo' || CAST(event_id % 11 AS VARCHAR(10)) || '.java:' || CAST(event_id % 300 + 1 AS VARCHAR(10)) || CASE WHEN event_id % 5 = 0 THEN ': error: ' ELSE ': warning: ' END || 'unchecked call ' || CAST(event_id % 3 AS VARCHAR(10))
 WHEN event_type = 'signup' THEN '> Task :app:t' || CAST(event_id % 30 AS VARCHAR(10)) || CASE event_id % 9 WHEN 0 THEN ' FAILED' WHEN 1 THEN '' WHEN 2 THEN ' NO-SOURCE' ELSE ' UP-TO-DATE' END
 ELSE 'Download https://repo.example.com/a' || CAST(event_id % 50 AS VARCHAR(10)) || '.pom' END AS line FROM b
UNION ALL SELECT log_id, m + 1, 'FAILURE: Build failed with an exception.' FROM u WHERE log_id % 3 <> 0
UNION ALL SELECT log_id, m + 2, '* What went wrong:' FROM u WHERE log_id % 3 <> 0
UNION ALL SELECT log_id, m + 3, 'Execution failed for task :app:t' || CAST(log_id % 30 AS VARCHAR(10)) || '.' FROM u WHERE log_id % 3 <> 0
UNION ALL SELECT log_id, m + 4, '* Try:' FROM u WHERE log_id % 3 <> 0
UNION ALL SELECT log_id, m + 5, 'BUILD ' || CASE WHEN log_id % 3 <> 0 THEN 'FAILED' ELSE 'SUCCESSFUL' END || ' in ' || CAST(log_id % 60 AS VARCHAR(10)) || 's' FROM u
"""

CARRIER_SQL["npm_lines"] = """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS n FROM lineitem)
SELECT l_suppkey AS log_id, CAST(n AS BIGINT) AS line_no, CASE l_linenumber
 WHEN 1 THEN 'npm warn deprecated @s/pkg' || CAST(l_partkey % 23 AS VARCHAR(10)) || '@' || CAST(l_partkey % 5 AS VARCHAR(10)) || '.0.0: no longer supported since v' || CAST(l_partkey % 23 AS VARCHAR(10))
 WHEN 2 THEN 'npm warn peer dep x' || CAST(l_partkey % 12 AS VARCHAR(10))
 WHEN 3 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'npm error code E' || CAST(l_partkey % 9 AS VARCHAR(10)) ELSE 'idealTree timing' END
 WHEN 4 THEN '   from the root project r' || CAST(l_partkey % 6 AS VARCHAR(10))
 WHEN 5 THEN ''
 WHEN 6 THEN 'added ' || CAST(l_partkey AS VARCHAR(10)) || ' packages in 3s'
 ELSE CAST(l_partkey % 20 AS VARCHAR(10)) || ' vulnerabilities (1 low)' END AS line FROM li
"""

CARRIER_SQL["junit_lines"] = """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS n FROM lineitem),
x AS (SELECT l_suppkey AS log_id, n, l_partkey, l_returnflag, k.k AS k FROM li CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k
 WHERE k.k = 0 OR l_returnflag = 'R')
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY n, k) AS BIGINT) AS line_no, CASE k
 WHEN 0 THEN 'com.ex.Supp' || CAST(log_id AS VARCHAR(10)) || 'Test > part' || CAST(l_partkey AS VARCHAR(10)) || CASE l_returnflag WHEN 'R' THEN ' FAILED' WHEN 'A' THEN ' PASSED' ELSE ' SKIPPED' END
 WHEN 1 THEN '    java.lang.AssertionError: part ' || CAST(l_partkey % 31 AS VARCHAR(10))
 WHEN 2 THEN '        at org.junit.Assert.fail(Assert.java:89)'
 WHEN 3 THEN '        at com.ex.Part.check(Part.kt:' || CAST(l_partkey % 200 AS VARCHAR(10)) || ')'
 ELSE '' END AS line FROM x
"""

CARRIER_SQL["pytest_lines"] = """
WITH o AS (SELECT o_custkey % 40 AS log_id, o_orderkey AS ok, o_orderstatus AS st, o_custkey AS ck FROM orders),
g AS (SELECT log_id, count(*) AS c, sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS f FROM o GROUP BY log_id),
x AS (SELECT log_id, 0 AS sec, CAST(0 AS BIGINT) AS n, '===== test session starts =====' AS line FROM g
UNION ALL SELECT log_id, 1, 0, 'platform linux -- Python 3.' || CAST(log_id % 14 AS VARCHAR(10)) FROM g
UNION ALL SELECT log_id, 2, ok, 'tests/test_' || CAST(ck AS VARCHAR(10)) || '.py ..F [ 10%]' FROM o
UNION ALL SELECT log_id, 3, 0, '===== ERRORS =====' FROM g WHERE log_id % 2 = 0
UNION ALL SELECT log_id, 4, ok, CASE WHEN ok % 4 = 0 THEN '' ELSE 'E   ConnectionError: c' || CAST(ck AS VARCHAR(10)) END FROM o WHERE log_id % 2 = 0 AND st = 'P'
UNION ALL SELECT log_id, 5, 0, '===== FAILURES =====' FROM g WHERE f > 0 AND log_id % 5 <> 0
UNION ALL SELECT log_id, 6, ok, CASE WHEN ok % 3 = 0 THEN '' ELSE 'E   assert ' || CAST(ck AS VARCHAR(10)) || ' == ' || CAST(ok % 10 AS VARCHAR(10)) END FROM o WHERE st = 'F' AND log_id % 5 <> 0
UNION ALL SELECT log_id, 7, 0, '===== short test summary info =====' FROM g WHERE log_id % 5 <> 0
UNION ALL SELECT log_id, 8, ok, 'FAILED tests/test_' || CAST(ck AS VARCHAR(10)) || '.py::t' || CAST(ok AS VARCHAR(20)) FROM o WHERE st = 'F' AND log_id % 5 <> 0
UNION ALL SELECT log_id, 9, 0, '===== ' || CASE WHEN log_id % 5 <> 0 THEN CAST(f AS VARCHAR(10)) || ' failed, ' ELSE '' END || CAST(c - f AS VARCHAR(10)) || ' passed in 4.2s =====' FROM g)
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY sec, n) AS BIGINT) AS line_no, line FROM x
"""

CARRIER_SQL["jest_lines"] = """
WITH o AS (SELECT o_custkey % 40 AS log_id, o_orderkey AS ok, o_orderstatus AS st, o_custkey AS ck, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT log_id, count(*) AS c, sum(CASE WHEN st = 'F' THEN 1 ELSE 0 END) AS f FROM o GROUP BY log_id),
x AS (SELECT log_id, CAST(n AS BIGINT) AS n, 0 AS k, CASE WHEN st = 'F' THEN 'FAIL  src/s' ELSE 'PASS  src/s' END || CAST(ck AS VARCHAR(10)) || '.test.ts (9ms)' AS line FROM o
UNION ALL SELECT log_id, n, 1, '  ● S' || CAST(ck AS VARCHAR(10)) || ' › case ' || CAST(ok AS VARCHAR(20)) FROM o WHERE st = 'F'
UNION ALL SELECT log_id, n, 2 + n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE '    Expected: ' || CAST(n_nationkey AS VARCHAR(10)) END FROM o CROSS JOIN nation WHERE st = 'F' AND n_nationkey <= ok % 25
UNION ALL SELECT log_id, c + 1, 0, 'Summary of all failing tests' FROM g WHERE f > 0
UNION ALL SELECT log_id, c + 2, 0, 'Test Suites: ' || CAST(f AS VARCHAR(10)) || ' failed, ' || CAST(c AS VARCHAR(10)) || ' total' FROM g
UNION ALL SELECT log_id, c + 3, 0, 'Tests:       ' || CAST(f AS VARCHAR(10)) || ' failed, ' || CAST(c AS VARCHAR(10)) || ' total' FROM g
UNION ALL SELECT log_id, c + 4, 0, 'Time:        5.2 s' FROM g)
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY n, k) AS BIGINT) AS line_no, line FROM x
"""

CARRIER_SQL["generic_lines"] = """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS n FROM lineitem)
SELECT l_suppkey AS log_id, CAST(n AS BIGINT) AS line_no, CASE
 WHEN l_partkey % 50 = 0 THEN 'Error: cannot load part ' || CAST(l_partkey AS VARCHAR(10))
 WHEN l_partkey % 50 = 1 THEN 'NullPointerException in errors module'
 WHEN l_partkey % 50 = 2 THEN 'FATAL: step ' || CAST(l_linenumber AS VARCHAR(10)) || ' failed'
 ELSE 'status ' || l_returnflag || ' ' || l_linestatus END AS line FROM li
"""

CARRIER_SQL["ansi_text"] = """
SELECT event_id, chr(27) || '[' || CAST(30 + event_id % 8 AS VARCHAR(10)) || 'm' || event_type || chr(27) || '[0m ' || CASE WHEN event_id % 4 = 0 THEN chr(27) || '[2K' ELSE '' END || props AS raw FROM events
"""

CARRIER_SQL["project_files"] = """
SELECT s_suppkey AS project_id, 'gradlew' AS path, '' AS content FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'build.gradle.kts', '' FROM supplier WHERE s_suppkey % 9 = 0
UNION ALL SELECT s_suppkey, 'package.json', CASE WHEN s_suppkey % 2 = 0 THEN '{"devDependencies":{"jest":"29"}}' WHEN s_suppkey % 5 = 1 THEN '{"scripts":{"test":"vitest run"}}' ELSE '{"scripts":{"build":"tsc"}}' END FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'Cargo.toml', '' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey, 'Makefile', '' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'go.mod', '' FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT s_suppkey, 'conftest.py', '' FROM supplier WHERE s_suppkey % 13 = 0
UNION ALL SELECT s_suppkey, 'pyproject.toml', CASE WHEN s_suppkey % 8 = 1 THEN '[tool.pytest.ini_options]' ELSE '[project]' END FROM supplier WHERE s_suppkey % 4 = 1
"""

CARRIER_SQL["source_files"] = """
SELECT doc_id AS file_key, '/src/' || source || '/F' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 14 WHEN 0 THEN '.kt' WHEN 1 THEN '.kts' WHEN 2 THEN '.java' WHEN 3 THEN '.ts' WHEN 4 THEN '.TSX' WHEN 5 THEN '.js' WHEN 6 THEN '.mjs' WHEN 7 THEN '.py' WHEN 8 THEN '.pyi' WHEN 9 THEN '.go' WHEN 10 THEN '.rs' WHEN 11 THEN '.md' WHEN 12 THEN '.jsx' ELSE '' END AS path,
 1700000000000 + doc_id * 60000 AS mtime_ms, n_chars AS size_bytes, text AS source_text FROM documents
"""

CARRIER_SQL["symbols"] = """
WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer),
nn AS (SELECT n.n_nationkey, n.n_name, n.n_regionkey, count(c.c_custkey) AS cnt FROM nation n LEFT JOIN c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name, n.n_regionkey),
ns AS (SELECT *, sum(5 * cnt + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS hi_off FROM nn)
SELECT r_regionkey AS file_id, r_name AS name, r_name AS qualified_name, CAST(NULL AS VARCHAR(10)) AS parent_qualified_name, 'class' AS kind, CAST(1 AS BIGINT) AS line_lo, CAST(s.m + 2 AS BIGINT) AS line_hi FROM region JOIN (SELECT n_regionkey, max(hi_off) AS m FROM ns GROUP BY n_regionkey) s ON s.n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, n_name, r_name || '.' || n_name, r_name, 'class', CAST(hi_off - (5 * cnt + 2) + 2 AS BIGINT), CAST(hi_off + 1 AS BIGINT) FROM ns JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_regionkey, c_name, r_name || '.' || n_name || '.' || c_name, r_name || '.' || n_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'field' ELSE 'method' END, CAST(hi_off - (5 * cnt + 2) + 3 + 5 * (rn - 1) AS BIGINT), CAST(hi_off - (5 * cnt + 2) + 3 + 5 * (rn - 1) + 4 AS BIGINT) FROM c JOIN ns ON ns.n_nationkey = c.c_nationkey JOIN region ON r_regionkey = n_regionkey
"""

CARRIER_SQL["ident_hits"] = """
SELECT DISTINCT CAST(o_orderkey % 5 AS INT) AS file_id, CAST(o_custkey % 1600 + 1 AS BIGINT) AS line_no FROM orders
"""

# Source texts around the lines of a document: {n} is its number, {i} a line's, {x} the line, {q} the
# line inside a string, {y} inside a block comment. A line becomes one line of code by its number modulo 3.
CODE_LANGUAGES = ["kotlin", "java", "typescript", "javascript", "python", "go", "rust", None]
CODE_TEXT = {
    "kotlin": {
        "head": ["/**", " * Notes on {n}.", " */", '@Suppress("unused")', "data class Doc{n}(val size: Int,", "    private val tag: String) {"],
        "body": ["    // {x}", '    val t{i} = "{q}"', "    private fun f{i}(x: Int): Int { return x } // {x}"],
        "foot": ["}", "fun a{n}() = 1; fun b{n}() = 2"], "open": []},
    "java": {
        "head": ["/* About {n} */", "@Deprecated", "public class Doc{n} {"],
        "body": ["    /* {y} */", '    private static String t{i} = "{q}";', "    public int f{i}(int x) { return x; } // {x}"],
        "foot": ["}"], "open": []},
    "typescript": {
        "head": ["// About {n}", "export class Doc{n} {"],
        "body": ["  // {x}", '  static t{i}: string = "{q}";', "  f{i}(x: number): number { return x; } // {x}"],
        "foot": ["}", "export const c{n} = 1; export type A{n} = string;"], "open": []},
    "javascript": {
        "head": ["// About {n}", "export class Doc{n} {"],
        "body": ["  // {x}", '  t{i} = "{q}";', "  async f{i}(x) { return x; } // {x}"],
        "foot": ["}", "const c{n} = `", "class Hidden { (`;"], "open": []},
    "python": {
        "head": ["# About {n}", "class Doc{n}:", "    x = 0"],
        "body": ["    # {x}", '    t{i} = "{q}"', "    def f{i}(self): return 1  # {x}"],
        "foot": ["def a{n}(x,", "       y): pass"], "open": ["x = ("]},
    "go": {
        "head": ["// About {n}", "type Doc{n} struct {", "\tn int", "}"],
        "body": ["// {x}", 'func (d *Doc{n}) T{i}() string { return "{q}" }', "func f{i}(x int) int { return x } // {x}"],
        "foot": ["func z{n}() {", "}"], "open": ["func z{n}() {"]},
    "rust": {
        "head": ["// About {n}", "pub struct Doc{n} { n: u8 }", "impl Doc{n} {"],
        "body": ["    // {x}", '    const T{i}: &str = "{q}";', "    pub fn f{i}(&self) -> u8 { 1 } // {x}"],
        "foot": ["}"], "open": []},
    None: {"head": [], "body": ["{x}", "{x}", "{x}"], "foot": [], "open": []},
}


def _quoted(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


_CODE_PARTS = ",\n ".join(
    f"({_quoted(language)}, '{part}', {k}, {_quoted(text)}, {len(parts['head'])})"
    for language, parts in CODE_TEXT.items() for part, texts in parts.items() for k, text in enumerate(texts, 1))

CARRIER_SQL["code_docs"] = f"""
SELECT doc_id AS file_id, doc_id % 8 AS place, list_value({', '.join(_quoted(x) for x in CODE_LANGUAGES)})[doc_id % 8 + 1] AS language,
 string_split(text, chr(10)) AS texts, len(string_split(text, chr(10))) AS n,
 CASE WHEN doc_id % 7 = 3 THEN 'open' ELSE 'foot' END AS ending, doc_id % 5 = 0 AND doc_id % 7 <> 3 AS extra FROM documents
"""

CARRIER_SQL["code_lines"] = f"""
WITH parts(language, part, k, tmpl, heads) AS (VALUES {_CODE_PARTS}),
raw AS (
 SELECT d.file_id, d.language, k AS line_no, 0 AS i, '' AS x, tmpl FROM code_docs d JOIN parts p ON p.language IS NOT DISTINCT FROM d.language AND part = 'head'
 UNION ALL SELECT file_id, d.language, heads + u.i, u.i, texts[u.i], tmpl FROM code_docs d, unnest(range(1, n + 1)) AS u(i)
   JOIN parts p ON p.language IS NOT DISTINCT FROM d.language AND part = 'body' AND k = u.i % 3 + 1
 UNION ALL SELECT file_id, d.language, n + heads + k, 0, '', tmpl FROM code_docs d JOIN parts p ON p.language IS NOT DISTINCT FROM d.language AND part = ending
 UNION ALL SELECT file_id, language, n + 1000, 0, '', ') ]' FROM code_docs WHERE extra),
filled AS (SELECT file_id, language, line_no, replace(replace(replace(replace(replace(tmpl, '{{n}}', CAST(file_id AS VARCHAR)), '{{i}}', CAST(i AS VARCHAR)),
   '{{y}}', replace(x, '*/', '')), '{{q}}', replace(replace(x, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')), '{{x}}', x) AS line FROM raw)
SELECT file_id, language, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS line_no, line FROM filled
"""

CARRIER_SQL["bracket_lines"] = """
SELECT doc_id AS file_id, 'go' AS language, CAST(u.i AS BIGINT) AS line_no, translate((string_split(text, chr(10)))[u.i], 'tmbkvhwg"''`/' || chr(92), '()[]{}[}') AS line
FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
"""
