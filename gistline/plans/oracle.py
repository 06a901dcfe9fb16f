"""Oracle SQL: every query once more as plain SQL for DuckDB.

Written with ordinary windows over whole logs, so that it shares no idea with the span-based
Spark plans it checks. Patterns are the shared constants; word bounds use RE2's ASCII ``\\b``.
"""

from __future__ import annotations

from gistline.functions import patterns as P
from gistline.plans.carrier_sql import CARRIER_SQL, CODE_TEXT

ORACLE: dict[str, str] = {}


def _with(views: str, *ctes: str, select: str) -> str:
    carriers = [f"{v} AS ({CARRIER_SQL[v]})" for v in views.split()]
    parts = [*carriers, *[c.strip().rstrip(",") for c in ctes if c]]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _x(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, '{pattern}', {group})"


def _trim(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')"


_BEFORE = "OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_COLS = "log_id, kind, part_no, summary, body, original_tokens, outcome"


def _sizes(view: str) -> str:
    return f"""sizes AS (SELECT log_id, count(*) AS n_lines, (sum(length(line)) + count(*) - 1 + 3) // 4 AS original_tokens
        FROM {view} GROUP BY log_id)"""


def _digest(kind: str, stats: str = "stats", rows: str = "rows") -> str:
    return f"""SELECT s.log_id, '{kind}' AS kind, CAST(0 AS BIGINT) AS part_no, s.summary, coalesce(b.body, '') AS body,
        CAST(s.original_tokens AS BIGINT) AS original_tokens, s.outcome
      FROM {stats} s LEFT JOIN (SELECT log_id, string_agg(text, chr(10) ORDER BY section, seq) AS body
        FROM {rows} GROUP BY log_id) b ON b.log_id = s.log_id"""


# --- sources and scalars ------------------------------------------------------------------

ORACLE["explode_lines"] = _with("log_lines", select="SELECT log_id, line_no, line FROM log_lines")
ORACLE["combine_streams"] = _with("runs", select="""
  SELECT log_id, CASE WHEN log_id % 3 = 0 THEN command WHEN head = '' THEN command
    ELSE head || chr(10) || command END AS text FROM runs""")
ORACLE["log_ids"] = _with("runs", select=f"""
  SELECT log_id AS run, CASE WHEN k = '' THEN 'log' ELSE k END || '_' ||
    substr(sha256(log_id::VARCHAR || chr(10) || head), 1, 12) AS log_id
  FROM (SELECT *, substr(regexp_replace(command, '[^A-Za-z0-9]', '', 'g'), 1, 8) AS k FROM runs)""")
ORACLE["missing_logs"] = _with("runs log_lines", select="""
  SELECT r.log_id, '[error] log_id "' || r.log_id || '" not found' AS error
  FROM runs r WHERE NOT EXISTS (SELECT 1 FROM log_lines l WHERE l.log_id = r.log_id)""")
ORACLE["prune_expired"] = _with("runs", select="""
  SELECT count(*) AS removed FROM runs
  WHERE (SELECT max(ended_at) FROM runs) - ended_at > INTERVAL 7 DAY""")
ORACLE["token_estimate"] = """
  SELECT doc_id AS log_id, (length(text) + 3) // 4 AS tokens FROM documents"""
ORACLE["strip_ansi"] = _with("ansi_text", select="""
  SELECT event_id, regexp_replace(raw, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS text FROM ansi_text""")
ORACLE["run_status"] = _with("runs", select="""
  SELECT log_id, CASE WHEN timed_out THEN 'TIMED OUT' WHEN exit_code = 0 THEN 'OK'
    ELSE 'EXIT ' || exit_code::VARCHAR END AS status FROM runs""")

# --- classification -----------------------------------------------------------------------

_CLASSIFY = rf"""CASE
  WHEN regexp_matches(head, '\b\S+(?:\.\S+)+\s+>\s+\S+\s+(PASSED|FAILED|SKIPPED)\b') THEN 'junit'
  WHEN regexp_matches(lower(command), '\b(gradle|gradlew)\b')
    THEN CASE WHEN contains(lower(command), 'test') THEN 'junit' ELSE 'gradle' END
  WHEN regexp_matches(lower(command), '\bpytest\b') OR {_m('head', P.HEAD_PYTEST)} THEN 'pytest'
  WHEN regexp_matches(lower(command), '\b(jest|vitest)\b') THEN 'jest'
  WHEN {_m('head', P.HEAD_JEST_SUITE)} AND {_m('head', P.HEAD_JEST_TOTAL)} THEN 'jest'
  WHEN regexp_matches(lower(command), '\b(npm|yarn|pnpm)\b') OR {_m('head', P.HEAD_NPM)} THEN 'npm'
  WHEN {_m('head', P.HEAD_GRADLE)} THEN 'gradle' ELSE 'generic' END"""
ORACLE["classify"] = _with("runs", select=f"SELECT log_id, {_CLASSIFY} AS kind FROM runs")
ORACLE["can_handle"] = _with("runs", select=rf"""
  SELECT log_id,
    regexp_matches(command, '(?i)\b(gradle|gradlew)\b') OR {_m('head', P.HEAD_GRADLE)} AS gradle,
    regexp_matches(command, '(?i)\b(npm|yarn|pnpm)\b') OR {_m('head', P.HEAD_NPM)} AS npm,
    regexp_matches(command, '(?i)\b(jest|vitest)\b')
      OR ({_m('head', P.HEAD_JEST_SUITE)} AND {_m('head', P.HEAD_JEST_TOTAL)}) AS jest,
    regexp_matches(command, '(?i)\bpytest\b') OR {_m('head', P.HEAD_PYTEST)} AS pytest,
    (regexp_matches(command, '(?i)\bgradle(w)?\b') AND regexp_matches(command, '(?i)\btest'))
      OR regexp_matches(head, '\b>\s+\S+\s+(PASSED|FAILED|SKIPPED)\b') AS junit,
    true AS generic FROM runs""")
ORACLE["detect_build_tool"] = _with("project_files", select="""
  SELECT project_id, tool, CASE WHEN tool IS NULL THEN '[error] no build tool found' END AS error FROM (
    SELECT project_id, CASE WHEN bool_or(path IN ('gradlew', 'build.gradle', 'build.gradle.kts')) THEN 'gradle'
      WHEN bool_or(path = 'package.json') THEN 'npm' WHEN bool_or(path = 'Cargo.toml') THEN 'cargo'
      WHEN bool_or(path IN ('Makefile', 'makefile')) THEN 'make' END AS tool
    FROM project_files GROUP BY project_id)""")
ORACLE["detect_test_framework"] = _with("project_files", select=r"""
  SELECT project_id, framework, CASE WHEN framework IS NULL THEN '[error] no test framework found' END AS error FROM (
    SELECT project_id, CASE WHEN bool_or(path = 'go.mod') THEN 'go'
      WHEN bool_or(path IN ('pytest.ini', 'conftest.py') OR (path = 'pyproject.toml' AND contains(content, '[tool.pytest'))) THEN 'pytest'
      WHEN bool_or(path = 'package.json' AND regexp_matches(content, '"jest"|"vitest"|\bvitest\b|\bjest\b')) THEN 'jest'
      WHEN bool_or(path IN ('gradlew', 'build.gradle', 'build.gradle.kts')) THEN 'junit' END AS framework
    FROM project_files GROUP BY project_id)""")

# --- build logs ---------------------------------------------------------------------------

_GRADLE = rf"""
gc AS (SELECT log_id, line_no, t, CASE WHEN {_m('t', P.BUILD_RESULT)} THEN 'result' WHEN {_m('t', P.FAILURE_HEADER)} THEN 'failure'
   WHEN {_m('t', P.WRONG_HEADER)} THEN 'wrong' WHEN {_m('t', P.TRY_HEADER)} THEN 'try' WHEN {_m('t', P.TASK)} THEN 'task'
   WHEN {_m('t', P.KOTLIN)} THEN 'kotlin' WHEN {_m('t', P.JAVAC)} THEN 'javac' ELSE 'other' END AS c
   FROM (SELECT log_id, line_no, regexp_replace(line, '\s+$', '') AS t FROM build_lines)),
gs AS (SELECT *, last_value(CASE WHEN c = 'wrong' THEN 1 WHEN c IN ('result', 'failure', 'try') THEN 0 END IGNORE NULLS) {_BEFORE} AS inside FROM gc),
gf AS (SELECT log_id, line_no, t, CASE WHEN c IN ('result', 'failure', 'wrong', 'try') THEN c
   WHEN inside = 1 THEN CASE WHEN t <> '' THEN 'detail' ELSE 'none' END ELSE c END AS fact FROM gs),
diags AS (SELECT log_id, line_no, 'kotlin' AS compiler, CASE {_x('t', P.KOTLIN, 1)} WHEN 'e' THEN 'error' ELSE 'warning' END AS severity,
     regexp_extract({_x('t', P.KOTLIN, 2)}, '([^/]*)/*$', 1) AS file, CAST({_x('t', P.KOTLIN, 3)} AS BIGINT) AS line,
     CAST(nullif({_x('t', P.KOTLIN, 4)}, '') AS BIGINT) AS col, {_trim(_x('t', P.KOTLIN, 5))} AS message FROM gf WHERE fact = 'kotlin'
   UNION ALL SELECT log_id, line_no, 'javac', {_x('t', P.JAVAC, 3)}, regexp_extract({_x('t', P.JAVAC, 1)}, '([^/]*)/*$', 1),
     CAST({_x('t', P.JAVAC, 2)} AS BIGINT), NULL, {_trim(_x('t', P.JAVAC, 4))} FROM gf WHERE fact = 'javac'),
res AS (SELECT log_id, coalesce(arg_max({_x('t', P.BUILD_RESULT, 1)}, line_no) FILTER (fact = 'result'), 'UNKNOWN') AS status,
     nullif(arg_max({_x('t', P.BUILD_RESULT, 2)}, line_no) FILTER (fact = 'result'), '') AS duration FROM gf GROUP BY log_id),
tasks AS (SELECT log_id, line_no, {_x('t', P.TASK, 1)} AS task FROM gf WHERE fact = 'task'),
wg AS (SELECT log_id, message, count(*) AS n, min(line_no) AS first_line, arg_min(file, line_no) AS file FROM diags WHERE severity = 'warning' GROUP BY log_id, message),
wr AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, first_line) AS rank FROM wg),
note AS (SELECT log_id, line_no, {_trim('t')} AS text, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq
   FROM gf JOIN res USING (log_id) WHERE fact = 'detail' AND status = 'FAILED'),
{_sizes('build_lines')},
stats AS (SELECT *, CASE status WHEN 'UNKNOWN' THEN 'BUILD (status unknown)' ELSE 'BUILD ' || status END || ' (' || errors ||
     CASE errors WHEN 1 THEN ' error' ELSE ' errors' END || ', ' || unique_warnings || CASE unique_warnings WHEN 1 THEN ' warning' ELSE ' warnings' END || ')' AS summary,
     CASE status WHEN 'SUCCESSFUL' THEN 'ok' WHEN 'FAILED' THEN 'failed' ELSE 'unknown' END AS outcome
   FROM (SELECT s.log_id, s.original_tokens, r.status, r.duration, coalesce(d.errors, 0) AS errors, coalesce(d.warnings, 0) AS warnings,
       coalesce(w.u, 0) AS unique_warnings, coalesce(k.tasks, 0) AS tasks FROM sizes s JOIN res r USING (log_id)
     LEFT JOIN (SELECT log_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM diags GROUP BY log_id) d USING (log_id)
     LEFT JOIN (SELECT log_id, count(*) AS u FROM wg GROUP BY log_id) w USING (log_id)
     LEFT JOIN (SELECT log_id, count(*) AS tasks FROM tasks GROUP BY log_id) k USING (log_id))),
rows AS (SELECT log_id, 0 AS section, 0 AS seq, 'Duration: ' || duration AS text FROM stats WHERE duration IS NOT NULL
   UNION ALL SELECT log_id, 1, 0, chr(10) || 'Errors:' FROM stats WHERE errors > 0 AND duration IS NULL
   UNION ALL SELECT log_id, 1, 0, chr(10) || 'Errors:' FROM stats WHERE errors > 0 AND duration IS NOT NULL
   UNION ALL SELECT log_id, 1, line_no, '  ' || file || ':' || line || coalesce(':' || col, '') || ' — ' || message FROM diags WHERE severity = 'error'
   UNION ALL SELECT log_id, 2, 0, chr(10) || 'Warnings (' || unique_warnings || ' unique' || CASE WHEN unique_warnings = warnings THEN '' ELSE
       ', collapsed from ' || warnings || ' occurrences' || CASE WHEN unique_warnings > 10 THEN ', showing top 10' ELSE '' END END || '):' FROM stats WHERE unique_warnings > 0
   UNION ALL SELECT log_id, 2, rank, '  ' || CASE WHEN n > 1 THEN '[×' || n || '] ' ELSE '' END || message FROM wr WHERE rank <= 10
   UNION ALL SELECT log_id, 2, 99, '  … ' || (unique_warnings - 10) || ' more unique warnings omitted' FROM stats WHERE unique_warnings > 10
   UNION ALL SELECT log_id, 3, 0, chr(10) || 'What went wrong:' FROM note WHERE seq = 1
   UNION ALL SELECT log_id, 3, seq, '  ' || text FROM note WHERE seq <= 6
   UNION ALL SELECT log_id, 4, 0, chr(10) || 'Failed task' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ': ' || string_agg(task, ', ' ORDER BY line_no) FROM tasks GROUP BY log_id)
"""


def _gradle(select: str) -> str:
    return _with("build_lines", _GRADLE, select=select)


ORACLE["kotlin_diagnostics"] = _gradle("SELECT log_id, line_no, severity, file, line, col, message FROM diags WHERE compiler = 'kotlin'")
ORACLE["javac_diagnostics"] = _gradle("SELECT log_id, line_no, severity, file, line, message FROM diags WHERE compiler = 'javac'")
ORACLE["build_result"] = _gradle("SELECT log_id, status, duration FROM res")
ORACLE["failed_tasks"] = _gradle("SELECT log_id, line_no, task FROM tasks")
ORACLE["what_went_wrong"] = _gradle("SELECT log_id, line_no, text, seq FROM note")
ORACLE["gradle_warnings_topk"] = _gradle("SELECT log_id, message, n, first_line, file, rank FROM wr WHERE rank <= 10")
ORACLE["gradle_summary"] = _gradle("""
  SELECT s.log_id, status, duration, errors, unique_warnings, warnings, summary, w.message AS top_warning, w.n AS top_count
  FROM stats s LEFT JOIN wr w ON w.log_id = s.log_id AND w.rank = 1""")
ORACLE["gradle_digest"] = _gradle(_digest("gradle"))
_TOKENS = "SELECT log_id, kind, original_tokens, (length(body) + 3) // 4 AS compressed_tokens FROM"
ORACLE["digest_tokens"] = _gradle(f"{_TOKENS} ({_digest('gradle')})")
ORACLE["reduction_pct"] = _gradle(f"""
  SELECT log_id, CAST(floor((original_tokens - compressed_tokens) / original_tokens * 100 + 0.5) AS BIGINT) AS pct
  FROM ({_TOKENS} ({_digest('gradle')}))""")
ORACLE["format_response"] = _with("build_lines runs", _GRADLE, select=f"""
  SELECT d.log_id, d.part_no, summary || ' [' || CASE WHEN timed_out THEN 'TIMED OUT' WHEN exit_code = 0 THEN 'OK'
      ELSE 'EXIT ' || exit_code END || ', ' || duration_ms || 'ms]' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10)
    || '[Compressed from ~' || original_tokens || ' tokens → ~' || ((length(body) + 3) // 4) || ' tokens (' ||
      CAST(floor((original_tokens - (length(body) + 3) // 4) / original_tokens * 100 + 0.5) AS BIGINT) || '% reduction)]' || chr(10)
    || '[Full log stored as log_id="' || d.log_id || '"]' AS response
  FROM ({_digest('gradle')}) d JOIN runs r ON r.log_id = d.log_id""")

# --- package install logs -----------------------------------------------------------------

_NPM = rf"""
nc AS (SELECT log_id, line_no, line, t, CASE WHEN t = '' THEN 'blank' WHEN {_m('t', P.NPM_ERROR)} THEN 'error' ELSE 'x' END AS c
   FROM (SELECT log_id, line_no, line, regexp_replace(line, '\s+$', '') AS t FROM npm_lines)),
ns AS (SELECT *, last_value(CASE c WHEN 'error' THEN true WHEN 'blank' THEN false END IGNORE NULLS) {_BEFORE} AS open FROM nc),
nf AS (SELECT log_id, line_no, t, CASE WHEN c <> 'x' THEN c WHEN open AND {_m('line', '^' + chr(92) + 's')} THEN 'cont'
   WHEN {_m('t', P.NPM_DEPRECATED)} THEN 'deprecated' WHEN {_m('t', P.NPM_WARN)} THEN 'warn'
   WHEN {_m('t', P.NPM_CHANGE)} THEN 'change' WHEN {_m('t', P.NPM_AUDIT)} THEN 'audit' ELSE 'none' END AS fact FROM ns),
errs AS (SELECT *, CASE WHEN fact = 'error' AND {_m('text', P.NPM_CODE + chr(92) + 'S')} THEN regexp_replace(text, '{P.NPM_CODE}', '') END AS code,
     row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq
   FROM (SELECT log_id, line_no, fact, CASE fact WHEN 'error' THEN {_trim(_x('t', P.NPM_ERROR, 1))} ELSE {_trim('t')} END AS text
     FROM nf WHERE fact IN ('error', 'cont')) WHERE text <> ''),
dep AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, first_line) AS rank FROM (
   SELECT log_id, package, count(*) AS n, min(line_no) AS first_line, arg_min(message, line_no) AS message FROM (
     SELECT log_id, line_no, regexp_replace({_x('t', P.NPM_DEPRECATED, 1)}, '@[^@]+$', '') AS package, {_trim(_x('t', P.NPM_DEPRECATED, 2))} AS message
     FROM nf WHERE fact = 'deprecated') GROUP BY log_id, package)),
oth AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY n DESC, first_line) AS rank FROM (
   SELECT log_id, message, count(*) AS n, min(line_no) AS first_line FROM (
     SELECT log_id, line_no, {_trim(_x('t', P.NPM_WARN, 1))} AS message FROM nf WHERE fact = 'warn')
   WHERE NOT regexp_matches(message, '(?i)^deprecated\b') GROUP BY log_id, message)),
{_sizes('npm_lines')},
stats AS (SELECT *, CASE WHEN errors > 0 THEN 'npm FAILED' || coalesce(' (' || code || ')', '')
     WHEN deprecated > 0 THEN 'npm OK (' || deprecated || ' unique deprecation warnings)' ELSE 'npm OK' END AS summary,
     CASE WHEN errors > 0 THEN 'failed' ELSE 'ok' END AS outcome FROM (
   SELECT s.log_id, s.original_tokens,
     (SELECT count(*) FROM nf WHERE nf.log_id = s.log_id AND fact = 'change') AS changes,
     (SELECT count(*) FROM nf WHERE nf.log_id = s.log_id AND fact = 'audit') AS audits,
     (SELECT count(*) FROM errs WHERE errs.log_id = s.log_id) AS errors,
     (SELECT arg_max(code, line_no) FROM errs WHERE errs.log_id = s.log_id AND code IS NOT NULL) AS code,
     (SELECT count(*) FROM dep WHERE dep.log_id = s.log_id) AS deprecated,
     (SELECT count(*) FROM oth WHERE oth.log_id = s.log_id) AS warned FROM sizes s)),
rows AS (SELECT log_id, 0 AS section, line_no AS seq, t AS text FROM nf WHERE fact = 'change'
   UNION ALL SELECT log_id, 1, -1, '' FROM stats WHERE errors > 0 AND changes > 0
   UNION ALL SELECT log_id, 1, 0, 'Errors:' FROM stats WHERE errors > 0
   UNION ALL SELECT log_id, 1, seq, '  ' || text FROM errs WHERE seq <= 40
   UNION ALL SELECT log_id, 1, 99, '  … ' || (errors - 40) || ' more error lines' FROM stats WHERE errors > 40
   UNION ALL SELECT log_id, 2, -1, '' FROM stats WHERE deprecated > 0 AND changes + errors > 0
   UNION ALL SELECT log_id, 2, 0, 'Deprecated packages (' || deprecated || ' unique):' FROM stats WHERE deprecated > 0
   UNION ALL SELECT log_id, 2, rank, '  ' || CASE WHEN n > 1 THEN '[×' || n || '] ' ELSE '' END || package || ' — ' ||
       CASE WHEN length(message) > 80 THEN left(message, 77) || '...' ELSE message END FROM dep WHERE rank <= 10
   UNION ALL SELECT log_id, 2, 99, '  … ' || (deprecated - 10) || ' more deprecations omitted' FROM stats WHERE deprecated > 10
   UNION ALL SELECT log_id, 3, -1, '' FROM stats WHERE warned > 0 AND changes + errors + deprecated > 0
   UNION ALL SELECT log_id, 3, 0, 'Other warnings (' || warned || ' unique):' FROM stats WHERE warned > 0
   UNION ALL SELECT log_id, 3, rank, '  ' || CASE WHEN n > 1 THEN '[×' || n || '] ' ELSE '' END || message FROM oth WHERE rank <= 8
   UNION ALL SELECT log_id, 4, -1, '' FROM stats WHERE audits > 0 AND changes + errors + deprecated + warned > 0
   UNION ALL SELECT log_id, 4, 0, 'Audit:' FROM stats WHERE audits > 0
   UNION ALL SELECT log_id, 4, line_no, '  ' || t FROM nf WHERE fact = 'audit')
"""


def _npm(select: str) -> str:
    return _with("npm_lines", _NPM, select=select)


ORACLE["npm_errors"] = _npm("SELECT log_id, line_no, text, code FROM errs")
ORACLE["npm_error_code"] = _npm("SELECT log_id, arg_max(code, line_no) AS code FROM errs WHERE code IS NOT NULL GROUP BY log_id")
ORACLE["npm_deprecations"] = _npm("""SELECT log_id, package, n, first_line, rank,
  CASE WHEN length(message) > 80 THEN left(message, 77) || '...' ELSE message END AS message FROM dep""")
ORACLE["npm_other_warnings"] = _npm("SELECT log_id, message, n, first_line, rank FROM oth")
ORACLE["npm_changes"] = _npm("SELECT log_id, line_no, t AS text FROM nf WHERE fact = 'change'")
ORACLE["npm_audit"] = _npm("SELECT log_id, line_no, t AS text FROM nf WHERE fact = 'audit'")
ORACLE["npm_summary"] = _npm("SELECT log_id, summary, code, changes, audits, errors, deprecated, warned FROM stats")
ORACLE["npm_digest"] = _npm(_digest("npm"))

# --- other output -------------------------------------------------------------------------

_GENERIC = rf"""
runs1 AS (SELECT *, sum(CASE WHEN line IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS run
   FROM (SELECT *, lag(line) OVER (PARTITION BY log_id ORDER BY line_no) AS prev FROM generic_lines)),
islands AS (SELECT log_id, run, min(line) AS line, count(*) AS n FROM runs1 GROUP BY log_id, run),
flat AS (SELECT log_id, run, 0 AS k, line FROM islands UNION ALL SELECT log_id, run, 1, '  … (repeated ' || n || '×)' FROM islands WHERE n > 1),
dd AS (SELECT log_id, line, row_number() OVER (PARTITION BY log_id ORDER BY run, k) AS seq FROM flat),
er AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS rank, count(*) OVER (PARTITION BY log_id) AS error_count
   FROM dd WHERE regexp_matches(line, '(?i)\b(error|fail(ed|ure)?|exception|fatal|panic)\b')),
sz AS (SELECT log_id, count(*) AS n, (sum(length(line)) + count(*) - 1 + 3) // 4 AS tokens FROM dd GROUP BY log_id),
cut AS (SELECT *, CASE WHEN tokens > 2000 THEN CAST(floor(n * 0.3::DOUBLE) AS BIGINT) ELSE n END AS h,
    CASE WHEN tokens > 2000 THEN CAST(floor(n * 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS tl FROM sz),
mid AS (SELECT d.log_id, seq * 2 AS ord, CASE WHEN seq <= h OR seq > n - tl THEN line
      ELSE '… [' || (n - h - tl) || ' lines omitted] …' END AS line
   FROM dd d JOIN cut USING (log_id) WHERE seq <= h + 1 OR seq > n - tl),
{_sizes('generic_lines')},
stats AS (SELECT s.log_id, s.original_tokens, 'unknown' AS outcome, coalesce(e.c, 0) AS errors,
    CASE WHEN e.c > 0 THEN 'Command output (' || e.c || ' error-matching lines)' ELSE 'Command output' END AS summary
   FROM sizes s LEFT JOIN (SELECT log_id, count(*) AS c FROM er GROUP BY log_id) e USING (log_id)),
rows AS (SELECT log_id, 0 AS section, 0 AS seq, 'Error-matching lines (' || errors || '):' AS text FROM stats WHERE errors > 0
   UNION ALL SELECT log_id, 0, rank, line FROM er WHERE rank <= 50
   UNION ALL SELECT log_id, 1, 0, '' FROM stats WHERE errors > 0
   UNION ALL SELECT log_id, 2, ord, line FROM mid)
"""


def _generic(select: str) -> str:
    return _with("generic_lines", _GENERIC, select=select)


ORACLE["dedupe_consecutive"] = _generic("SELECT log_id, seq, line FROM dd")
ORACLE["error_lines"] = _generic("SELECT log_id, seq, line, rank, error_count FROM er")
ORACLE["middle_truncate"] = _generic("SELECT log_id, ord, line FROM mid")
ORACLE["generic_digest"] = _generic(_digest("generic"))

# --- JavaScript test logs -----------------------------------------------------------------

_JEST = rf"""
jc AS (SELECT log_id, line_no, t, CASE WHEN {_m('t', P.JEST_SUMMARY)} THEN 'summary' WHEN {_m('t', P.JEST_SUITES)} THEN 'suites'
   WHEN {_m('t', P.JEST_TESTS)} THEN 'tests' WHEN {_m('t', P.JEST_TIME)} THEN 'time' WHEN {_m('t', P.JEST_PASS)} THEN 'pass'
   WHEN {_m('t', P.JEST_FAIL)} THEN 'fail' WHEN {_m('t', P.JEST_MARKER)} THEN 'marker' WHEN {_trim('t')} = '' THEN 'blank' ELSE 'other' END AS c
   FROM (SELECT log_id, line_no, regexp_replace(line, '\r$', '') AS t FROM jest_lines)),
js AS (SELECT *, coalesce(max(CASE WHEN c = 'summary' THEN 1 END) {_BEFORE}, 0) AS seen,
   last_value(CASE c WHEN 'fail' THEN {_x('t', P.JEST_FAIL, 1)} WHEN 'pass' THEN '' END IGNORE NULLS) {_BEFORE} AS suite,
   last_value(CASE WHEN c = 'marker' THEN line_no WHEN c IN ('pass', 'fail', 'summary') THEN -1 END IGNORE NULLS) {_BEFORE} AS block FROM jc),
fl AS (SELECT log_id, line_no AS block, suite, {_trim(_x('t', P.JEST_MARKER, 1))} AS title FROM js WHERE c = 'marker' AND seen = 0 AND suite <> ''),
dt AS (SELECT log_id, block, line_no, t AS text, row_number() OVER (PARTITION BY log_id, block ORDER BY line_no) AS seq
   FROM js WHERE c = 'other' AND seen = 0 AND suite <> '' AND block > 0),
tot AS (SELECT log_id, nullif(arg_max({_trim(_x('t', P.JEST_SUITES, 1))}, line_no) FILTER (c = 'suites'), '') AS suites,
   nullif(arg_max({_trim(_x('t', P.JEST_TESTS, 1))}, line_no) FILTER (c = 'tests'), '') AS tests,
   nullif(arg_max({_trim(_x('t', P.JEST_TIME, 1))}, line_no) FILTER (c = 'time'), '') AS time,
   count(*) FILTER (c = 'pass') AS passed FROM jc GROUP BY log_id),
{_sizes('jest_lines')},
stats AS (SELECT *, CASE WHEN tests IS NOT NULL THEN 'Tests: ' || tests || coalesce(' | Suites: ' || suites, '')
     WHEN failures > 0 THEN failures || ' test failure(s)' ELSE 'Tests OK' END AS summary,
     CASE WHEN failures > 0 OR coalesce(regexp_matches(tests, '\d+ failed'), false) THEN 'failed'
       WHEN tests IS NULL AND passed = 0 THEN 'unknown' ELSE 'ok' END AS outcome
   FROM (SELECT s.original_tokens, tot.*, coalesce(f.n, 0) AS failures FROM sizes s JOIN tot USING (log_id)
     LEFT JOIN (SELECT log_id, count(*) AS n FROM fl GROUP BY log_id) f USING (log_id))),
rows AS (SELECT log_id, 0 AS section, 0 AS seq, 'Test Suites: ' || suites AS text FROM stats WHERE suites IS NOT NULL
   UNION ALL SELECT log_id, 0, 1, 'Tests: ' || tests FROM stats WHERE tests IS NOT NULL
   UNION ALL SELECT log_id, 0, 2, 'Time: ' || time FROM stats WHERE time IS NOT NULL
   UNION ALL SELECT log_id, 1, 0, chr(10) || 'Failed tests (' || failures || '):' FROM stats WHERE failures > 0
   UNION ALL SELECT log_id, 1, block, chr(10) || '  ✗ ' || suite || chr(10) || '    ● ' || title FROM fl
   UNION ALL SELECT log_id, 1, line_no, '    ' || text || CASE WHEN seq = 20 THEN chr(10) || '        … (truncated)' ELSE '' END FROM dt WHERE seq <= 20
   UNION ALL SELECT log_id, 2, 0, chr(10) || '(' || passed || ' test suite(s) passed — names collapsed)' FROM stats WHERE passed > 0)
"""


def _jest(select: str) -> str:
    return _with("jest_lines", _JEST, select=select)


ORACLE["jest_suites"] = _jest(f"""SELECT log_id, line_no, c AS status,
  CASE c WHEN 'pass' THEN {_x('t', P.JEST_PASS, 1)} ELSE {_x('t', P.JEST_FAIL, 1)} END AS suite FROM jc WHERE c IN ('pass', 'fail')""")
ORACLE["jest_failures"] = _jest("SELECT log_id, block, suite, title FROM fl")
ORACLE["jest_failure_details"] = _jest("SELECT log_id, block, line_no, text, seq FROM dt")
ORACLE["jest_totals"] = _jest("SELECT log_id, suites, tests, time FROM tot")
ORACLE["jest_digest"] = _jest(_digest("jest"))

# --- Python test logs ---------------------------------------------------------------------

_PYTEST = rf"""
pc AS (SELECT log_id, line_no, t, CASE WHEN {_m('t', P.PYTEST_FAILURES)} THEN 1 WHEN {_m('t', P.PYTEST_ERRORS)} THEN 2
   WHEN {_m('t', P.PYTEST_SHORT)} THEN 3 WHEN {_m('t', P.PYTEST_FINAL)} AND {_m('t', P.PYTEST_RULED)} THEN 4
   WHEN {_m('t', P.PYTEST_OTHER)} THEN 5 ELSE 0 END AS c
   FROM (SELECT log_id, line_no, regexp_replace(line, '\r$', '') AS t FROM pytest_lines)),
pk AS (SELECT *, coalesce(max(CASE WHEN c BETWEEN 1 AND 4 THEN 1 END) {_BEFORE}, 0) AS known FROM pc),
ps AS (SELECT *, coalesce(last_value(CASE WHEN c BETWEEN 1 AND 4 THEN c WHEN c = 5 AND known = 1 THEN 4 END IGNORE NULLS) {_BEFORE}, 0) AS s FROM pk),
sec AS (SELECT log_id, line_no, CASE s WHEN 0 THEN 'prelude' WHEN 1 THEN 'failures' WHEN 2 THEN 'errors' WHEN 3 THEN 'short_summary' ELSE 'tail' END AS section, t AS text
   FROM ps WHERE c = 0 OR (c = 5 AND s = 0)),
res AS (SELECT log_id, nullif((SELECT arg_max({_trim("regexp_replace(t, '=+', '', 'g')")}, line_no) FROM pc WHERE pc.log_id = l.log_id AND c = 4), '') AS final,
   (SELECT arg_min(text, line_no) FROM sec WHERE sec.log_id = l.log_id AND section = 'prelude' AND {_m('text', P.PYTEST_PLATFORM)}) AS platform
   FROM (SELECT DISTINCT log_id FROM pc) l),
b1 AS (SELECT *, {_trim('text')} = '' AS blank, lag({_trim('text')} = '') OVER (PARTITION BY log_id, section ORDER BY line_no) AS pb,
   max(CASE WHEN {_trim('text')} <> '' THEN line_no END) OVER (PARTITION BY log_id, section) AS last_text FROM sec WHERE section IN ('errors', 'failures')),
b2 AS (SELECT log_id, section, text, row_number() OVER (PARTITION BY log_id, section ORDER BY line_no) AS seq, count(*) OVER (PARTITION BY log_id, section) AS n,
   CASE section WHEN 'errors' THEN @e ELSE @f END AS cap FROM b1 WHERE NOT blank OR (pb = false AND line_no < last_text)),
blk AS (SELECT log_id, section, seq, CASE WHEN n > cap AND seq = floor(cap * 0.6) + 1
     THEN '… [' || CAST(n - floor(cap * 0.6) - floor(cap * 0.4) AS BIGINT) || ' lines omitted] …' ELSE text END AS line
   FROM b2 WHERE n <= cap OR seq <= floor(cap * 0.6) + 1 OR seq > n - floor(cap * 0.4)),
sh AS (SELECT log_id, {_trim('text')} AS text, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq
   FROM sec WHERE section = 'short_summary' AND {_trim('text')} <> ''),
{_sizes('pytest_lines')},
stats AS (SELECT *, CASE WHEN final IS NOT NULL THEN 'pytest: ' || final WHEN listed > 0 THEN 'pytest: ' || listed || ' failure(s)' ELSE 'pytest OK' END AS summary,
     CASE WHEN listed > 0 OR failures > 0 OR errors > 0 OR coalesce(regexp_matches(final, 'failed|error'), false) THEN 'failed'
       WHEN final IS NULL THEN 'unknown' ELSE 'ok' END AS outcome FROM (
   SELECT s.log_id, s.original_tokens, final, platform,
     (SELECT count(*) FROM sec WHERE sec.log_id = s.log_id AND section = 'errors') AS errors,
     (SELECT count(*) FROM sec WHERE sec.log_id = s.log_id AND section = 'failures') AS failures,
     (SELECT count(*) FROM sh WHERE sh.log_id = s.log_id) AS listed FROM sizes s JOIN res USING (log_id))),
rows AS (SELECT log_id, 0 AS section, 0 AS seq, platform AS text FROM stats WHERE platform IS NOT NULL
   UNION ALL SELECT log_id, 1, 0, '' FROM stats WHERE platform IS NOT NULL AND final IS NOT NULL
   UNION ALL SELECT log_id, 1, 1, final FROM stats WHERE final IS NOT NULL
   UNION ALL SELECT log_id, 2, 0, chr(10) || 'ERRORS:' FROM stats WHERE errors > 0
   UNION ALL SELECT log_id, CASE section WHEN 'errors' THEN 2 ELSE 3 END, seq, line FROM blk
   UNION ALL SELECT log_id, 3, 0, chr(10) || 'FAILURES:' FROM stats WHERE failures > 0
   UNION ALL SELECT log_id, 4, 0, chr(10) || 'Short summary:' FROM stats WHERE listed > 0
   UNION ALL SELECT log_id, 4, seq, '  ' || text FROM sh WHERE seq <= 40)
"""


def _pytest(select: str, errors: int = 60, failures: int = 120) -> str:
    return _with("pytest_lines", _PYTEST.replace("@e", str(errors)).replace("@f", str(failures)), select=select)


ORACLE["pytest_sections"] = _pytest("SELECT log_id, line_no, section, text FROM sec")
ORACLE["pytest_result"] = _pytest("SELECT log_id, final, platform FROM res")
ORACLE["pytest_blocks"] = _pytest("SELECT log_id, section, seq, line FROM blk", 30, 30)
ORACLE["pytest_short_summary"] = _pytest("SELECT log_id, seq, text FROM sh")
ORACLE["pytest_digest"] = _pytest(_digest("pytest"))

# --- JVM test logs ------------------------------------------------------------------------

_FRAMEWORK = " OR ".join(f"starts_with(payload, '{p}')" for p in P.JUNIT_FRAMEWORK)
_JUNIT = rf"""
uc AS (SELECT log_id, line_no, t, CASE WHEN {_m('t', P.JUNIT_RESULT)} THEN {_x('t', P.JUNIT_RESULT, 3)} WHEN {_m('t', P.JUNIT_TOTALS)} THEN 'totals'
   WHEN {_trim('t')} = '' THEN 'blank' ELSE 'other' END AS c
   FROM (SELECT log_id, line_no, regexp_replace(line, '\r$', '') AS t FROM junit_lines)),
us AS (SELECT *, last_value(CASE c WHEN 'FAILED' THEN line_no WHEN 'other' THEN NULL ELSE -1 END IGNORE NULLS) {_BEFORE} AS block FROM uc),
ul AS (SELECT log_id, block, line_no, {_trim('t')} AS text, starts_with({_trim('t')}, 'at ') AS frame, regexp_replace({_trim('t')}, '^at\s+', '') AS payload
   FROM us WHERE c = 'other' AND block > 0),
um AS (SELECT *, row_number() OVER (PARTITION BY log_id, block ORDER BY line_no) AS seq FROM ul WHERE NOT frame),
uf AS (SELECT *, row_number() OVER (PARTITION BY log_id, block ORDER BY line_no) AS seq, count(*) OVER (PARTITION BY log_id, block) AS n
   FROM ul WHERE frame AND NOT ({_FRAMEWORK})),
cnt AS (SELECT log_id, count(*) FILTER (c = 'PASSED') AS passed, count(*) FILTER (c = 'FAILED') AS failed, count(*) FILTER (c = 'SKIPPED') AS skipped,
   arg_max({_trim('t')}, line_no) FILTER (c = 'totals') AS totals FROM uc GROUP BY log_id),
fails AS (SELECT log_id, line_no AS block, {_x('t', P.JUNIT_RESULT, 1)} AS fqcn, {_x('t', P.JUNIT_RESULT, 2)} AS test FROM uc WHERE c = 'FAILED'),
{_sizes('junit_lines').replace('sizes AS', 'usizes AS')},
ustats AS (SELECT s.original_tokens, cnt.*, CASE WHEN totals IS NOT NULL THEN 'junit: ' || totals WHEN failed > 0 THEN 'junit: ' || failed || ' failed, ' || passed || ' passed'
     WHEN passed > 0 THEN 'junit: ' || passed || ' passed' || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped' ELSE '' END
     ELSE 'junit: (no tests detected)' END AS summary, CASE WHEN failed > 0 OR coalesce(try_cast(regexp_extract(totals, '(\d+) failed', 1) AS BIGINT), 0) > 0 THEN 'failed' ELSE 'ok' END AS outcome
   FROM usizes s JOIN cnt USING (log_id) WHERE totals IS NOT NULL OR passed + failed + skipped > 0),
urows AS (SELECT log_id, 0 AS section, 0 AS seq, totals AS text FROM ustats WHERE totals IS NOT NULL
   UNION ALL SELECT log_id, 1, 0, chr(10) || 'Failed tests (' || failed || '):' FROM ustats WHERE failed > 0
   UNION ALL SELECT log_id, 1, block * 100, chr(10) || '  ✗ ' || fqcn || ' > ' || test FROM fails
   UNION ALL SELECT log_id, 1, block * 100 + seq, '    ' || text FROM um WHERE seq <= 4
   UNION ALL SELECT log_id, 1, block * 100 + 10 + seq, '    ' || text FROM uf WHERE seq <= 5
   UNION ALL SELECT DISTINCT log_id, 1, block * 100 + 50, '    … ' || (n - 5) || ' more app frames omitted' FROM uf WHERE n > 5
   UNION ALL SELECT log_id, 2, 0, chr(10) || '(' || passed || ' passed' || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped' ELSE '' END || ' — names collapsed)'
     FROM ustats WHERE passed > 0 OR skipped > 0)
"""


def _junit(select: str) -> str:
    return _with("junit_lines", _JUNIT, select=select)


ORACLE["junit_results"] = _junit("SELECT f.log_id, f.line_no, " + _x("t", P.JUNIT_RESULT, 1) + " AS fqcn, "
                                 + _x("t", P.JUNIT_RESULT, 2) + " AS test, c AS status FROM uc f WHERE c IN ('PASSED', 'FAILED', 'SKIPPED')")
ORACLE["junit_counts"] = _junit("SELECT log_id, passed, failed, skipped FROM cnt WHERE passed + failed + skipped > 0")
# Only what it needs, and no join: a failure's lines are listed by its block.
ORACLE["junit_failures"] = _with("junit_lines", _JUNIT[:_JUNIT.index("ul AS (")], rf"""
jf AS (SELECT log_id, CASE WHEN c = 'FAILED' THEN line_no ELSE block END AS block, line_no, c, t FROM us
   WHERE c = 'FAILED' OR (c = 'other' AND block > 0 AND NOT starts_with({_trim('t')}, 'at '))),
jg AS (SELECT log_id, block, max(CASE WHEN c = 'FAILED' THEN {_x('t', P.JUNIT_RESULT, 1)} END) AS fqcn, max(CASE WHEN c = 'FAILED' THEN {_x('t', P.JUNIT_RESULT, 2)} END) AS test,
   list({_trim('t')} ORDER BY line_no) FILTER (c = 'other') AS texts FROM jf GROUP BY log_id, block)
""", select="""SELECT log_id, block, fqcn, test, u.seq, texts[u.seq] AS text FROM jg,
  unnest(CASE WHEN texts IS NULL THEN [NULL] ELSE range(1, len(texts) + 1) END) AS u(seq)""")
ORACLE["junit_app_frames"] = _junit("SELECT log_id, block, seq, text, 0 AS omitted FROM uf")
ORACLE["junit_digest"] = _junit(_digest("junit", "ustats", "urows"))
# Build logs have no test facts, so all of them fall back to the build digest.
ORACLE["junit_fallback"] = ORACLE["gradle_digest"]

ORACLE["distill_all"] = "\nUNION ALL\n".join(
    f"SELECT {_COLS} FROM ({ORACLE[f'{k}_digest']})" for k in ("gradle", "npm", "jest", "pytest", "junit", "generic"))

ORACLE["distill_runs"] = "\nUNION ALL\n".join(
    f"SELECT '{k}:' || log_id AS run_id, kind, part_no, summary, body, original_tokens, outcome FROM ({ORACLE[f'{k}_digest']})"
    for k in ("gradle", "npm", "jest", "pytest", "junit", "generic"))

_LINE_TOKENS = "SELECT log_id, kind, original_tokens, (length(body) + 3) // 4 AS compressed_tokens FROM"
ORACLE["reduction_report"] = f"""
  WITH acc AS (SELECT a.*, CASE WHEN timed_out THEN 'TIMED OUT' WHEN exit_code = 0 THEN 'OK' ELSE 'EXIT ' || exit_code END AS status
    FROM ({_LINE_TOKENS} ({ORACLE['gradle_digest']}) UNION ALL {_LINE_TOKENS} ({ORACLE['generic_digest']})) a
    JOIN ({CARRIER_SQL['runs']}) r ON r.log_id = a.log_id)
  SELECT kind, status, count(*) AS logs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
    CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens,
    floor((sum(original_tokens) - sum(compressed_tokens)) / sum(original_tokens) * 1000 + 0.5) / 10 AS reduction_pct
  FROM acc GROUP BY ROLLUP (kind, status)"""

# --- retrieval ----------------------------------------------------------------------------

_GREP = r"""
h AS (SELECT log_id, line_no, line, max(CASE WHEN regexp_matches(line, '(?i)than') THEN 1 ELSE 0 END)
    OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM log_lines),
k AS (SELECT *, lag(line_no) OVER (PARTITION BY log_id ORDER BY line_no) AS prev FROM h WHERE near = 1),
g AS (SELECT log_id, line_no, 1 AS part, line_no || ': ' || line AS text FROM k
   UNION ALL SELECT log_id, line_no, 0, '---' FROM k WHERE prev IS NULL OR line_no > prev + 1)
"""
ORACLE["grep_context"] = _with("log_lines", _GREP, select="SELECT log_id, line_no, part, text FROM g")
ORACLE["cap_tokens"] = _with("log_lines", _GREP, select="""
  SELECT log_id, ord, CASE WHEN spent <= 200 THEN text ELSE '… [truncated at 200 tokens; use start_line/end_line to paginate]' END AS text
  FROM (SELECT log_id, line_no * 2 + part + 1 AS ord, text, (length(text) + 3) // 4 + 1 AS cost,
      sum((length(text) + 3) // 4 + 1) OVER (PARTITION BY log_id ORDER BY line_no, part) AS spent FROM g)
  WHERE spent - cost <= 200""")
ORACLE["log_sections"] = f"""
  SELECT 'log' || log_id AS log_id, ord, text FROM ({ORACLE["cap_tokens"]}) WHERE log_id % 3 <> 1
  UNION ALL SELECT 'log' || doc_id, 0, '[error] log_id "log' || doc_id || '" not found' FROM documents WHERE doc_id % 3 = 1"""
ORACLE["slice_lines"] = _with("log_lines", select="SELECT log_id, line_no, line_no || ': ' || line AS text FROM log_lines WHERE line_no BETWEEN 3 AND 8")
ORACLE["head_lines"] = _with("build_lines", select="SELECT log_id, line_no, line_no || ': ' || line AS text FROM build_lines WHERE line_no <= 200")
ORACLE["read_lines"] = _with("source_files", select="""
  , f AS (SELECT file_key, path, size_bytes, string_split(source_text, chr(10)) AS l, len(string_split(source_text, chr(10))) AS n FROM source_files),
  hd AS (SELECT *, least(n, 60) AS last, 'File: ' || path || chr(10) || 'Lines 2-' || least(n, 60) || ' of ' || n || chr(10) AS header FROM f),
  b AS (SELECT file_key, header, u.i AS i, u.i || ': ' || l[u.i] AS text FROM hd, unnest(range(2, last + 1)) AS u(i) WHERE last >= 2),
  r AS (SELECT *, (length(header) + 3) // 4 + sum((length(text) + 3) // 4) OVER (PARTITION BY file_key ORDER BY i) AS spent, (length(text) + 3) // 4 AS cost FROM b)
  SELECT file_key, CAST(i + 2 AS BIGINT) AS seq, CASE WHEN spent <= 200 THEN text ELSE '... [truncated at 200 tokens; use a narrower range]' END AS text FROM r WHERE spent - cost <= 200
  UNION ALL SELECT file_key, 1, 'File: ' || path FROM hd WHERE last >= 2
  UNION ALL SELECT file_key, 2, 'Lines 2-' || last || ' of ' || n FROM hd WHERE last >= 2
  UNION ALL SELECT file_key, 3, '' FROM hd WHERE last >= 2
  UNION ALL SELECT file_key, 1, '[error] end_line (' || last || ') < start_line (2)' FROM hd WHERE last < 2""".replace("\n  , f AS", ",\nf AS", 1))
_REFS = r"""
fr AS (SELECT * FROM (SELECT log_id, line_no, line, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS seq
   FROM log_lines WHERE regexp_matches(line, '\b@word\b'))),
bands AS (SELECT log_id, seq, line_no AS hit, greatest(1, line_no - 2) AS a, line_no + 2 AS z, lag(line_no + 2) OVER (PARTITION BY log_id ORDER BY seq) AS pz FROM fr)
"""
WORD = "and"
ORACLE["find_references"] = _with("log_lines", _REFS.replace("@word", WORD), select="""
  SELECT log_id, line_no, line, seq, count(*) OVER (PARTITION BY log_id) AS total, false AS capped FROM fr""")
ORACLE["reference_context"] = _with("log_lines", _REFS.replace("@word", WORD), select="""
  SELECT l.log_id, seq, l.line_no, 1 AS part, CASE WHEN l.line_no = hit THEN '► ' ELSE '  ' END || l.line_no || ': ' || line AS text
  FROM bands b JOIN log_lines l ON l.log_id = b.log_id AND l.line_no BETWEEN a AND z
  UNION ALL SELECT log_id, seq, a, 0, '---' FROM bands WHERE pz IS NULL OR a > pz + 1""")
ORACLE["head_tail"] = _with("log_lines", select="""
  SELECT log_id, line_no, CASE WHEN n <= 20 THEN line WHEN line_no <= 3 OR line_no > n - 3 THEN line_no || ': ' || line
    ELSE '... [' || (n - 6) || ' lines omitted] ...' END AS text
  FROM (SELECT *, count(*) OVER (PARTITION BY log_id) AS n FROM log_lines) WHERE n <= 20 OR line_no <= 4 OR line_no > n - 3""")

# --- source files -------------------------------------------------------------------------

_EXT = r"lower(regexp_extract(path, '(\.[^.]*)$', 1))"
_LANG = f"""CASE WHEN {_EXT} IN ('.kt', '.kts') THEN 'kotlin' WHEN {_EXT} = '.java' THEN 'java' WHEN {_EXT} IN ('.ts', '.tsx') THEN 'typescript'
  WHEN {_EXT} IN ('.js', '.mjs', '.cjs', '.jsx') THEN 'javascript' WHEN {_EXT} IN ('.py', '.pyi') THEN 'python'
  WHEN {_EXT} = '.go' THEN 'go' WHEN {_EXT} = '.rs' THEN 'rust' END"""
_FILES = rf"""
lf AS (SELECT *, {_LANG} AS language FROM source_files),
sf AS (SELECT *, coalesce(CASE language WHEN 'kotlin' THEN 'kt' WHEN 'typescript' THEN 'ts' WHEN 'javascript' THEN 'js' WHEN 'python' THEN 'py'
    WHEN 'rust' THEN 'rs' ELSE language END, 'txt') || '_' || substr(sha256(path || chr(0) || mtime_ms || chr(0) || size_bytes), 1, 12) AS file_id,
   CAST(len(string_split(source_text, chr(10))) AS BIGINT) AS line_count, (length(source_text) + 3) // 4 AS token_estimate FROM lf)
"""
ORACLE["source_profile"] = _with("source_files", _FILES, select="SELECT file_key, path, mtime_ms, size_bytes, file_id, language, line_count, token_estimate FROM sf")
ORACLE["language_counts"] = _with("source_files", _FILES, select="SELECT language, count(*) AS files FROM lf GROUP BY language")
ORACLE["file_ids"] = _with("source_files", _FILES, select="SELECT file_key, file_id FROM sf")
ORACLE["changed_files"] = _with("source_files", _FILES, select="SELECT file_key, file_id FROM sf WHERE file_key % 3 = 0 OR file_key % 7 = 0")
ORACLE["read_mode"] = _with("source_files", _FILES, select="""
  SELECT file_key, CASE WHEN language IS NULL THEN CASE WHEN mode <> 'outline' THEN 'full' ELSE 'error' END
    WHEN mode = 'full' THEN 'full' WHEN line_count <= 300 AND token_estimate <= 1500 AND focus IS NULL THEN 'full'
    WHEN focus IS NOT NULL AND focus_hits > 0 THEN 'focused' WHEN focus IS NOT NULL THEN 'outline_note' ELSE 'outline' END AS returned
  FROM (SELECT *, CASE file_key % 3 WHEN 0 THEN 'outline' WHEN 1 THEN 'full' ELSE 'auto' END AS mode,
      CASE WHEN file_key % 2 = 0 THEN 'x' END AS focus, file_key % 4 AS focus_hits FROM sf)""")

# --- symbols ------------------------------------------------------------------------------

_SYM = """
sd AS (SELECT *, CAST(len(string_split(qualified_name, '.')) - 1 AS BIGINT) AS depth FROM symbols),
sp AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_lo, line_hi DESC, depth, qualified_name) AS seq,
   CASE kind WHEN 'function' THEN 'fun' WHEN 'type_alias' THEN 'type' ELSE kind END AS label, '[L' || line_lo || '-L' || line_hi || ']' AS range FROM sd)
"""


def _sym(select: str, *ctes: str, views: str = "symbols") -> str:
    return _with(views, _SYM, *ctes, select=select)


ORACLE["symbol_store"] = _with("symbols", select="SELECT file_id, name, qualified_name, parent_qualified_name, kind, line_lo, line_hi, CASE WHEN line_lo % 3 = 0 THEN '' ELSE 'open ' || kind END AS modifiers, CASE WHEN line_lo % 2 = 0 THEN '/** ' || chr(34) || name || chr(34) || chr(10) || ' */' END AS doc FROM symbols")
ORACLE["flatten_symbols"] = _sym("SELECT file_id, seq, depth, qualified_name, kind, line_lo, line_hi FROM sp")
ORACLE["symbol_paths"] = _sym("SELECT file_id, qualified_name AS path, depth FROM sp")
ORACLE["list_symbols"] = _sym("""
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS seq, count(*) OVER (PARTITION BY file_id) AS listed,
    repeat('  ', depth) || label || ' ' || qualified_name || ' ' || range AS text FROM sp WHERE kind IN ('class', 'field')""")
_REQ = """
rq AS (SELECT c_custkey % 5 AS file_id, c_name AS requested FROM customer UNION SELECT n_nationkey % 5, n_name FROM nation
   UNION SELECT n_regionkey, r_name || '.' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_regionkey, r_name FROM region)
"""
ORACLE["read_symbols"] = _sym("""
  SELECT s.file_id, requested, kind || ' ' || qualified_name || ' ' || range AS header, '// inside ' || parent_qualified_name AS note
  FROM sp s JOIN rq ON rq.file_id = s.file_id AND (requested = qualified_name OR requested = name)""", _REQ)
ORACLE["symbols_not_found"] = _sym("""
  SELECT file_id, requested, '[error] symbol not found: ' || requested AS error FROM rq WHERE NOT EXISTS (
    SELECT 1 FROM sp s WHERE rq.file_id = s.file_id AND (requested = qualified_name OR requested = name))""", _REQ)
FOCI = ["NATION_2", "00[12]$|_7"]
ORACLE["match_focus"] = _sym("\nUNION ALL\n".join(f"""
  SELECT file_id, qualified_name, '{f}' AS focus, exact FROM (SELECT *, bool_or(exact) OVER (PARTITION BY file_id) AS any_exact FROM (
    SELECT *, name = '{f}' OR qualified_name = '{f}' AS exact, regexp_matches(name, '(?i){f}') OR regexp_matches(qualified_name, '(?i){f}') AS loose FROM sp))
  WHERE exact OR (loose AND NOT any_exact)""" for f in FOCI))
ORACLE["enclosing_symbol"] = _sym("""
  SELECT h.file_id, h.line_no, (SELECT arg_min(qualified_name, (line_hi - line_lo) * 1000000 + seq) FROM sp s
    WHERE s.file_id = h.file_id AND h.line_no BETWEEN line_lo AND line_hi) AS qualified_name FROM ident_hits h""", views="symbols ident_hits")
_OUTLINE = """
ol AS (SELECT file_id, seq, CASE WHEN seq > 73 THEN '... (outline truncated; use list_symbols for full tree)' ELSE
    CASE WHEN depth = 0 THEN '' ELSE repeat('  ', depth - 1) || '├─ ' END || label || ' ' || name || ' ' || range END AS text FROM sp WHERE seq <= 74)
"""
ORACLE["outline"] = _sym("SELECT file_id, seq, text FROM ol", _OUTLINE)
ORACLE["outline_reduction"] = _sym("""
  SELECT o.file_id, returned_tokens, full_tokens, floor((full_tokens - returned_tokens) / full_tokens * 1000 + 0.5) / 10 AS reduction_pct
  FROM (SELECT file_id, CAST((sum(length(text)) + count(*) - 1 + 3) // 4 AS BIGINT) AS returned_tokens FROM ol GROUP BY file_id) o
  JOIN (SELECT file_key, (length(source_text) + 3) // 4 AS full_tokens FROM source_files) f ON f.file_key = o.file_id""", _OUTLINE, views="symbols source_files")
ORACLE["pack_focus"] = _sym("""
  SELECT file_id, seq, qualified_name, oversized, CAST(spent + 300 AS BIGINT) AS spent FROM (
    SELECT *, min(CASE WHEN NOT oversized AND spent + 300 > 800 THEN seq END) OVER (PARTITION BY file_id) AS brk FROM (
      SELECT *, sum(CASE WHEN oversized THEN 10 ELSE cost END) OVER (PARTITION BY file_id ORDER BY seq) AS spent FROM (
        SELECT *, line_hi - line_lo + 1 AS cost, line_hi - line_lo + 1 > 400 AS oversized FROM sp)))
  WHERE brk IS NULL OR seq < brk""")
ORACLE["structural_outline"] = _sym("""
  SELECT file_id, qualified_name, line_lo, 1 AS seq, label || ' ' || qualified_name || ' ' || range AS text FROM sp
  UNION ALL SELECT file_id, qualified_name, line_lo, 2, '' FROM sp
  UNION ALL SELECT file_id, qualified_name, line_lo, 3, 'Body outline (' || (line_hi - line_lo + 1) || ' lines, too large to inline):' FROM sp
  UNION ALL SELECT file_id, qualified_name, line_lo, 4, '- (no nested symbols; use read_lines to zoom in)' FROM pn WHERE n = 0
  UNION ALL SELECT p.file_id, p.qualified_name, p.line_lo, 3 + row_number() OVER (PARTITION BY p.file_id, p.qualified_name ORDER BY c.seq),
    '- ' || c.range || ' ' || c.label || ' ' || c.name FROM sp p JOIN sp c ON c.file_id = p.file_id AND c.parent_qualified_name = p.qualified_name
  UNION ALL SELECT file_id, qualified_name, line_lo, greatest(n, 1) + 4, '' FROM pn
  UNION ALL SELECT file_id, qualified_name, line_lo, greatest(n, 1) + 5, 'Use read_lines(path, start, end) to fetch a specific range.' FROM pn""", """
pn AS (SELECT p.file_id, p.qualified_name, p.line_lo, count(c.seq) AS n FROM sp p LEFT JOIN sp c
   ON c.file_id = p.file_id AND c.parent_qualified_name = p.qualified_name GROUP BY ALL)""")
ORACLE["focused_missing"] = _sym("""
  SELECT file_id, qualified_name, '  ' || label || ' ' || qualified_name || ' ' || range || '   ← focused' AS text
  FROM sp WHERE kind = 'field' AND seq > 193""")

# --- declarations: what the source texts hold, by document and line -----------------------

_CLASS = [
    ("kotlin", 5, "class", "data", "data class Doc{n}(val size: Int, private val tag: String)"), ("java", 3, "class", "public", "public class Doc{n}"),
    ("typescript", 2, "class", "export", "export class Doc{n}"), ("javascript", 2, "class", "export", "export class Doc{n}"),
    ("python", 2, "class", "", "class Doc{n}:"), ("rust", 3, "class", "", "impl Doc{n}")]
# Language, part, line there (in a body: number modulo 3, plus 1), kind, name, inside the class, modifiers, text, signature.
_MEMBERS = [
    ("kotlin", "head", 5, "field", "size", 1, "", "val size: Int", "val size: Int"),
    ("kotlin", "head", 6, "field", "tag", 1, "private", "private val tag: String", "private val tag: String"),
    ("kotlin", "body", 2, "field", "t{i}", 1, "", 'val t{i} = "{q}"', 'val t{i} = "{q}"'),
    ("kotlin", "body", 3, "method", "f{i}", 1, "private", "private fun f{i}(x: Int): Int { return x }", "private fun f{i}(x: Int): Int"),
    ("kotlin", "foot", 2, "function", "a{n}", 0, "", "fun a{n}() = 1", "fun a{n}() = 1"),
    ("kotlin", "foot", 2, "function", "b{n}", 0, "", "fun b{n}() = 2", "fun b{n}() = 2"),
    ("java", "body", 2, "field", "t{i}", 1, "private static", 'private static String t{i} = "{q}";', 'private static String t{i} = "{q}"'),
    ("java", "body", 3, "method", "f{i}", 1, "public", "public int f{i}(int x) { return x; }", "public int f{i}(int x)"),
    ("typescript", "body", 2, "field", "t{i}", 1, "static", 'static t{i}: string = "{q}";', 'static t{i}: string = "{q}"'),
    ("typescript", "body", 3, "method", "f{i}", 1, "", "f{i}(x: number): number { return x; }", "f{i}(x: number): number"),
    ("typescript", "foot", 2, "const", "c{n}", 0, "export", "export const c{n} = 1;", "export const c{n} = 1"),
    ("typescript", "foot", 2, "type_alias", "A{n}", 0, "export", "export type A{n} = string;", "export type A{n} = string"),
    ("javascript", "body", 2, "field", "t{i}", 1, "", 't{i} = "{q}";', 't{i} = "{q}"'),
    ("javascript", "body", 3, "method", "f{i}", 1, "async", "async f{i}(x) { return x; }", "async f{i}(x)"),
    ("javascript", "foot", 2, "const", "c{n}", 0, "", "const c{n} = `\nclass Hidden { (`;", "const c{n} = ` class Hidden { (`"),
    ("python", "body", 3, "method", "f{i}", 1, "", "def f{i}(self): return 1  # {x}", "def f{i}(self): return 1"),
    ("python", "foot", 1, "function", "a{n}", 0, "", "def a{n}(x,\n       y): pass", "def a{n}(x, y): pass"),
    ("go", "head", 2, "type_alias", "Doc{n}", 0, "", "type Doc{n} struct {\n\tn int\n}", "type Doc{n} struct"),
    ("go", "body", 2, "method", "T{i}", 0, "", 'func (d *Doc{n}) T{i}() string { return "{q}" }', "func (d *Doc{n}) T{i}() string"),
    ("go", "body", 3, "function", "f{i}", 0, "", "func f{i}(x int) int { return x }", "func f{i}(x int) int"),
    ("go", "foot", 1, "function", "z{n}", 0, "", "func z{n}() {\n}", "func z{n}()"),
    ("go", "open", 1, "function", "z{n}", 0, "", "func z{n}() {", "func z{n}()"),
    ("rust", "head", 2, "struct", "Doc{n}", 0, "pub", "pub struct Doc{n} { n: u8 }", "pub struct Doc{n}"),
    ("rust", "body", 2, "const", "T{i}", 1, "", 'const T{i}: &str = "{q}";', 'const T{i}: &str = "{q}"'),
    ("rust", "body", 3, "method", "f{i}", 1, "pub", "pub fn f{i}(&self) -> u8 { 1 }", "pub fn f{i}(&self) -> u8")]


def _values(rows: list[tuple]) -> str:
    return ",\n ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in r) + ")" for r in rows)


def _filled(c: str) -> str:
    return (f"replace(replace(replace(replace({c}, '{{n}}', CAST(file_id AS VARCHAR)), '{{i}}', CAST(i AS VARCHAR)), "
            "'{q}', replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')), '{x}', x)")


_HEADS = ", ".join(f"('{k}', {len(v['head'])})" for k, v in CODE_TEXT.items() if k)
_DECLS = f"""
heads(language, heads) AS (VALUES {_HEADS}),
lat AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no) - length(line) - 1 AS char0 FROM code_lines WHERE language IS NOT NULL),
cd AS (SELECT * FROM code_docs JOIN heads USING (language)),
members(language, part, k, kind, name, nested, modifiers, text, signature) AS (VALUES {_values(_MEMBERS)}),
classes(language, k, kind, modifiers, signature) AS (VALUES {_values(_CLASS)}),
mem AS (
  SELECT d.file_id, d.language, k AS line_no, 0 AS i, '' AS x, m.* EXCLUDE (language) FROM cd d JOIN members m ON m.language = d.language AND part = 'head'
  UNION ALL SELECT d.file_id, d.language, heads + u.i, u.i, texts[u.i], m.* EXCLUDE (language) FROM cd d, unnest(range(1, n + 1)) AS u(i)
    JOIN members m ON m.language = d.language AND part = 'body' AND k = u.i % 3 + 1
  UNION ALL SELECT d.file_id, d.language, heads + n + k, 0, '', m.* EXCLUDE (language) FROM cd d JOIN members m ON m.language = d.language AND part = ending),
filled AS (SELECT * EXCLUDE (name, text, signature), {_filled('name')} AS name, {_filled('text')} AS text, {_filled('signature')} AS signature FROM mem),
sized AS (SELECT f.*, char0 + strpos(line, string_split(text, chr(10))[1]) - 1 AS char_lo FROM filled f JOIN lat USING (file_id, line_no)),
ending AS (
  SELECT file_id, d.language, k AS line_no, c.kind, c.modifiers, replace(signature, '{{n}}', CAST(file_id AS VARCHAR)) AS signature,
    CASE WHEN d.language = 'python' THEN heads + coalesce(list_max(list_filter(range(1, n + 1), lambda i: i % 3 <> 0)), 0) WHEN ending = 'open' THEN heads + n ELSE heads + n + 1 END AS line_hi,
    ending = 'open' OR d.language = 'python' AS whole
  FROM cd d JOIN classes c ON c.language = d.language)
"""
_SYMBOLS = r"""
  SELECT file_id, s.language, name, CASE WHEN nested = 1 THEN 'Doc' || file_id || '.' || name ELSE name END AS qualified_name,
    CASE WHEN nested = 1 THEN 'Doc' || file_id END AS parent_qualified_name, kind, modifiers, trim(regexp_replace(signature, '\s+', ' ', 'g')) AS signature,
    CAST(line_no AS BIGINT) AS line_lo, CAST(line_no + len(string_split(text, chr(10))) - 1 AS BIGINT) AS line_hi, CAST(char_lo AS BIGINT) AS char_lo,
    CAST(char_lo + length(rtrim(text)) AS BIGINT) AS char_hi FROM sized s
  UNION ALL SELECT e.file_id, e.language, 'Doc' || e.file_id, 'Doc' || e.file_id, NULL, kind, modifiers, signature, CAST(e.line_no AS BIGINT), CAST(line_hi AS BIGINT),
    CAST(a.char0 AS BIGINT), CAST(z.char0 + CASE WHEN whole THEN length(rtrim(z.line)) ELSE 1 END AS BIGINT)
  FROM ending e JOIN lat a ON a.file_id = e.file_id AND a.line_no = e.line_no JOIN lat z ON z.file_id = e.file_id AND z.line_no = e.line_hi"""
_CODE = "code_docs code_lines"
ORACLE["lexical_symbols"] = _with(_CODE, _DECLS, select=_SYMBOLS)
# Above the class its first lines, without annotations; above a member of number 1 modulo 3, and above
# the last function, the line before, which is a comment.
_DOCS = f"""
  SELECT a.file_id, CAST(a.line_no AS BIGINT) AS line_no, {_trim('b.line')} AS doc FROM (
      SELECT file_id, language, heads + u.i AS line_no FROM cd, unnest(range(4, n + 1, 3)) AS u(i) WHERE language <> 'python'
      UNION ALL SELECT file_id, language, heads + n + 1 FROM cd WHERE n % 3 = 0 AND (language = 'go' OR language = 'python' AND ending = 'foot')) a
    JOIN lat b ON b.file_id = a.file_id AND b.line_no = a.line_no - 1
  UNION ALL SELECT file_id, CASE language WHEN 'kotlin' THEN 5 WHEN 'java' THEN 3 ELSE 2 END,
    (SELECT string_agg(line, chr(10) ORDER BY line_no) FROM lat WHERE lat.file_id = cd.file_id AND lat.line_no <= CASE cd.language WHEN 'kotlin' THEN 3 ELSE 1 END)
  FROM cd"""
ORACLE["leading_doc"] = _with(_CODE, _DECLS, select=_DOCS)
ORACLE["parse_status"] = _with("code_docs", select="""
  SELECT file_id, language, CASE WHEN language IS NULL THEN 'failed' WHEN extra OR ending = 'open' THEN 'partial' ELSE 'ok' END AS status,
    CAST(CASE WHEN language IS NULL OR ending = 'open' THEN 1 WHEN extra THEN 2 ELSE 0 END AS BIGINT) AS errors FROM code_docs""")
ORACLE["parse_errors"] = _with("bracket_lines", r"""
br AS (SELECT file_id, line_no, u.k AS k, substr(line, u.k, 1) AS c FROM bracket_lines, unnest(range(1, length(line) + 1)) AS u(k) WHERE contains('()[]{}', substr(line, u.k, 1))),
bd AS (SELECT *, CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END AS delta,
    sum(CASE WHEN c IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY line_no, k) AS depth FROM br),
bl AS (SELECT *, CASE WHEN delta = 1 THEN c || coalesce(lead(c) OVER w, '') ELSE coalesce(lag(c) OVER w, '') || c END AS pair
    FROM (SELECT *, least(depth, depth - delta) AS level FROM bd) WINDOW w AS (PARTITION BY file_id, level ORDER BY line_no, k))
""", select="SELECT file_id, line_no, c AS sign, 'ERROR at line ' || line_no AS error FROM bl WHERE pair NOT IN ('()', '[]', '{}')")

_RANGE = """sy AS (SELECT *, CASE kind WHEN 'function' THEN 'fun' WHEN 'type_alias' THEN 'type' ELSE kind END AS label, '[L' || line_lo || '-L' || line_hi || ']' AS range FROM ({symbols}))"""
ORACLE["symbol_bodies"] = _with(_CODE, _DECLS, _RANGE.replace("{symbols}", _SYMBOLS), f"""
dc AS ({_DOCS}),
tx AS (SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM code_lines GROUP BY file_id),
rq AS (SELECT doc_id AS file_id, unnest(['Doc' || doc_id, 'f2', 'Doc' || doc_id || '.t1', 'Doc' || doc_id || '.T4', 'nowhere']) AS requested FROM documents),
hit AS (SELECT rq.file_id, requested, s.* EXCLUDE (file_id), rq.file_id IS NOT NULL AND s.file_id IS NOT NULL AS there
  FROM rq LEFT JOIN sy s ON s.file_id = rq.file_id AND (requested = qualified_name OR requested = name))
""", select="""
  SELECT h.file_id, requested, qualified_name, line_lo, kind || ' ' || qualified_name || ' ' || range AS header, '// inside ' || parent_qualified_name AS note,
    CASE WHEN char_lo = (SELECT min(char_lo) FROM sy WHERE sy.file_id = h.file_id AND sy.line_lo = h.line_lo) THEN doc END AS doc,
    CASE WHEN there THEN substr(tx.text, char_lo + 1, char_hi - char_lo) END AS body,
    CASE WHEN NOT there THEN '[error] symbol not found: ' || requested END AS error
  FROM hit h LEFT JOIN dc ON dc.file_id = h.file_id AND dc.line_no = h.line_lo LEFT JOIN tx ON tx.file_id = h.file_id""")
ORACLE["reference_lists"] = _with(_CODE, _DECLS, _RANGE.replace("{symbols}", _SYMBOLS), r"""
ri AS (SELECT doc_id AS file_id, '/src/' || doc_id AS path, unnest(['Doc' || doc_id, 'f2(x', 'f2', '=', 'and', 'nowhere']) AS identifier FROM documents),
rh AS (SELECT * FROM (SELECT ri.*, c.line_no, row_number() OVER (PARTITION BY ri.file_id, identifier ORDER BY c.line_no) AS seq
   FROM ri JOIN code_lines c ON c.file_id = ri.file_id AND contains(c.line, identifier) AND regexp_matches(c.line, '\b' || regexp_escape(identifier) || '\b')) WHERE seq <= 20),
rb AS (SELECT *, greatest(1, line_no - 2) AS a, line_no + 2 AS z, lag(line_no + 2) OVER (PARTITION BY file_id, identifier ORDER BY seq) AS pz,
   (SELECT arg_min(qualified_name, (line_hi - line_lo) * 1000000000 + line_lo) FROM sy WHERE sy.file_id = rh.file_id AND rh.line_no BETWEEN line_lo AND line_hi) AS around FROM rh),
rn AS (SELECT ri.*, (SELECT count(*) FROM rh WHERE rh.file_id = ri.file_id AND rh.identifier = ri.identifier) AS n FROM ri)
""", select="""
  SELECT file_id, identifier, 0 AS ord, CASE WHEN n = 0 THEN '[' || identifier || '] 0 matches in ' || path ELSE 'File: ' || path END AS text FROM rn
  UNION ALL SELECT file_id, identifier, 1, 'Identifier: ' || identifier FROM rn WHERE n > 0
  UNION ALL SELECT file_id, identifier, 2, n || CASE WHEN n = 1 THEN ' match' ELSE ' matches' END || CASE WHEN n = 20 THEN ' (capped)' ELSE '' END FROM rn WHERE n > 0
  UNION ALL SELECT file_id, identifier, 3, '' FROM rn WHERE n > 0
  UNION ALL SELECT file_id, identifier, seq * 4096 + 1, '---' FROM rb WHERE pz IS NULL OR a > pz + 1
  UNION ALL SELECT b.file_id, identifier, seq * 4096 + 2 + c.line_no - a, CASE WHEN c.line_no = b.line_no THEN '► ' ELSE '  ' END || c.line_no || ': ' || c.line
    FROM rb b JOIN code_lines c ON c.file_id = b.file_id AND c.line_no BETWEEN a AND z
  UNION ALL SELECT file_id, identifier, seq * 4096 + 4095, '  (inside ' || around || ')' FROM rb WHERE around IS NOT NULL""")

# --- streams ------------------------------------------------------------------------------

ORACLE["stream_facts"] = ORACLE["kotlin_diagnostics"]
ORACLE["stream_warning_counts"] = """
  SELECT date_trunc('hour', ts) AS hour, message, count(*) AS n FROM (
    SELECT ts, CASE WHEN event_type = 'click' THEN 'Parameter p' || (event_id % 17) || ' is never used'
      WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN 'unchecked call ' || (event_id % 3) END AS message FROM events)
  WHERE message IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
  GROUP BY 1, 2"""

ORACLE["stream_kinds"] = ORACLE["classify"]
ORACLE["stream_fact_tables"] = "\nUNION ALL\n".join(
    f"SELECT '{fact}' AS fact, '{kind}:' || log_id AS log_id, line_no, {c} AS text FROM ({sql})" for fact, kind, c, sql in (
        ("kotlin_diagnostics", "gradle", "message", ORACLE["kotlin_diagnostics"]), ("javac_diagnostics", "gradle", "message", ORACLE["javac_diagnostics"]),
        ("npm_changes", "npm", "text", ORACLE["npm_changes"]), ("junit_results", "junit", "test", ORACLE["junit_results"]),
        *[("clean_lines", kind, r"regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')", CARRIER_SQL[view])
          for kind, view in (("gradle", "build_lines"), ("npm", "npm_lines"), ("junit", "junit_lines"))]))
