"""Carriers: the given tables in the shape of logs, projects and symbol tables.

Same rows as ``carrier_sql.py``, built so that no log is numbered in a single task: positions
come from :func:`gistline.operators.scan.scan`, never from a window over a whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gistline.operators.scan import scan
from gistline.plans.carrier_sql import CODE_LANGUAGES, CODE_TEXT
from gistline.sources.staging import stage

_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
               "l_shipdate", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(line_no: Column, line: Column | str) -> Column:
    line = F.lit(line) if isinstance(line, str) else line
    return F.struct(line_no.cast("bigint").alias("line_no"), line.alias("line"))


def _rows(df: DataFrame, *rows: tuple[Column | None, Column]) -> DataFrame:
    """One output line per (condition, row); a null condition means always."""
    items = [r if cond is None else F.when(cond, r) for cond, r in rows]
    return df.select("log_id", F.inline(F.array_compact(F.array(*items))))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gistline.sources.logs import explode_lines

    return explode_lines(table(spark, sf_dir, "documents"), "text", id_col="doc_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS log_id",
        """CASE o_orderkey % 12 WHEN 0 THEN './gradlew assembleDebug' WHEN 1 THEN './gradlew :app:testDebugUnitTest'
           WHEN 2 THEN 'pytest tests/' WHEN 3 THEN 'npx jest' WHEN 4 THEN 'vitest run' WHEN 5 THEN 'npm install'
           WHEN 6 THEN 'pnpm i' WHEN 7 THEN 'make all' WHEN 8 THEN 'python -m x' WHEN 9 THEN 'some-runner'
           WHEN 10 THEN 'ci.sh' ELSE 'echo hello' END AS command""",
        """CASE o_orderkey % 12 WHEN 7 THEN 'ok' || chr(10) || 'BUILD SUCCESSFUL in 2s'
           WHEN 8 THEN '===== test session starts =====' WHEN 9 THEN 'com.foo.BarTest > testBaz PASSED'
           WHEN 10 THEN 'PASS src/a.ts' || chr(10) || 'Tests: 1 passed' ELSE o_orderpriority END AS head""",
        "CASE WHEN o_orderkey % 97 = 0 THEN 124 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS exit_code",
        "o_orderkey % 97 = 0 AS timed_out",
        "CAST(floor(o_totalprice) AS BIGINT) AS duration_ms",
        "o_orderdate AS ended_at",
    )


def _build_events(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), "event_id", "event_type", *extra)
    return scan(events, running={"n": F.lit(1)}, total={"m": F.lit(1)}, pos="event_id", late=True)


def _build_text() -> Column:
    e = lambda k: _s(F.col("event_id") % k)
    e1 = lambda k: _s(F.col("event_id") % k + 1)
    kind = F.col("event_type")
    return (
        F.when((kind == "error") & (F.col("log_id") % 3 != 0),
               _cat("e: file:///src/mod", e(4), "/File", e(13), ".kt:", e1(400), ":", e1(80),
                    " Unresolved reference: sym", e(7)))
        .when(kind == "click",
              _cat("w: /src/File", e(13), ".kt:", e1(400), " Parameter p", e(17), " is never used"))
        .when(kind == "purchase",
              _cat("/src/Foo", e(11), ".java:", e1(300),
                   F.when(F.col("event_id") % 5 == 0, ": error: ").otherwise(": warning: "), "unchecked call ", e(3)))
        .when(kind == "signup",
              _cat("> Task :app:t", e(30),
                   F.when(F.col("event_id") % 9 == 0, " FAILED").when(F.col("event_id") % 9 == 1, "")
                   .when(F.col("event_id") % 9 == 2, " NO-SOURCE").otherwise(" UP-TO-DATE")))
        .otherwise(_cat("Download https://repo.example.com/a", e(50), ".pom"))
    )


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m, log = F.col("n"), F.col("m"), F.col("log_id")
    end, bad = n == m, (n == m) & (log % 3 != 0)
    return _rows(
        _build_events(spark, sf_dir),
        (None, _row(n, _build_text())),
        (bad, _row(m + 1, "FAILURE: Build failed with an exception.")),
        (bad, _row(m + 2, "* What went wrong:")),
        (bad, _row(m + 3, _cat("Execution failed for task :app:t", _s(log % 30), "."))),
        (bad, _row(m + 4, "* Try:")),
        (end, _row(m + 5, _cat("BUILD ", F.when(log % 3 != 0, "FAILED").otherwise("SUCCESSFUL"), " in ",
                               _s(log % 60), "s"))),
    )


def timed_build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of the builds with their time, without the closing lines."""
    events = _build_events(spark, sf_dir, "ts")
    return events.select("log_id", F.col("n").alias("line_no"), "ts", _build_text().alias("line"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each supplier, numbered; the same for all logs, so that a plan with several deals them once."""
    items = table(spark, sf_dir, "lineitem").select(*_LINE_ORDER, "l_suppkey", "l_returnflag", "l_linestatus")
    numbered = scan(items.withColumnRenamed("l_suppkey", "log_id"), order=_LINE_ORDER, bucket=F.expr("l_orderkey div 65536"),
                    running={"n": F.lit(1), "failures": (F.col("l_returnflag") == "R").cast("int")}, late=True)
    return numbered.select("log_id", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "n", "failures")


def npm_lines(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    p = lambda k: _s(F.col("l_partkey") % k)
    no = F.col("l_linenumber")
    line = (
        F.when(no == 1, _cat("npm warn deprecated @s/pkg", p(23), "@", p(5), ".0.0: no longer supported since v", p(23)))
        .when(no == 2, _cat("npm warn peer dep x", p(12)))
        .when(no == 3, F.when(F.col("log_id") % 4 == 0, _cat("npm error code E", p(9))).otherwise("idealTree timing"))
        .when(no == 4, _cat("   from the root project r", p(6)))
        .when(no == 5, "")
        .when(no == 6, _cat("added ", _s("l_partkey"), " packages in 3s"))
        .otherwise(_cat(p(20), " vulnerabilities (1 low)"))
    )
    items = _items(spark, sf_dir) if items is None else items
    return items.select("log_id", F.col("n").alias("line_no"), line.alias("line"))


def junit_lines(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    failed = F.col("l_returnflag") == "R"
    items = _items(spark, sf_dir) if items is None else items
    at = F.col("n") + 4 * (F.col("failures") - failed.cast("int"))
    part = F.col("l_partkey")
    status = F.when(failed, " FAILED").when(F.col("l_returnflag") == "A", " PASSED").otherwise(" SKIPPED")
    return _rows(
        items,
        (None, _row(at, _cat("com.ex.Supp", _s("log_id"), "Test > part", _s(part), status))),
        (failed, _row(at + 1, _cat("    java.lang.AssertionError: part ", _s(part % 31)))),
        (failed, _row(at + 2, "        at org.junit.Assert.fail(Assert.java:89)")),
        (failed, _row(at + 3, _cat("        at com.ex.Part.check(Part.kt:", _s(part % 200), ")"))),
        (failed, _row(at + 4, "")),
    )


def generic_lines(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    rest = F.col("l_partkey") % 50
    line = (
        F.when(rest == 0, _cat("Error: cannot load part ", _s("l_partkey")))
        .when(rest == 1, "NullPointerException in errors module")
        .when(rest == 2, _cat("FATAL: step ", _s("l_linenumber"), " failed"))
        .otherwise(_cat("status ", F.col("l_returnflag"), " ", F.col("l_linestatus")))
    )
    items = _items(spark, sf_dir) if items is None else items
    return items.select("log_id", F.col("n").alias("line_no"), line.alias("line"))


def _test_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("log_id"), F.col("o_orderkey").alias("ok"),
        F.col("o_orderstatus").alias("st"), F.col("o_custkey").alias("ck"))


def pytest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f_row, p_row = (F.col("st") == "F").cast("int"), (F.col("st") == "P").cast("int")
    o = scan(_test_orders(spark, sf_dir), pos="ok", late=True,
             running={"i": F.lit(1), "fi": f_row, "pi": p_row}, total={"c": F.lit(1), "f": f_row, "p": p_row})
    log, ok, c, f = F.col("log_id"), F.col("ok"), F.col("c"), F.col("f")
    even, five = log % 2 == 0, log % 5 != 0
    head = five & (f > 0)
    num = lambda cond: cond.cast("bigint")
    o4 = 2 + c + num(even)
    o5 = o4 + F.when(even, F.col("p")).otherwise(0)
    o6 = o5 + num(head)
    o7 = o6 + F.when(five, f).otherwise(0)
    o8 = o7 + num(five)
    o9 = o8 + F.when(five, f).otherwise(0)
    last = F.col("i") == c
    failed, pending = F.col("st") == "F", F.col("st") == "P"
    return _rows(
        o,
        (last, _row(F.lit(1), "===== test session starts =====")),
        (last, _row(F.lit(2), _cat("platform linux -- Python 3.", _s(log % 14)))),
        (None, _row(2 + F.col("i"), _cat("tests/test_", _s("ck"), ".py ..F [ 10%]"))),
        (last & even, _row(3 + c, "===== ERRORS =====")),
        (even & pending, _row(o4 + F.col("pi"), F.when(ok % 4 == 0, "")
                              .otherwise(_cat("E   ConnectionError: c", _s("ck"))))),
        (last & head, _row(o5 + 1, "===== FAILURES =====")),
        (five & failed, _row(o6 + F.col("fi"), F.when(ok % 3 == 0, "")
                             .otherwise(_cat("E   assert ", _s("ck"), " == ", _s(ok % 10))))),
        (last & five, _row(o7 + 1, "===== short test summary info =====")),
        (five & failed, _row(o8 + F.col("fi"), _cat("FAILED tests/test_", _s("ck"), ".py::t", _s(ok)))),
        (last, _row(o9 + 1, _cat("===== ", F.when(five, _cat(_s(f), " failed, ")).otherwise(""), _s(c - f),
                                 " passed in 4.2s ====="))),
    )


def jest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("st") == "F"
    ok = F.col("ok")
    details = ok % 25 + 1
    size = F.when(failed, 2 + details).otherwise(1)
    o = scan(_test_orders(spark, sf_dir), pos="ok", late=True, running={"i": F.lit(1), "done": size},
             total={"c": F.lit(1), "f": failed.cast("int"), "all": size})
    at = F.col("done") - size
    f, c, end = F.col("f"), F.col("c"), F.col("all")
    last = F.col("i") == c
    listed = (f > 0).cast("bigint")
    detail = F.transform(
        F.sequence(F.lit(0).cast("bigint"), details - 1),
        lambda k: _row(at + 3 + k, F.when(k % 6 == 0, "").otherwise(_cat("    Expected: ", _s(k)))))
    single = F.array_compact(F.array(
        _row(at + 1, _cat(F.when(failed, "FAIL  src/s").otherwise("PASS  src/s"), _s("ck"), ".test.ts (9ms)")),
        F.when(failed, _row(at + 2, _cat("  ● S", _s("ck"), " › case ", _s(ok)))),
        F.when(last & (f > 0), _row(end + 1, "Summary of all failing tests")),
        F.when(last, _row(end + listed + 1, _cat("Test Suites: ", _s(f), " failed, ", _s(c), " total"))),
        F.when(last, _row(end + listed + 2, _cat("Tests:       ", _s(f), " failed, ", _s(c), " total"))),
        F.when(last, _row(end + listed + 3, "Time:        5.2 s")),
    ))
    rows = F.when(failed, F.concat(single, detail)).otherwise(single)
    return o.select("log_id", F.inline(rows))


def lines_by_kind(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The logs of each kind. The items, which three of them have as lines, are numbered once and written."""
    items = stage(_items(spark, sf_dir))
    return {"gradle": build_lines(spark, sf_dir), "npm": npm_lines(spark, sf_dir, items), "jest": jest_lines(spark, sf_dir),
            "pytest": pytest_lines(spark, sf_dir), "junit": junit_lines(spark, sf_dir, items), "generic": generic_lines(spark, sf_dir, items)}


def ansi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    esc = F.lit("\u001b")
    event = F.col("event_id")
    raw = _cat(esc, "[", _s(30 + event % 8), "m", F.col("event_type"), esc, "[0m ",
               F.when(event % 4 == 0, _cat(esc, "[2K")).otherwise(""), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    package = (F.when(k % 2 == 0, '{"devDependencies":{"jest":"29"}}')
               .when(k % 5 == 1, '{"scripts":{"test":"vitest run"}}').otherwise('{"scripts":{"build":"tsc"}}'))
    files = [
        (k % 5 == 0, "gradlew", F.lit("")),
        (k % 9 == 0, "build.gradle.kts", F.lit("")),
        (k % 3 == 0, "package.json", package),
        (k % 7 == 0, "Cargo.toml", F.lit("")),
        (k % 2 == 0, "Makefile", F.lit("")),
        (k % 11 == 0, "go.mod", F.lit("")),
        (k % 13 == 0, "conftest.py", F.lit("")),
        (k % 4 == 1, "pyproject.toml", F.when(k % 8 == 1, "[tool.pytest.ini_options]").otherwise("[project]")),
    ]
    present = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(path).alias("path"), content.alias("content"))) for cond, path, content in files]))
    return table(spark, sf_dir, "supplier").select(k.alias("project_id"), F.inline(present))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # File endings by document number modulo 14.
    endings = [".kt", ".kts", ".java", ".ts", ".TSX", ".js", ".mjs", ".py", ".pyi", ".go", ".rs", ".md", ".jsx", ""]
    doc = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (doc % 14 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        doc.alias("file_key"), _cat("/src/", F.col("source"), "/F", _s(doc), ending).alias("path"),
        (F.lit(1700000000000) + doc * 60000).alias("mtime_ms"), F.col("n_chars").alias("size_bytes"),
        F.col("text").alias("source_text"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c = scan(customer, running={"rn": F.lit(1)}, key=["c_nationkey"], pos="c_custkey")
    region = table(spark, sf_dir, "region")
    counts = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("cnt"))
    upto = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nations = (
        table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left")
        .select("n_nationkey", "n_name", "n_regionkey", F.coalesce("cnt", F.lit(0)).alias("cnt"))
        .withColumn("hi_off", F.sum(5 * F.col("cnt") + 2).over(upto))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("base", F.col("hi_off") - (5 * F.col("cnt") + 2))
    )
    big = lambda e: e.cast("bigint")
    top = nations.groupBy("r_regionkey", "r_name").agg(F.max("hi_off").alias("m")).select(
        F.col("r_regionkey").alias("file_id"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified_name"),
        F.lit(None).cast("string").alias("parent_qualified_name"), F.lit("class").alias("kind"),
        big(F.lit(1)).alias("line_lo"), big(F.col("m") + 2).alias("line_hi"))
    path = _cat(F.col("r_name"), ".", F.col("n_name"))
    middle = nations.select(
        F.col("n_regionkey"), "n_name", path, "r_name", F.lit("class"),
        big(F.col("base") + 2), big(F.col("hi_off") + 1))
    lo = F.col("base") + 3 + 5 * (F.col("rn") - 1)
    leaf = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", "c_name", _cat(path, ".", F.col("c_name")), path,
        F.when(F.col("c_mktsegment") == "MACHINERY", "field").otherwise("method"), big(lo), big(lo + 4))
    return top.union(middle).union(leaf)


def ident_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 5).cast("int").alias("file_id"),
        (F.col("o_custkey") % 1600 + 1).alias("line_no")).distinct()


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files in 7 languages and one unknown, with a document's lines in comments, strings and bodies.

    Some files lack their last bracket, some have two too many.
    """
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        doc, F.split("text", "\n").alias("texts"), (doc % 8).cast("int").alias("place"),
        (doc % 7 == 3).alias("open"), ((doc % 5 == 0) & (doc % 7 != 3)).alias("extra"))

    def fixed(texts: list[str]) -> Column:
        line = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit("").alias("x"), F.lit("").alias("tmpl"))
        return F.array(*[F.struct(F.lit(0).cast("bigint").alias("i"), F.lit("").alias("x"), F.lit(t).alias("tmpl")) for t in texts]) if texts \
            else F.filter(F.array(line), lambda r: F.lit(False))

    def chosen(part) -> Column:
        out = F.lit(None)
        for k, language in enumerate(CODE_LANGUAGES):
            out = F.when(F.col("place") == k, part(CODE_TEXT[language])).otherwise(out)
        return out

    body = F.transform("texts", lambda x, i: F.struct((i + 1).cast("bigint").alias("i"), x.alias("x"), F.lit("").alias("tmpl")))
    rows = F.concat(
        chosen(lambda t: fixed(t["head"])), body, F.when(F.col("open"), chosen(lambda t: fixed(t["open"]))).otherwise(chosen(lambda t: fixed(t["foot"]))),
        F.when(F.col("extra"), fixed([") ]"])).otherwise(fixed([])))
    lines = docs.select("doc_id", "place", F.posexplode(rows).alias("p", "row")).select("doc_id", "place", "p", "row.*")
    tmpl = F.when(F.col("i") == 0, F.col("tmpl")).otherwise(F.element_at(
        chosen(lambda t: F.array(*[F.lit(b) for b in t["body"]])), (F.col("i") % 3 + 1).cast("int")))
    x, back = F.col("x"), F.lit("\\")
    fill = {"{n}": _s(doc), "{i}": _s("i"), "{y}": F.replace(x, F.lit("*/")),
            "{q}": F.replace(F.replace(x, back, F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "{x}": x}
    for sign, value in fill.items():
        tmpl = F.replace(tmpl, F.lit(sign), value)
    languages = F.array(*[F.lit(x) for x in CODE_LANGUAGES])
    return lines.select(
        doc.alias("file_id"), F.element_at(languages, F.col("place") + 1).alias("language"), (F.col("p") + 1).cast("bigint").alias("line_no"), tmpl.alias("line"))


def bracket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with some letters as brackets and without quotes, as files that seldom balance."""
    return log_lines(spark, sf_dir).select(
        F.col("log_id").alias("file_id"), F.lit("go").alias("language"), "line_no", F.translate("line", "tmbkvhwg\"'`/\\", "()[]{}[}").alias("line"))
