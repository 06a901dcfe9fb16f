"""Which tool a run belongs to, which tool a project uses, and dispatch to the distillers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as ST

from gistline.functions import patterns as P, text as T
from gistline.operators import generic, gradle, jest, junit, npm, pytest
from gistline.operators.digest import union

HEAD_CHARS = 1024


def head_of(c: Column | str, chars: int = HEAD_CHARS) -> Column:
    """The first characters of a log, all that classification reads."""
    return F.left(T.as_col(c), F.lit(chars))


def _says(c: Column, *words: str, flags: str = "") -> Column:
    return c.rlike(flags + P.word("|".join(words)))


def _has_status(head: Column) -> Column:
    """A cheap test before a pattern that backtracks on long words."""
    return head.contains("PASSED") | head.contains("FAILED") | head.contains("SKIPPED")


def classify(command: Column | str = "command", head: Column | str = "head") -> Column:
    cmd, head = F.lower(T.as_col(command)), T.as_col(head)
    return (
        F.when(_has_status(head) & head.rlike(P.HEAD_JUNIT), "junit")
        .when(_says(cmd, "gradle", "gradlew"), F.when(cmd.contains("test"), "junit").otherwise("gradle"))
        .when(_says(cmd, "pytest") | head.rlike(P.HEAD_PYTEST), "pytest")
        .when(_says(cmd, "jest", "vitest"), "jest")
        .when(head.rlike(P.HEAD_JEST_SUITE) & head.rlike(P.HEAD_JEST_TOTAL), "jest")
        .when(_says(cmd, "npm", "yarn", "pnpm") | head.rlike(P.HEAD_NPM), "npm")
        .when(head.rlike(P.HEAD_GRADLE), "gradle")
        .otherwise("generic")
    )


def can_handle(command: Column | str = "command", head: Column | str = "head") -> dict[str, Column]:
    """Looser predicates, one per distiller."""
    cmd, head = F.lower(T.as_col(command)), T.as_col(head)
    return {
        "gradle": _says(cmd, "gradle", "gradlew") | head.rlike(P.HEAD_GRADLE),
        "npm": _says(cmd, "npm", "yarn", "pnpm") | head.rlike(P.HEAD_NPM),
        "jest": _says(cmd, "jest", "vitest") | (head.rlike(P.HEAD_JEST_SUITE) & head.rlike(P.HEAD_JEST_TOTAL)),
        "pytest": _says(cmd, "pytest") | head.rlike(P.HEAD_PYTEST),
        "junit": (_says(cmd, "gradle", "gradlew") & cmd.rlike("(?<![A-Za-z0-9_])test")) | head.rlike(P.HEAD_JUNIT_LOOSE),
        "generic": F.lit(True),
    }


def detect_build_tool(project_files: DataFrame) -> DataFrame:
    """The build tool of each project; where none is found, ``error`` says so."""
    path = F.col("path")
    has = lambda *names: F.coalesce(F.bool_or(path.isin(*names)), F.lit(False))
    tool = (
        F.when(has("gradlew", "build.gradle", "build.gradle.kts"), "gradle")
        .when(has("package.json"), "npm").when(has("Cargo.toml"), "cargo").when(has("Makefile", "makefile"), "make"))
    return project_files.groupBy("project_id").agg(tool.alias("tool")).withColumn(
        "error", F.when(F.col("tool").isNull(), "[error] no build tool found"))


_MANIFEST = ST.StructType([
    ST.StructField(name, ST.MapType(ST.StringType(), ST.StringType()))
    for name in ("dependencies", "devDependencies", "scripts")])


def package_uses(manifest: Column, *names: str) -> Column:
    """Whether a package manifest depends on one of the names or runs it in a script; malformed means no."""
    m = F.from_json(manifest, _MANIFEST)
    keys = F.array_union(
        F.coalesce(F.map_keys(m["dependencies"]), F.array().cast("array<string>")),
        F.coalesce(F.map_keys(m["devDependencies"]), F.array().cast("array<string>")))
    scripts = F.coalesce(F.map_values(m["scripts"]), F.array().cast("array<string>"))
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names])) | F.exists(
        scripts, lambda s: F.coalesce(_says(s, *names), F.lit(False)))


def detect_test_framework(project_files: DataFrame) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    framework = (
        F.when(any_(path == "go.mod"), "go")
        .when(any_(path.isin("pytest.ini", "conftest.py")
                   | ((path == "pyproject.toml") & content.contains("[tool.pytest"))), "pytest")
        .when(any_(F.when(path == "package.json", package_uses(content, "jest", "vitest"))), "jest")
        .when(any_(path.isin("gradlew", "build.gradle", "build.gradle.kts")), "junit"))
    return project_files.groupBy("project_id").agg(framework.alias("framework")).withColumn(
        "error", F.when(F.col("framework").isNull(), "[error] no test framework found"))


Distiller = Callable[[DataFrame], DataFrame]

#: Distillers by kind: lines (log_id, line_no, line) in, digests out.
DISTILLERS: dict[str, Distiller] = {
    "gradle": gradle.digest, "npm": npm.digest, "jest": jest.digest,
    "pytest": pytest.digest, "junit": junit.digest, "generic": generic.digest,
}
_PREDICATES: list[tuple[str, Column]] = []


def register_distiller(kind: str, predicate: Column, fn: Distiller) -> None:
    """Add a distiller. ``predicate`` (over command and head) is tested before the built-in kinds."""
    DISTILLERS[kind] = fn
    _PREDICATES[:] = [(k, p) for k, p in _PREDICATES if k != kind] + [(kind, predicate)]


def kind_of(command: Column | str = "command", head: Column | str = "head") -> Column:
    """:func:`classify`, after the predicates of registered distillers."""
    kind = classify(command, head)
    for name, predicate in reversed(_PREDICATES):
        kind = F.when(predicate, name).otherwise(kind)
    return kind


def distill(lines: DataFrame) -> DataFrame:
    """Digests of lines with a ``kind`` column; unknown and missing kinds get the generic distiller."""
    kind = F.col("kind")  # as it is, so that the filter reaches the files
    parts = [fn(lines.filter(kind == name).drop("kind")) for name, fn in DISTILLERS.items() if name != "generic"]
    rest = lines.filter(kind.isNull() | ~kind.isin(*[k for k in DISTILLERS if k != "generic"])).drop("kind")
    return union([*parts, DISTILLERS["generic"](rest)])
