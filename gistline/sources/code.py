"""Source files: reading, language, identity, what changed since the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistline.functions import text as T
from gistline.sources.store import ID_DIGITS

# Languages by file ending.
LANGUAGES = {
    ".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust",
}
# Id prefixes by language.
PREFIXES = {"kotlin": "kt", "java": "java", "typescript": "ts", "javascript": "js", "python": "py",
            "go": "go", "rust": "rs"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def language_of(path: Column | str) -> Column:
    """Language by the text from the last dot on, null if unknown."""
    return _lookup(LANGUAGES, F.lower(F.regexp_extract(T.as_col(path), r"(\.[^.]*)\z", 1)))


def file_id(path: Column | str, mtime_ms: Column | str, size: Column | str) -> Column:
    path = T.as_col(path)
    seed = F.concat_ws("\u0000", path, T.as_col(mtime_ms).cast("string"), T.as_col(size).cast("string"))
    prefix = F.coalesce(_lookup(PREFIXES, language_of(path)), F.lit("txt"))
    return F.concat(prefix, F.lit("_"), F.left(F.sha2(seed, 256), F.lit(ID_DIGITS)))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, mtime_ms, size_bytes, source_text."""
    meta = F.col("_metadata")
    return spark.read.text(path, wholetext=True).select(
        meta["file_path"].alias("path"), F.unix_millis(meta["file_modification_time"]).alias("mtime_ms"),
        meta["file_size"].alias("size_bytes"), F.col("value").alias("source_text"))


def profile(files: DataFrame) -> DataFrame:
    """Language, id, lines and tokens of each file."""
    text = F.col("source_text")
    return files.select(
        *[c for c in files.columns if c != "source_text"],
        file_id("path", "mtime_ms", "size_bytes").alias("file_id"), language_of("path").alias("language"),
        F.size(F.split(text, "\n")).cast("bigint").alias("line_count"), T.estimate_tokens(text).alias("token_estimate"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(language_of("path").alias("language")).agg(F.count("*").alias("files"))


def select_changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose id is not stored yet: new, or with another time or size."""
    keyed = files.withColumn("file_id", file_id("path", "mtime_ms", "size_bytes"))
    return keyed.join(stored.select("file_id"), "file_id", "left_anti")


def read_mode(files: DataFrame, small_lines: int = 300, small_tokens: int = 1500) -> DataFrame:
    """How a file is returned, from mode, focus, focus_hits, parse_status and its size.

    Adds ``returned``: full, outline, focused, outline_note (a focus without hits) or error.
    """
    asked, focus = F.coalesce(F.col("mode"), F.lit("auto")), F.col("focus").isNotNull()
    small = (F.col("line_count") <= small_lines) & (F.col("token_estimate") <= small_tokens)
    returned = (
        F.when(F.col("parse_status") == "failed",
               F.when(F.col("language").isNull() & (asked != "outline"), "full").otherwise("error"))
        .when(asked == "full", "full")
        .when(small & ~focus, "full")
        .when(focus & (F.col("focus_hits") > 0), "focused")
        .when(focus, "outline_note")
        .otherwise("outline"))
    return files.withColumn("returned", returned)
