"""Scalar text functions, all built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gistline.functions import patterns as P


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.trim(as_col(c), F.lit(P.WHITESPACE))


def rtrim(c: Column | str) -> Column:
    return F.rtrim(as_col(c), F.lit(P.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """Whether trimming leaves nothing; stops at the first other character."""
    return ~as_col(c).rlike(f"[^{P.WHITESPACE}]")


def strip_cr(c: Column | str) -> Column:
    """Drop one carriage return at the end of a line."""
    c = as_col(c)
    return F.when(c.endswith("\r"), F.left(c, F.length(c) - 1)).otherwise(c)


def captured(c: Column | str, pattern: str, group: int) -> Column:
    """A regex group, null where it is empty or did not take part."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, group), F.lit(""))


def text_length(c: Column | str, utf16: bool = False) -> Column:
    """Length in code points, or in UTF-16 units."""
    c = as_col(c)
    if utf16:
        return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")
    return F.length(c)


def tokens_of_length(n: Column) -> Column:
    return F.floor((n + 3) / 4)


def estimate_tokens(c: Column | str, utf16: bool = False) -> Column:
    """A quarter of the length, rounded up."""
    return tokens_of_length(text_length(c, utf16))


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), P.ANSI, "")


def combine_streams(stdout: Column | str, stderr: Column | str) -> Column:
    """Standard output, then standard error, on a new line; an empty part is left out."""
    return F.concat_ws("\n", F.nullif(as_col(stdout), F.lit("")), F.nullif(as_col(stderr), F.lit("")))


def reduction_pct(original: Column | str, reduced: Column | str) -> Column:
    """Share saved in whole percent, halves rounded up, 0 for an empty original."""
    original, reduced = as_col(original), as_col(reduced)
    share = (original - reduced) / F.nullif(original, F.lit(0)) * 100
    return F.coalesce(F.floor(share + 0.5), F.lit(0)).cast("bigint")


def reduction_pct_1(original: Column | str, reduced: Column | str) -> Column:
    """Share saved in percent with one decimal."""
    original, reduced = as_col(original), as_col(reduced)
    share = (original - reduced) / F.nullif(original, F.lit(0)) * 1000
    return F.coalesce(F.floor(share + 0.5) / 10, F.lit(0.0))


def run_status(timed_out: Column | str, exit_code: Column | str) -> Column:
    exit_code = as_col(exit_code)
    return (
        F.when(as_col(timed_out), F.lit("TIMED OUT"))
        .when(exit_code == 0, F.lit("OK"))
        .otherwise(F.concat(F.lit("EXIT "), exit_code.cast("string")))
    )


def basename(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), r"([^/]*)/*\z", 1)


def strip_version(c: Column | str) -> Column:
    """Package name without its trailing ``@version``; a scope's own @ stays."""
    return F.regexp_replace(as_col(c), r"@[^@]+\z", "")


def ellipsize(c: Column | str, width: int = 80) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def compact_ws(c: Column | str) -> Column:
    """White space runs become one blank; a trailing opening brace goes."""
    one_line = F.regexp_replace(trim(c), r"\s+", " ")
    return trim(F.regexp_replace(one_line, r"\s*\{\s*\z", ""))


def count_prefix(n: Column | str) -> Column:
    n = as_col(n)
    return F.when(n > 1, F.concat(F.lit("[×"), n.cast("string"), F.lit("] "))).otherwise(F.lit(""))


def counted(n: Column | str, noun: str) -> Column:
    """``1 error``, ``2 errors``."""
    n = as_col(n)
    return F.when(n == 1, F.lit(f"1 {noun}")).otherwise(F.concat(n.cast("string"), F.lit(f" {noun}s")))


def regex_escape(literal: str) -> str:
    """A literal as a pattern, for parameters known on the driver."""
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in literal)


def regex_escape_col(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


# Labels of the symbol kinds that differ from the kind's own name.
KIND_LABELS = {"function": "fun", "type_alias": "type"}
# All symbol kinds.
SYMBOL_KINDS = [
    "class", "interface", "enum", "object", "struct", "trait", "function", "method",
    "constructor", "property", "field", "const", "type_alias", "namespace", "module",
]


def kind_label(c: Column | str) -> Column:
    c = as_col(c)
    label = c
    for kind, shown in KIND_LABELS.items():
        label = F.when(c == kind, F.lit(shown)).otherwise(label)
    return label


def line_range_label(lo: Column | str, hi: Column | str) -> Column:
    return F.concat(F.lit("[L"), as_col(lo).cast("string"), F.lit("-L"), as_col(hi).cast("string"), F.lit("]"))
