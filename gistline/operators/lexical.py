"""Declarations, doc comments and bracket errors of source files, without a grammar.

Strings and comments are blanked in place, so every character keeps its offset. The rest is cut into
pieces that end in a bracket, a semicolon or the line's end; running sums over the pieces give each
piece its offset in the file and its bracket depth. What belongs together is then found per
(file, depth): at one depth opening and closing brackets take turns, so a bracket's partner, the
bracket around a declaration and the place where a declaration ends are its neighbours among the
pieces of that depth. ``scan`` finds them by spans, with one row for a piece however deep it stands.
Declarations are nested by the same rule, over their own beginnings and ends.

Known limits: variables inside functions are left out on purpose; a type in braces before a body
(``f(): { a: number } {``) ends the declaration; raw strings over several lines that hold a comment
sign, and statements that go on behind an operator the rules below do not name, are cut there.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gistline.functions import text as T
from gistline.operators.scan import once, scan, span_of
from gistline.operators.trees import paths
from gistline.sources.staging import stage

_NAME = "([A-Za-z_$][A-Za-z0-9_$]*)"
_FUNCTIONS = ["function", "method", "constructor"]
_VARIABLES = ["property", "field", "const"]

# Words that may stand before a declaration, by language.
MODIFIERS = {
    "kotlin": [
        "public", "private", "protected", "internal", "open", "abstract", "final", "sealed", "data", "inner", "enum", "annotation",
        "value", "inline", "override", "suspend", "tailrec", "operator", "infix", "external", "const", "lateinit", "companion",
        "expect", "actual"],
    "java": [
        "public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default",
        "transient", "volatile", "sealed"],
    "typescript": [
        "export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override"],
    "javascript": ["export", "default", "async", "static"],
    "python": ["async"],
    "go": [],
    "rust": ["pub", "async", "unsafe", "const", "extern", "default"],
}

# Declaration forms: (kind, text after the modifiers with the name as group). The first match counts.
_C_LIKE_METHOD = r"(?:<[^>]*>\s*)?(?!return\b|new\b|else\b|throw\b|case\b|package\b|import\b)[A-Za-z_][A-Za-z0-9_.<>\[\], ?]*\s+"
_NOT_STATEMENT = r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|do\b|try\b|else\b|await\b|throw\b|new\b|super\b|this\b)"
_SCRIPT = [
    ("class", rf"class\s+{_NAME}"),
    ("interface", rf"interface\s+{_NAME}"),
    ("enum", rf"(?:const\s+)?enum\s+{_NAME}"),
    ("namespace", rf"(?:namespace|module)\s+{_NAME}"),
    ("type_alias", rf"type\s+{_NAME}[^=]*="),
    ("function", rf"function\s*\*?\s*{_NAME}"),
    ("const", rf"(?:const|let|var)\s+{_NAME}"),
    # Calls look the same; they are told apart by where they stand, see ``fits`` below.
    ("method", rf"(?:get\s+|set\s+)?\*?#?{_NOT_STATEMENT}{_NAME}\??\s*(?:<[^>]*>)?\(.*[;{{}}(,]\s*\z"),
    ("field", rf"{_NOT_STATEMENT}{_NAME}[?!]?\s*(?::|=[^=>])"),
]
FORMS = {
    "kotlin": [
        ("interface", rf"(?:fun\s+)?interface\s+{_NAME}"),
        ("class", rf"class\s+{_NAME}"),
        ("object", rf"object\s+{_NAME}"),
        ("companion", r"object(\s*(?:[:{].*)?)\z"),
        ("function", rf"fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][A-Za-z0-9_.<>?, ]*\.)?{_NAME}\s*\("),
        ("property", rf"(?:val|var)\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][A-Za-z0-9_.<>?]*\.)?{_NAME}"),
        ("type_alias", rf"typealias\s+{_NAME}"),
    ],
    "java": [
        ("interface", rf"@?interface\s+{_NAME}"),
        ("class", rf"(?:class|record)\s+{_NAME}"),
        ("enum", rf"enum\s+{_NAME}"),
        ("method", rf"{_C_LIKE_METHOD}{_NAME}\s*\("),
        ("constructor", rf"{_NOT_STATEMENT}{_NAME}\s*\([^;]*[{{(,]\s*\z"),
        ("field", rf"{_C_LIKE_METHOD}{_NAME}\s*[=;]"),
    ],
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": [("class", rf"class\s+{_NAME}"), ("function", rf"def\s+{_NAME}")],
    "go": [
        ("method", rf"func\s*\([^)]*\)\s*{_NAME}"),
        ("function", rf"func\s+{_NAME}"),
        ("type_alias", rf"type\s+{_NAME}"),
    ],
    "rust": [
        ("struct", rf"struct\s+{_NAME}"), ("enum", rf"enum\s+{_NAME}"), ("trait", rf"trait\s+{_NAME}"),
        ("class", rf"impl(?:<[^>]*>)?\s+(?:[^{{]*\sfor\s+)?{_NAME}"), ("function", rf"fn\s+{_NAME}"),
        ("type_alias", rf"type\s+{_NAME}"), ("const", rf"(?:const|static)\s+(?:mut\s+)?{_NAME}"), ("module", rf"mod\s+{_NAME}"),
    ],
}

# Which languages end a statement at the line's end, and how a line goes on with the one before or after it.
_LINE_ENDS = ["kotlin", "typescript", "javascript", "go", "python"]
_GOES_ON = r"^(?:[.?:=&|{,]|->|(?:where|extends|implements|throws|with|by)\b)"
_ACCESSOR = r"^(?:(?:private|protected|internal)\s+)?(?:get|set)\b\s*(?:\(|=|\z)"
_HANGS = r"(?:[=*/&|<?:.]|->|=>|(?<!\+)\+|(?<!-)-)\z"
_WITH_SEMICOLON = ["java", "typescript", "javascript", "rust"]
_ANNOTATION = r"^(?:@[A-Za-z_][A-Za-z0-9_.]*(?:\([^()]*\))?\s*)+\z"
_PARAMETER = rf"[(,]\s*(?:@[A-Za-z0-9_.]+(?:\([^)]*\))?\s+)*((?:(?:@MODS@)\s+)*(?:val|var)\s+{_NAME}\s*:[^,()<]*(?:<[^>]*>[^,()<]*)*)"

# Tokens of a line whose escapes are blanked already, so that a string is a run of one character
# class: Java matches that in a loop, while alternatives in a repetition recurse and overflow the
# stack on long lines. What opens and does not end on the line is a token up to its end.
_COMMENT = r"/\*.*?\*/|/\*.*|//.*"
_TOKENS = {
    ("kotlin", "java"): '""".*?"""|""".*|"[^"]*"|\'[^\']*\'|' + _COMMENT + r"""|[^"'/]+|.""",
    ("typescript", "javascript", "go"): '"[^"]*"|\'[^\']*\'|`[^`]*`|`.*|' + _COMMENT + r"""|[^"'`/]+|.""",
    ("python",): '""".*?"""|""".*|\'\'\'.*?\'\'\'|\'\'\'.*|"[^"]*"|\'[^\']*\'|#.*' + r"""|[^"'#]+|.""",
    ("rust",): '"[^"]*"|\'[^\']?\'|' + _COMMENT + r"""|[^"'/]+|.""",
}
# What opens and closes text over several lines, and how such text ends.
_RAW = {
    ("kotlin", "java"): (['"""'], r'^.*?"""'), ("typescript", "javascript", "go"): (["`"], r"^[^`]*`"),
    ("python",): (['"""', "'''"], "^.*?(?:\"\"\"|''')")}
_PAIR_ROUNDS = 4  # how deep pairs on one line are left out before the brackets are dealt
_IS_COMMENT_LINE = r"^\s*(?://|\*|/\*|#)"


def _by_language(table: dict, value) -> Column:
    """The value for the row's language, null for others."""
    out = F.lit(None)
    for languages, item in table.items():
        out = F.when(F.col("language").isin(*languages), value(item)).otherwise(out)
    return out


def _prefix(language: str) -> str:
    words = "|".join(MODIFIERS[language])
    # A Java modifier must not be taken for a return type, so there the prefix gives nothing back.
    many = "*+" if language == "java" else "*"
    return rf"^\s*(?:@[A-Za-z0-9_.]+(?:\([^)]*\))?\s+)*((?:(?:{words or '(?!)'})(?:\([^)]*\))?\s+){many})"


def _tokens(text: Column | str) -> Column:
    return _by_language(_TOKENS, lambda p: F.regexp_extract_all(text, F.lit(f"(?:{p})"), F.lit(0)))


def _blanked(tokens: Column) -> Column:
    """The text of the tokens, of the same length: comments as blanks, strings as blanks between their quotes."""
    def blank(t: Column) -> Column:
        inner = F.repeat(F.lit(" "), F.length(t) - 2)
        return (
            F.when(t.rlike(r"^(?://|/\*|#)"), F.repeat(F.lit(" "), F.length(t)))
            .when((F.length(t) > 1) & t.rlike("^[\"'`]"), F.concat(F.left(t, F.lit(1)), inner, F.left(t, F.lit(1))))
            .otherwise(t))

    return F.array_join(F.transform(tokens, blank), "")


def code_text(lines: DataFrame, span: int | None = None, keep_span: bool = False) -> DataFrame:
    """Lines (file_id, language, line_no, line) with ``code``, as long as the line, strings and comments
    blanked; ``in_comment`` and ``in_raw`` say where the line begins. ``keep_span`` as for ``scan``."""
    line, python = F.col("line"), F.col("language") == "python"
    known = lines.filter(F.col("language").isin(*FORMS)).select(
        "file_id", "language", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    ready = once(known, "bare", F.regexp_replace(line, r"\\.", "  "))
    ready = once(ready, "tokens", _tokens("bare"))
    ready = once(ready, "first_code", _blanked(F.col("tokens"))).withColumn("last", F.try_element_at("tokens", F.lit(-1))).drop("tokens")
    # The last token opens a comment or a raw string that the line does not close.
    last = F.col("last")
    comment = last.startswith("/*") & ~((F.length(last) > 3) & last.endswith("*/")) & ~python
    state = F.when(F.coalesce(comment, F.lit(False)), 1).when(~python & line.contains("*/"), 0)
    opens = reduce(Column.__or__, [
        F.col("language").isin(*languages) & last.startswith(mark) & ~((F.length(last) >= 2 * len(mark)) & last.endswith(mark))
        for languages, (marks, _) in _RAW.items() for mark in marks])
    toggles = F.when(opens & ~line.rlike(_IS_COMMENT_LINE), 1)
    found = scan(ready.withColumns({"state": state, "toggles": toggles}).drop("last"), key=["file_id"], span=span,
                 before={"comment": "state"}, running={"marks": "toggles"}, keep_span=keep_span, even=keep_span)
    in_comment = F.coalesce(F.col("comment") == 1, F.lit(False))
    in_raw = ~in_comment & ((F.col("marks") - F.coalesce("toggles", F.lit(0))) % 2 == 1)
    skip = F.when(in_comment, F.length(F.regexp_extract("line", r"^.*?\*/", 0))).when(
        in_raw, F.length(_by_language(_RAW, lambda raw: F.regexp_extract("bare", raw[1], 0))))
    skip = F.when(skip == 0, F.length(line)).otherwise(skip)
    rest = F.concat(F.repeat(F.lit(" "), F.col("skip")), _blanked(_tokens(F.substr("bare", F.col("skip") + 1))))
    code = F.when(F.col("skip").isNull(), F.col("first_code")).otherwise(rest)
    return found.withColumn("skip", skip.cast("int")).select(
        "file_id", "language", "line_no", "line", code.alias("code"), in_comment.alias("in_comment"), in_raw.alias("in_raw"),
        *(["__span"] if keep_span else []))


def _declaration(text: Column) -> Column:
    """What a statement that begins with ``text`` declares: (kind, name, prefix), null if nothing.

    Most text declares nothing, which one pattern of all forms tells. One chain finds the form that
    matches; the name is taken out by that form alone.
    """
    forms = [(language, kind, _prefix(language) + form) for language, own in FORMS.items() for kind, form in own]
    at = F.lit(None)
    for language in FORMS:
        chain = F.lit(None)
        for k, (own, _, pattern) in reversed(list(enumerate(forms))):
            if own == language:
                chain = F.when(text.rlike(pattern), F.lit(k)).otherwise(chain)
        some = _prefix(language) + "(?:" + "|".join(form for _, form in FORMS[language]) + ")"
        at = F.when(F.col("language") == language, F.when(text.rlike(some), chain)).otherwise(at)
    named = F.from_json(F.lit(json.dumps([{"kind": kind, "pattern": pattern} for _, kind, pattern in forms])), "array<struct<kind:string,pattern:string>>")
    return F.transform(F.filter(F.array(F.get(named, at)), lambda f: f.isNotNull()), lambda f: F.struct(
        f["kind"].alias("kind"), F.call_function("regexp_extract", text, f["pattern"], F.lit(2)).alias("name"),
        F.call_function("regexp_extract", text, f["pattern"], F.lit(1)).alias("prefix")))


def _parameters(text: Column) -> Column:
    """Properties that a parameter list declares: (at, kind, name, prefix), by their place in ``text``."""
    pattern = _PARAMETER.replace("@MODS@", "|".join(MODIFIERS["kotlin"]))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when((F.col("language") == "kotlin") & text.rlike(r"\b(?:val|var)\b"), F.transform(words, lambda w: F.struct(
        (F.instr(text, w) - 1).alias("at"), F.lit("property").alias("kind"),
        F.regexp_extract(w, rf"(?:val|var)\s+{_NAME}", 1).alias("name"), F.regexp_extract(w, r"^(.*?)(?:val|var)\s", 1).alias("prefix"),
        F.length(F.rtrim(w)).alias("chars"))))


def code_pieces(lines: DataFrame, span: int | None = None) -> DataFrame:
    """The pieces of all lines, written once; later steps read this table and not the texts.

    One row per bracket, semicolon and line end: file_id, language, line_no, c, start, end (offsets in
    the file, end exclusive), depth_before, depth_after, ``pad`` (blanks before c); ``decl`` and ``parameters`` where a statement
    begins, at offset ``begin``; ``first`` on a line's first piece. On line ends what the line is:
    blank, comment, annotation, and how it goes on. Offsets are those of the text with one sign for a line end.
    """
    line, code = F.col("line"), F.col("shown")
    coded = code_text(lines, min(span or 4096, 4096), keep_span=True)  # a line may have many pieces
    # Blanks alone go first: trimming a set of signs looks at every sign of the text.
    coded = once(coded, "shown", T.trim(F.trim("code")))  # patterns step through every blank in front of them
    blank = code == ""
    is_text = ~T.is_blank(line)
    python = F.col("language") == "python"
    info = F.struct(
        blank.alias("blank"), is_text.alias("is_text"),
        (is_text & blank & ~F.col("in_raw") & (~python | F.trim(line).startswith("#"))).alias("comment"),
        F.col("in_comment").alias("in_comment"), F.col("in_raw").alias("in_raw"), code.rlike(_ANNOTATION).alias("annotation"),
        (F.col("in_raw") | code.rlike(_GOES_ON) | ((F.col("language") == "kotlin") & code.rlike(_ACCESSOR))).alias("goes_on"),
        (~python & F.right("shown", F.lit(2)).rlike(_HANGS)).alias("hangs"), code.endswith(",").alias("comma"),
        F.length(F.rtrim(line)).cast("bigint").alias("chars"), F.length(line).cast("bigint").alias("line_chars"),
        (F.length(line) - F.length(F.ltrim(line))).cast("bigint").alias("indent"))
    parts = coded.withColumn("info", info).select(
        "file_id", "__span", "language", "line_no", "info",
        F.posexplode(F.regexp_extract_all(F.concat("code", F.lit("\n")), F.lit(r"[^;{}\n]*+[;{}\n]"), F.lit(0))).alias("s", "part"))
    part = F.col("part")
    parts = once(parts, "text", T.trim(F.trim(F.when(part.endswith("\n"), F.left(part, F.length(part) - 1)).otherwise(part))))
    parts = once(parts, "decl", F.when((F.length("text") > 1) & (~python | (F.col("s") == 0)), F.get(_declaration(F.col("text")), F.lit(0))))
    parts = parts.withColumns({
        "parameters": F.when(F.length("text") > 1, _parameters(F.col("part"))), "lead": F.length("part") - F.length(F.ltrim("part"))})
    pieces = parts.select(
        "file_id", "__span", "language", "line_no", "s", "info", "decl", "parameters", "lead",
        F.posexplode(F.regexp_extract_all("part", F.lit(r"[^()\[\]{};\n]*+[()\[\]{};\n]"), F.lit(0))).alias("k", "piece"))
    c = reduce(lambda rest, sign: F.when(F.col("piece").endswith(sign), sign).otherwise(rest), ";()[]{}", F.lit("\n"))
    head = F.col("k") == 0
    thin = pieces.select(
        "file_id", "__span", "language", "line_no", "s", "k", c.alias("c"), F.length("piece").cast("bigint").alias("chars"),
        (F.length("piece") - 1 - F.length(F.rtrim(F.left("piece", F.length("piece") - 1)))).alias("pad"),
        F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0).alias("delta"),
        *[F.when(head, F.col(n)).alias(n) for n in ("decl", "parameters", "lead")],
        F.when((c == "\n") | (head & (F.col("s") == 0)), F.col("info")).alias("info"))
    # Pieces stay where their lines were dealt to; sums of the spans before them are known once they are written.
    along = Window.partitionBy("file_id", "__span").orderBy("line_no", "s", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = thin.withColumns({"end": F.sum("chars").over(along), "depth_after": F.sum("delta").over(along)})
    start = F.col("end") - F.col("chars")
    rows = stage(summed.select(
        "file_id", "__span", "language", "line_no", "c", start.alias("start"), "end", (F.col("depth_after") - F.col("delta")).alias("depth_before"),
        "depth_after", "delta", "pad", "decl", "parameters", (start + F.col("lead")).alias("begin"), "info",
        ((F.col("s") == 0) & (F.col("k") == 0)).alias("first")))
    earlier = Window.partitionBy("file_id").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each span but a file's first.
    moved = stage(rows.groupBy("file_id", "__span").agg(F.max("end").alias("chars"), F.sum("delta").alias("rise")).select(
        "file_id", "__span", F.sum("chars").over(earlier).alias("chars"), F.sum("rise").over(earlier).alias("rise")).filter("chars IS NOT NULL"))
    if moved.isEmpty():
        return rows.drop("__span")
    by = {**dict.fromkeys(("start", "end", "begin"), "chars"), **dict.fromkeys(("depth_before", "depth_after"), "rise")}
    return stage(rows.join(moved, ["file_id", "__span"], "left").withColumns(
        {n: F.col(n) + F.coalesce(m, F.lit(0)) for n, m in by.items()}).drop("__span", "chars", "rise"))


def _declared(pieces: DataFrame) -> DataFrame:
    """Beginnings of declarations: file_id, language, line_no, at (offset), depth, decl, in_list, chars."""
    own = pieces.filter("decl IS NOT NULL").select(
        "file_id", "language", "line_no", F.col("begin").alias("at"), F.col("depth_before").alias("depth"), "decl",
        F.lit(False).alias("in_list"), F.lit(None).cast("bigint").alias("chars"),
        F.when(F.col("first"), F.col("info.indent")).alias("indent"))
    listed = pieces.filter("size(parameters) > 0").select(
        "file_id", "language", "line_no", "begin", "start", (F.col("depth_before") + 1).alias("depth"), F.explode("parameters").alias("p")).select(
        "file_id", "language", "line_no", (F.col("start") + F.col("p.at")).alias("at"), "depth",
        F.struct("p.kind", "p.name", "p.prefix").alias("decl"), F.lit(True).alias("in_list"), F.col("p.chars").cast("bigint").alias("chars"),
        F.lit(None).cast("bigint").alias("indent"))
    return own.unionByName(listed)


def _line_ends(pieces: DataFrame, span: int | None) -> DataFrame:
    """Line ends that end a statement (``ends``), or would if a comma did not stand there."""
    rows = pieces.filter((F.col("c") == "\n") & F.col("language").isin(*_LINE_ENDS) & (~F.col("info.blank") | F.col("info.in_raw"))).select(
        "file_id", "line_no", "end", "pad", F.col("depth_after").alias("level"), "info.goes_on",
        (F.col("info.hangs") | F.col("info.annotation")).alias("open"), (~F.col("info.comma")).alias("ends"))
    known = scan(rows, key=["file_id"], span=span, after={"next": "goes_on"})
    return known.filter(~F.col("open") & ~F.coalesce("next", F.lit(False))).select("file_id", "line_no", "end", "pad", "level", "ends")


def _neighbours(pieces: DataFrame, declared: DataFrame, span: int | None) -> DataFrame:
    """Brackets and declarations with their neighbours of the same file and depth, see the module's text.

    ``kind``: bracket, declaration, or around (a declaration among the brackets one level further out).
    """
    bracket = F.col("delta") != 0
    level = F.least("depth_before", "depth_after")
    # Places are two numbers each: hash aggregates take no structs.
    places = ("place", "listed", "body")
    empty = {"row": "struct<language:string,line_no:bigint,at:bigint,decl:struct<kind:string,name:string,prefix:string>,in_list:boolean,chars:bigint,indent:bigint>",
             **{f"{n}_{part}": "bigint" for n in places for part in ("end", "line")}, "sign": "int"}

    def event(df: DataFrame, kind: str | Column, level: Column, pos: Column, **columns: Column) -> DataFrame:
        own = {n: c for n, c in columns.items() if n not in places}
        for n in places:
            if n in columns:
                own |= {f"{n}_end": columns[n], f"{n}_line": F.when(columns[n].isNotNull(), F.col("line_no"))}
        return df.select("file_id", level.cast("bigint").alias("level"), pos.cast("bigint").alias("pos"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                         *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()])

    closes = F.col("c") == "}"
    brackets = pieces.filter(bracket)
    end = F.col("end")
    inside = end - 1 - F.col("pad")
    events = [
        event(brackets, "bracket", level, end * 4, sign=F.ascii("c"), place=F.when(closes & (F.col("language") != "python"), end),
              listed=F.when(closes, end), body=F.when(F.col("c") == "{", end - 1)),
        event(brackets.filter("delta < 0"), "fall", level + 1, end * 4 - 1, place=inside, listed=inside),
        event(pieces.filter("c = ';'"), "stop", F.col("depth_after"), end * 4,
              place=end - F.when(F.col("language").isin(*_WITH_SEMICOLON), 0).otherwise(1), listed=inside),
        event(_line_ends(pieces, span), "line", F.col("level"), end * 4, place=F.when(F.col("ends"), inside), listed=inside)]
    row = F.struct("language", F.col("line_no").cast("bigint").alias("line_no"), F.col("at").cast("bigint").alias("at"), "decl", "in_list", "chars", "indent")
    asks_around = (F.col("language") == "kotlin") & (F.col("decl.kind") == "property")
    asked = declared.select("*", F.explode(F.when(asks_around, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("out"))
    events.append(event(asked, F.when(F.col("out") == 0, "declaration").otherwise("around"), F.col("depth") - F.col("out"), F.col("at") * 4 + 2, row=row))
    both = reduce(DataFrame.unionByName, events)
    near = scan(
        both, key=["file_id", "level"], pos="pos", span=(span or 1 << 16) * 16, before={"before": "sign"},
        after={f"first_{n}": n for n in empty if n.endswith(("_end", "_line"))})
    return near.select("file_id", "kind", "row", F.chr("before").alias("before"), *[
        F.when(F.col(f"first_{n}_end").isNotNull(), F.struct(F.col(f"first_{n}_end").alias("end"), F.col(f"first_{n}_line").alias("line_no"))).alias(f"first_{n}")
        for n in places])


def _python_ends(pieces: DataFrame, declared: DataFrame, span: int | None) -> DataFrame:
    """(file_id, at, line_hi) of Python declarations: the last text line before a logical line with as little indentation."""
    rows = pieces.filter("first AND language = 'python'").select(
        "file_id", "line_no", "info", ((F.col("depth_before") == 0) & ~F.col("info.blank")).alias("is_logical"),
        (F.col("info.is_text") & ~F.col("info.comment")).alias("is_text"))
    at, indent = F.col("line_no"), F.col("info.indent")
    known = scan(rows, key=["file_id"], span=span, before={
        "last_text": F.when(F.col("is_text"), at), "last_indent": F.when(F.col("is_logical"), indent)})
    closes = known.filter("is_logical AND info.indent <= last_indent").select(
        "file_id", F.explode(F.sequence(indent, F.col("last_indent"))).alias("level"), (at * 2).alias("ord"), F.col("last_text").alias("hi"))
    opened = declared.filter("language = 'python'").select(
        "file_id", F.col("indent").alias("level"), (at * 2 + 1).alias("ord"), F.lit(None).cast("bigint").alias("hi"), "at")
    both = closes.withColumn("at", F.lit(None).cast("bigint")).unionByName(opened)
    ended = scan(both, key=["file_id", "level"], pos="ord", span=span, after={"line_hi": F.col("hi")})
    last = rows.filter("is_text").groupBy("file_id").agg(F.max("line_no").alias("last_line"))
    return ended.filter("at IS NOT NULL").join(last, "file_id", "left").select("file_id", "at", F.coalesce("line_hi", "last_line").alias("line_hi"))


def _spans(pieces: DataFrame, span: int | None) -> DataFrame:
    """Declarations from begin to end, written: file_id, language, at, char_hi, line_lo, line_hi, head_hi,
    head_line, kind, name, prefix. ``head_hi`` is where the signature ends."""
    declared = _declared(pieces)
    near = stage(_neighbours(pieces, declared, span).filter("row IS NOT NULL"))
    around = near.filter("kind = 'around'").select("file_id", F.col("row.at").alias("at"), F.col("before").alias("around"))
    own = near.filter("kind = 'declaration'").select("file_id", "row.*", "first_place", "first_listed", "first_body")
    # Lines of the file, for ends that are lines or the file's own end.
    ends = pieces.filter("c = '\n'").select("file_id", F.col("line_no").alias("line_hi"), (F.col("end") - 1 - F.col("info.line_chars") + F.col("info.chars")).alias("line_end"), "info")
    last = ends.filter("info.is_text").groupBy("file_id").agg(F.max(F.struct(F.col("line_end").alias("end"), F.col("line_hi").alias("line_no"))).alias("last"))
    py = _python_ends(pieces, declared, span).join(ends.drop("info"), ["file_id", "line_hi"], "left").select(
        "file_id", "at", F.struct(F.col("line_end").alias("end"), F.col("line_hi").alias("line_no")).alias("py_end"))
    # A parameter on a line of its own ends at its comma.
    listed = (F.col("decl.kind") == "property") & (F.col("around") == "(")
    one = F.when(F.col("in_list"), F.struct((F.col("at") + F.col("chars")).alias("end"), F.col("line_no").alias("line_no")))
    first = F.coalesce(one, F.when(listed, F.col("first_listed")).otherwise(F.col("first_place")), F.col("last"))
    whole = F.coalesce("py_end", first)
    body = F.when((F.col("first_body.end") < whole["end"]) & (F.col("language") != "python") & ~F.col("in_list"), F.col("first_body"))
    head = F.coalesce(body, F.when(F.col("language") == "python", first).otherwise(whole))
    kind = F.col("decl.kind")
    joined = own.join(around, ["file_id", "at"], "left").join(last, "file_id", "left").join(py, ["file_id", "at"], "left")
    return stage(joined.filter(~F.col("in_list") | (F.col("around") == "(")).select(
        "file_id", "language", "at", whole["end"].alias("char_hi"), F.col("line_no").alias("line_lo"), whole["line_no"].alias("line_hi"),
        head["end"].alias("head_hi"), head["line_no"].alias("head_line"),
        F.when(kind == "companion", "object").otherwise(kind).alias("kind"),
        F.when(kind == "companion", "Companion").otherwise(F.col("decl.name")).alias("name"), F.col("decl.prefix").alias("prefix")))


def _parents(found: DataFrame, span: int | None) -> DataFrame:
    """(file_id, at, up): each declaration's innermost outer one, null at the top."""
    opens = found.select("file_id", (F.col("at") * 4 + 1).alias("pos"), F.lit(1).alias("step"), "at")
    # A declaration that nothing ends is open up to the file's end; no two close at one place, one count apart.
    closes = found.select("file_id", F.greatest(F.col("char_hi") * 4, F.col("at") * 4 + 2).alias("pos"), F.lit(-1).alias("step"), F.lit(None).cast("bigint").alias("at"))
    moves = opens.unionByName(closes).groupBy("file_id", "pos").agg(F.sum("step").alias("step"), F.max("at").alias("at"))
    levels = scan(moves, key=["file_id"], pos="pos", span=(span or 1 << 16) * 16, running={"depth": F.col("step")}).filter("at IS NOT NULL")
    own = levels.select("file_id", "depth", "pos", "at", F.lit(True).alias("own"))
    ask = levels.select("file_id", (F.col("depth") - 1).alias("depth"), "pos", "at", F.lit(False).alias("own"))
    near = scan(own.unionByName(ask), key=["file_id", "depth"], pos="pos", span=(span or 1 << 16) * 16, before={"up": F.when(F.col("own"), F.col("at"))})
    return near.filter("NOT own").select("file_id", "at", "up")


def cut_texts(ranges: DataFrame, lines: DataFrame, offsets: DataFrame | None, name: str) -> DataFrame:
    """(file_id, id, ``name``): the text from offset ``lo`` to ``hi`` of each range (file_id, id, lo, hi, line_lo, line_hi).

    ``offsets`` is the line index (file_id, line_no, char0); without it the lines are taken whole. Only lines inside a range are fetched; a
    range is put together from its lines, and no text of a whole file is ever in a cell.
    """
    wanted = ranges.select("file_id", "id", "lo", "hi", F.explode(F.sequence("line_lo", "line_hi")).alias("line_no"))
    part = F.col("line")
    if offsets is not None:
        wanted = wanted.join(offsets.select("file_id", "line_no", "char0"), ["file_id", "line_no"])
        skip = F.greatest(F.col("lo") - F.col("char0"), F.lit(0))
        upto = F.least(F.col("hi") - F.col("char0"), F.length("line"))
        part = F.substr("line", (skip + 1).cast("int"), F.greatest(upto - skip, F.lit(0)).cast("int"))
    placed = wanted.join(lines.select("file_id", "line_no", "line"), ["file_id", "line_no"])
    return placed.select("file_id", "id", "line_no", part.alias("part")).groupBy("file_id", "id").agg(
        F.expr("listagg(part, '\n') WITHIN GROUP (ORDER BY line_no)").alias(name))


def line_offsets(pieces: DataFrame) -> DataFrame:
    """The line index: (file_id, line_no, char0), the offset of each line's first character."""
    return pieces.filter("first").select("file_id", "line_no", F.col("start").alias("char0"))


def lexical_symbols(lines: DataFrame, span: int | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """Symbol table of the files: names, kinds, modifiers, signatures, lines, offsets, parents.

    ``pieces`` is ``code_pieces(lines)``, if it is there already. ``char_lo`` and ``char_hi`` are
    0-based, the end exclusive, in the text of the lines with one sign for each line end.
    """
    pieces = pieces if pieces is not None else code_pieces(lines, span)
    found = _spans(pieces, span)
    tree = paths(found.join(_parents(found, span), ["file_id", "at"]), "file_id", "at", "up", "name")
    outer = found.select("file_id", F.col("at").alias("up"), F.col("kind").alias("outer_kind"), F.col("name").alias("outer_name"))
    placed = found.join(tree.select("file_id", "at", "up", "path"), ["file_id", "at"]).join(outer, ["file_id", "up"], "left")
    kind, nested = F.col("kind"), F.col("up").isNotNull()
    in_function = F.coalesce(F.col("outer_kind").isin(*_FUNCTIONS), F.lit(False))
    member_only = kind.isin("constructor", "field") | ((kind == "method") & (F.col("language") != "go"))
    fits = F.when(in_function, ~kind.isin(*_VARIABLES) & ~member_only).when(~nested, ~member_only).when(
        kind == "constructor", F.col("outer_name") == F.col("name")).otherwise(True)
    final_kind = F.when(nested & (kind == "function"), "method").when(nested & (kind == "property"), "field").otherwise(kind)
    words = F.filter(F.split(F.trim(F.col("prefix")), r"\s+"), lambda w: w != "")
    kept = stage(placed.filter(fits).select(
        "file_id", "language", "name", F.col("path").alias("qualified_name"),
        F.when(nested, F.substr("path", F.lit(1), F.length("path") - F.length("name") - 1)).alias("parent_qualified_name"),
        final_kind.alias("kind"), F.array_distinct(words).alias("modifiers"), "line_lo", "line_hi",
        F.col("at").alias("char_lo"), "char_hi", "head_hi", "head_line"))
    heads = cut_texts(kept.select("file_id", F.col("char_lo").alias("id"), F.col("char_lo").alias("lo"), F.col("head_hi").alias("hi"),
                                  "line_lo", F.col("head_line").alias("line_hi")), lines, line_offsets(pieces), "head")
    signature = T.compact_ws(F.regexp_replace(F.coalesce("head", "name"), r"[;,\s]+\z", ""))
    return kept.withColumn("id", F.col("char_lo")).join(heads, ["file_id", "id"], "left").select(
        "file_id", "language", "name", "qualified_name", "parent_qualified_name", "kind", "modifiers",
        signature.alias("signature"), "line_lo", "line_hi", "char_lo", "char_hi")


def leading_doc(lines: DataFrame, span: int | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no, doc): the comment directly before the first declaration of a line, at most two rows up.

    Lines of annotations alone belong to the declaration below them. Only the lines of comments that
    are some declaration's doc are fetched.
    """
    pieces = pieces if pieces is not None else code_pieces(lines, span)
    at = F.col("line_no")
    info = {n: F.col(f"info.{n}") for n in ("comment", "annotation", "blank", "in_comment")}
    rows = pieces.filter("first").select(
        "file_id", "line_no", "info.comment", F.col("info.annotation").cast("int").alias("annotation"),
        (~info["blank"] & ~info["annotation"]).alias("code"), (info["comment"] & (~info["in_comment"] | (F.col("language") == "python"))).alias("opens"),
        F.col("decl").isNotNull().alias("declares"))
    counted = scan(rows, key=["file_id"], span=span, running={"annotations": "annotation"}, keep_span=True)
    code, comment = F.col("code"), F.col("comment")
    marked = scan(counted, key=["file_id"], span=span, dealt=True, before={
        "begins": F.when(F.col("opens"), at).when(code, F.lit(-1)), "ended": F.when(comment, at).when(code, F.lit(-1)),
        "ended_annotations": F.when(comment, F.col("annotations")).when(code, F.lit(0))})
    gap = at - F.col("ended") - (F.col("annotations") - F.col("ended_annotations"))
    found = stage(marked.filter("declares AND begins > 0").filter(gap <= 2).select(
        "file_id", F.col("line_no").alias("id"), F.col("begins").alias("line_lo"), F.col("ended").alias("line_hi")))
    docs = cut_texts(found.select("*", F.lit(None).alias("lo"), F.lit(None).alias("hi")), lines, None, "doc")
    return docs.select("file_id", F.col("id").alias("line_no"), T.trim("doc").alias("doc"))


def _open_brackets(lines: DataFrame, span: int | None) -> DataFrame:
    """(file_id, line_no, c, n, depth_after, delta): the brackets of all lines, numbered, but for those beside a
    partner of their own sort on the same line.

    Partners are neighbours at their depth, so a pair that is left out changes the partner and the depth of no other.
    """
    signs = F.regexp_replace("code", r"[^()\[\]{}]+", "")
    for _ in range(_PAIR_ROUNDS):
        signs = F.regexp_replace(signs, r"\(\)|\[\]|\{\}", "")
    rest = once(code_text(lines, span), "signs", signs).filter("signs <> ''")
    each = rest.select("file_id", "line_no", F.posexplode(F.split("signs", "")).alias("k", "c"))
    delta = F.when(F.col("c").isin("(", "[", "{"), 1).otherwise(-1)
    return scan(each.withColumn("delta", delta), key=["file_id"], order=["line_no", "k"], bucket=span_of("line_no", min(span or 4096, 4096)),
                running={"n": F.lit(1), "depth_after": "delta"})


def parse_errors(lines: DataFrame, span: int | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no, sign, error): a row for every bracket without a partner of its own sort, and one
    without line for each file in an unknown language."""
    brackets = _open_brackets(lines, span) if pieces is None else pieces.filter("delta <> 0").withColumn("n", F.col("end"))
    c, closer = F.col("c"), F.col("c").isin(")", "]", "}")
    near = scan(
        brackets.select("file_id", F.least(F.col("depth_after") - F.col("delta"), "depth_after").alias("level"), "n", "line_no", "c"),
        key=["file_id", "level"], pos="n", span=(span or 1 << 16) * 16, before={"before": "c"}, after={"after": "c"})
    partner = F.when(closer, F.col("before")).otherwise(F.col("after"))
    pairs = [("(", ")"), ("[", "]"), ("{", "}")]
    good = reduce(Column.__or__, [((c == a) & (partner == b)) | ((c == b) & (partner == a)) for a, b in pairs])
    wrong = near.filter(~F.coalesce(good, F.lit(False))).select("file_id", F.col("line_no").cast("bigint").alias("line_no"), c.alias("sign"))
    unknown = lines.filter(F.col("language").isNull() | ~F.col("language").isin(*FORMS)).select("file_id").distinct()
    return wrong.withColumn("error", F.concat(F.lit("ERROR at line "), F.col("line_no").cast("string"))).unionByName(
        unknown.select("file_id", F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("sign"),
                       F.lit("unsupported language").alias("error")))


def parse_status(lines: DataFrame, span: int | None = None, pieces: DataFrame | None = None) -> DataFrame:
    """(file_id, language, status, errors): failed without a known language, partial with errors, else ok."""
    files = lines.groupBy("file_id", "language").agg(F.lit(1).alias("_"))
    wrong = parse_errors(lines, span, pieces).groupBy("file_id").agg(
        F.count("*").alias("errors"), F.max(F.col("line_no").isNull()).alias("failed"))
    status = F.when(F.col("failed"), "failed").when(F.col("errors") > 0, "partial").otherwise("ok")
    return files.join(wrong, "file_id", "left").select(
        "file_id", "language", status.alias("status"), F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"))
