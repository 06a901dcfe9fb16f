"""License scans by conditional compression.

Blocks of a text that speak of licences are compressed with each known wording as a raw zstandard
dictionary. The wording that shrinks a block most, against compression without a dictionary, is the
candidate; it is confirmed by the exact differences of words between the block and the wording.
Around every speaking word each wording is also looked for by its words, over line ends and blank
lines and inside lines of any length, as far to either side as a confirmed wording could reach.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from gistline.llm.common import batch, ship, slices

LEVEL = 19
MAX_DIFFERENCE = 0.2  #: Differing words, against the words of the wording, up to which it is confirmed.
MIN_REDUCTION = 0.2  #: Share of the compressed size that the wording must save.

#: What a block must speak of to be compared at all; a line may end between the words.
SPEAKS = r"(?i)licen[cs]|copyright|rights\W+reserved|public\W+domain|spdx|redistribution|permission\W+is\W+hereby|without\W+warrant"

#: Fixed wordings: short notices, and the first paragraphs of well-known licences.
WORDINGS: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def speaking(text: str, speaks: re.Pattern) -> dict[int, list[tuple[int, int]]]:
    """Beginnings and ends, in the text, of what speaks of licences, by the line (from 0) where it begins."""
    out: dict[int, list[tuple[int, int]]] = {}
    begins = [0, *(m.end() for m in re.finditer("\n", text))]
    for i, line in enumerate(text.split("\n")):
        for m in speaks.finditer(line):
            out.setdefault(i, []).append((begins[i] + m.start(), begins[i] + m.end()))
    for m in speaks.finditer(text):
        if "\n" in m.group():
            out.setdefault(bisect_right(begins, m.start()) - 1, []).append(m.span())
    return {i: sorted(spans) for i, spans in sorted(out.items())}


def blocks(text: str, speaks: re.Pattern, longest: int) -> Iterator[tuple[int, str]]:
    """(line number from 1, block): every line that speaks of licences, and the paragraph that begins
    there if it has more lines, as far as the longest wording could reach. A line that is much longer
    comes in parts around its speaking words."""
    limit = 4 * longest + 1
    lines = text.split("\n")
    begin = [0, *(m.end() for m in re.finditer("\n", text))]
    for i, spans in speaking(text, speaks).items():
        line = lines[i]
        if len(line) <= limit:
            yield i + 1, line
        else:
            done = -1
            for a, z in ((a - begin[i], z - begin[i]) for a, z in spans):
                if z > done:
                    done = a + max(longest, z - a)
                    yield i + 1, line[max(0, a - longest):done]
        part, size = [line], len(line)
        for more in lines[i + 1:]:
            if not more.strip() or size > longest:
                break
            part.append(more)
            size += len(more) + 1
        if len(part) > 1:
            yield i + 1, "\n".join(part)[:limit]


class Scanner:
    """Compressors for a set of wordings; one in each worker."""

    def __init__(self, wordings: tuple[tuple[str, str], ...]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.names = [n for n, _ in wordings]
        self.words = [words(w) for _, w in wordings]
        self.sizes = dict(zip(self.names, map(len, self.words)))
        self.counts = [Counter(w) for w in self.words]
        self.longest = max((len(w) for _, w in wordings), default=0)
        self.shaped = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(w.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, w in wordings]

    def rank(self, block: str) -> list[tuple[float, int]]:
        """Saved share of the compressed size and wording, the largest first."""
        data = block.encode()
        base = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / base, k) for k, c in enumerate(self.shaped)), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, k: int) -> tuple[int, list[str]]:
        """Words to take from (-) or to add to (+) the wording to get the block's wording.

        What a block has before or after the wording, on a line of its own text, does not count.
        """
        own, known = words(block), self.words[k]
        ops = difflib.SequenceMatcher(None, known, own, autojunk=False).get_opcodes()
        while ops and ops[0][0] == "insert":
            ops = ops[1:]
        while ops and ops[-1][0] == "insert":
            ops = ops[:-1]
        out = []
        for op, a, z, x, y in ops:
            if op != "equal":
                out += [f"-{w}" for w in known[a:z]] + [f"+{w}" for w in own[x:y]]
        return len(out), out

    def around(self, text: str, speaks: re.Pattern) -> Iterator[tuple[int, tuple, str, int]]:
        """(line number from 1, result as of ``best``, block, words of the wording) of every wording that the words
        around a speaking word confirm, and that reaches over that word."""
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        own = [text[a:z].lower() for a, z in spans]
        begins = [a for a, _ in spans]
        found: dict[tuple[int, int, int], tuple] = {}
        for no, places in speaking(text, speaks).items():
            for j in sorted({max(0, bisect_right(begins, a) - 1) for a, _ in places} if own else ()):
                for k, known in enumerate(self.words):
                    reach = math.ceil((1 + MAX_DIFFERENCE) * len(known)) + 1
                    lo, hi = max(0, j - reach), min(len(own), j + reach + 1)
                    most = MAX_DIFFERENCE * len(known)
                    # Every word of the wording that the window lacks is a difference.
                    while known and lo <= j < hi and sum((self.counts[k] - Counter(own[lo:hi])).values()) <= most:
                        same = [b for b in difflib.SequenceMatcher(None, known, own[lo:hi], autojunk=False).get_matching_blocks() if b.size]
                        if not same:
                            break
                        a, z = lo + same[0].b, lo + same[-1].b + same[-1].size
                        if z <= j:  # another copy before the speaking word, or behind it
                            lo = z
                        elif a > j:
                            hi = a
                        else:
                            # What stands in the place of the wording's own first and last words belongs to the block.
                            a, z = max(0, a - same[0].a), min(len(own), z + len(known) - same[-1].a - same[-1].size)
                            if (a, z, k) not in found:
                                block = text[spans[a][0]:spans[z - 1][1]]
                                n, changes = self.differences(block, k)
                                saved = 1 - len(self.shaped[k].compress(block.encode())) / len(self.plain.compress(block.encode()))
                                found[a, z, k] = (self.names[k], saved, n, changes, n <= most), block
                            got, block = found[a, z, k]
                            if got[-1]:
                                yield no + 1, got, block, len(known)
                            break

    def best(self, block: str) -> tuple[str, float, int, list[str], bool] | None:
        """The first wording, by saved size, that the words confirm; else the first."""
        first = None
        for saved, k in self.rank(block):
            if saved < MIN_REDUCTION:
                break
            n, changes = self.differences(block, k)
            found = (self.names[k], saved, n, changes, n <= MAX_DIFFERENCE * len(self.words[k]))
            if found[-1]:
                return found
            first = first or found
        return first


@functools.lru_cache(4)
def _scanner(wordings: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(wordings)


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("line_no", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("n_differences", pa.int32()),
    ("differences", pa.list_(pa.string())), ("confirmed", pa.bool_()), ("block", pa.string())])


def scan(docs: DataFrame, wordings: dict[str, str] | None = None, speaks: str = SPEAKS) -> DataFrame:
    """The best wording of every block that speaks of licences.

    In: doc_id, text (more columns are ignored). Out: doc_id, line_no, license, reduction,
    n_differences, differences, confirmed, block: one row per speaking line, with the line or the
    paragraph that begins there, whichever is confirmed with the larger reduction (of equals the line),
    or the stretch around a speaking word of the line where a wording is confirmed, if neither is
    confirmed, that wording has more words, or as many and fewer differences.
    ``license`` is null where no wording saves enough. Null and empty texts and texts that do not
    speak of licences give no rows; repeated rows are scanned each; a null doc_id stays null.
    """
    ship(docs.sparkSession)
    known = tuple(sorted((wordings if wordings is not None else WORDINGS).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, pattern = _scanner(known), re.compile(speaks)
        for b in slices(batches, "text"):
            rows: dict[str, list] = {f.name: [] for f in _FOUND}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                best: dict[int, tuple] = {}
                for line, block in blocks(text, pattern, scanner.longest):
                    got = scanner.best(block) or (None, None, None, None, False)
                    rank = (got[4], got[1] or 0.0)
                    if line not in best or rank > best[line][0]:
                        best[line] = (rank, got, block)
                size = {line: scanner.sizes[got[0]] if got[4] else 0 for line, (_, got, _) in best.items()}
                for line, got, block, n in scanner.around(text, pattern):
                    if n > size[line] or n == size[line] and got[2] < best[line][1][2]:
                        best[line], size[line] = ((got[4], got[1]), got, block), n
                for line, (_, got, block) in best.items():
                    for name, value in zip(_FOUND.names, (doc, line, *got, block)):
                        rows[name].append(value)
            yield batch(_FOUND, **rows)

    return docs.filter(F.col("text").rlike(speaks)).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, line_no int, license string, reduction double, n_differences int, differences array<string>, confirmed boolean, block string")
