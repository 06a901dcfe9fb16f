"""The distillers' state machines as plain loops over one log, for comparison."""

import re


def gradle_note(lines):
    inside, out = False, []
    for no, raw in enumerate(lines, 1):
        t = raw.rstrip()
        if re.match(r"BUILD (SUCCESSFUL|FAILED)|FAILURE:|\*\s*Try:$", t):
            inside = False
        elif re.match(r"\*\s*What went wrong:$", t):
            inside = True
        elif inside and t:
            out.append((no, t.strip()))
    return out


def npm_errors(lines):
    inside, out = False, []
    for no, raw in enumerate(lines, 1):
        t = raw.rstrip()
        m = re.match(r"npm\s+(?:ERR!|error)\s*(.*)$", t, re.I)
        if not t:
            inside = False
        elif m:
            inside = True
            if m.group(1).strip():
                out.append((no, m.group(1).strip()))
        elif inside and raw[:1].isspace():
            out.append((no, t.strip()))
    return out


def jest_blocks(lines):
    """(block, suite) and (block, detail line) of failing suites."""
    titles, details, suite, block, over = [], [], None, None, False
    for no, t in enumerate(lines, 1):
        if t.startswith("Summary of all failing tests"):
            over, block = True, None
        elif re.match(r"(Test Suites|Tests|Time):", t):
            continue
        elif m := re.match(r"(PASS|FAIL)\s+(\S+)", t):
            suite, block = (m.group(2) if m.group(1) == "FAIL" else None), None
        elif over or suite is None:
            continue
        elif re.match(r"\s*●\s+.", t):
            block = no
            titles.append((no, suite))
        elif block and t.strip():
            details.append((block, no))
    return titles, details


def pytest_sections(lines):
    section, out = "prelude", []
    heads = [(r"=+\s*FAILURES\s*=+", "failures"), (r"=+\s*ERRORS\s*=+", "errors"),
             (r"=+\s*short test summary info\s*=+", "short_summary"), (r"=+.*\d+\s+(passed|failed|error).*=+", "tail")]
    for no, t in enumerate(lines, 1):
        new = next((name for pattern, name in heads if re.match(pattern, t)), None)
        if new is None and section != "prelude" and re.match(r"=+\s*\S.*=+\s*$", t):
            new = "tail"
        if new:
            section = new
        else:
            out.append((no, section))
    return out


def trimmed(texts, cap):
    """A block's lines: single inner blanks only, middle cut."""
    kept = []
    for t in texts:
        if t.strip() or (kept and kept[-1].strip()):
            kept.append(t)
    while kept and not kept[-1].strip():
        kept.pop()
    if len(kept) <= cap:
        return kept
    head, tail = int(cap * 0.6), int(cap * 0.4)
    return kept[:head] + [f"… [{len(kept) - head - tail} lines omitted] …"] + kept[len(kept) - tail:]


def junit_blocks(lines):
    out, block = [], None
    for no, t in enumerate(lines, 1):
        if m := re.match(r"\S+\.\S+\s+>\s+.+?\s+(PASSED|FAILED|SKIPPED)\s*$", t):
            block = no if m.group(1) == "FAILED" else None
        elif re.match(r"\d+\s+tests?\s+completed", t) or not t.strip():
            block = None
        elif block and not re.match(r"\s*at\s+(org\.junit|java\.base/jdk\.internal)\.", t):
            out.append((block, no))
    return out


def merged(lines):
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j] == lines[i]:
            j += 1
        out.append(lines[i])
        if j - i > 1:
            out.append(f"  … (repeated {j - i}×)")
        i = j
    return out


def packed(costs, budget):
    """Indices of (cost, outline cost) that fit."""
    spent, out = 300, []
    for i, (cost, outline_cost) in enumerate(costs):
        if cost > budget // 2:
            spent += outline_cost
        elif spent + cost > budget:
            break
        else:
            spent += cost
        out.append(i)
    return out
