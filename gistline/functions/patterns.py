"""Text patterns of the log formats and of the languages.

Every pattern uses only what Java regexes and RE2 share, so the same text runs in
Spark and in the DuckDB oracle. The exceptions are the word-bounded patterns: Java's
``\\b`` looks at Unicode letters, so Spark gets ASCII look-arounds instead.
"""

# Characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def word(body: str) -> str:
    """``body`` between ASCII word bounds, for Spark. Use only where ``body`` starts and ends with word characters."""
    return rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"


# Terminal escapes.
ANSI = (
    "[\u001b\u009b][\\[\\]()#;?]*"
    "(?:(?:(?:[a-zA-Z0-9]*(?:;[a-zA-Z0-9]*)*)?\u0007)"
    "|(?:(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-PR-TZcf-nq-uy=><~]))"
)

# Classification.
HEAD_JUNIT = r"[A-Za-z0-9_]\S*\.\S+\s+>\s+\S+\s+(?:PASSED|FAILED|SKIPPED)(?:[^A-Za-z0-9_]|\z)"
HEAD_PYTEST = r"=+\s*test session starts\s*=+"
HEAD_JEST_SUITE = r"(?m)^(?:PASS|FAIL)\s+"
HEAD_JEST_TOTAL = r"Test Suites:|Tests:"
HEAD_NPM = r"(?i)npm (?:ERR!|error|warn)"
HEAD_GRADLE = r"BUILD (?:SUCCESSFUL|FAILED)"
HEAD_JUNIT_LOOSE = r"[A-Za-z0-9_]>\s+\S+\s+(?:PASSED|FAILED|SKIPPED)(?:[^A-Za-z0-9_]|\z)"

# The words that mark a line of unclassified output as an error.
ERROR_WORDS = "error|fail|failed|failure|exception|fatal|panic"

# Build output.
KOTLIN = r"^([ew]):\s*(?:file://)?([^\s:]+):(\d+)(?::(\d+))?\s+(.*)\z"
JAVAC = r"^(.+?\.java):(\d+):\s*(error|warning):\s*(.*)\z"
TASK = r"^>\s*Task\s+(\S+)\s+FAILED\s*\z"
BUILD_RESULT = r"^BUILD (SUCCESSFUL|FAILED)(?:\s+in\s+(\S+))?"
FAILURE_HEADER = r"^FAILURE:"
WRONG_HEADER = r"^\*\s*What went wrong:\s*\z"
TRY_HEADER = r"^\*\s*Try:\s*\z"

# Package install output.
NPM_ERROR = r"(?i)^npm\s+(?:ERR!|error)\s*(.*)\z"
NPM_CODE = r"(?i)^code\s+"
NPM_DEPRECATED = r"(?i)^npm\s+warn\s+deprecated\s+(\S+):\s*(.*)\z"
NPM_WARN = r"(?i)^npm\s+warn\s+(.*)\z"
NPM_CHANGE = r"(?i)^(?:added|removed|changed|updated)\s+\d+\s+packages?"
NPM_AUDIT = r"(?i)^\d+\s+(?:vulnerabilit(?:y|ies)|low|moderate|high|critical)"
NPM_DEPRECATED_TEXT = r"(?i)^deprecated(?:[^A-Za-z0-9_]|\z)"

# JavaScript test output.
JEST_PASS = r"^PASS\s+(\S+)"
JEST_FAIL = r"^FAIL\s+(\S+)"
JEST_MARKER = r"^\s*●\s+(.+)\z"
JEST_SUITES = r"^Test Suites:\s*(.*)\z"
JEST_TESTS = r"^Tests:\s*(.*)\z"
JEST_TIME = r"^Time:\s*(.*)\z"
JEST_SUMMARY = r"^Summary of all failing tests(?:[^A-Za-z0-9_]|\z)"

# Python test output.
PYTEST_FAILURES = r"^=+\s*FAILURES\s*=+"
PYTEST_ERRORS = r"^=+\s*ERRORS\s*=+"
PYTEST_SHORT = r"^=+\s*short test summary info\s*=+"
PYTEST_FINAL = r"^=+\s*(?:\d+\s+passed|\d+\s+failed|.*\d+\s+(?:passed|failed|error))"
PYTEST_RULED = r"=+.*=+"
PYTEST_OTHER = r"^=+\s*\S.*=+\s*\z"
PYTEST_PLATFORM = r"^platform\s+"

# JVM test output.
JUNIT_RESULT = r"^(\S+\.\S+)\s+>\s+(.+?)\s+(PASSED|FAILED|SKIPPED)\s*\z"
JUNIT_TOTALS = r"(?i)^(\d+)\s+tests?\s+completed(?:,\s*(\d+)\s+failed)?(?:,\s*(\d+)\s+skipped)?"
# Packages whose stack frames belong to the test framework or the runtime.
JUNIT_FRAMEWORK = [
    "org.junit.",
    "org.testng.",
    "org.gradle.",
    "sun.reflect.",
    "java.lang.reflect.",
    "java.base/jdk.internal.",
    "java.base/java.lang.reflect.",
    "jdk.internal.",
    "kotlin.reflect.",
    "kotlinx.coroutines.internal.",
    "android.os.",
    "androidx.test.internal.",
]
