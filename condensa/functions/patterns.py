"""Word lists and patterns of the line predicates, written once for Spark, Python and SQL.

All patterns are searched, not matched whole; they use no look-around, `(?s)` throughout, and \\z for the end of the
text (python() rewrites that one). WS is the Unicode White_Space property.
"""

from __future__ import annotations

import re
from functools import lru_cache

WS = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# ---- Fixed values ----------------------------------------------------------------------------------------------
SEVERITY_ERROR = ("error", "errors", "err", "fatal", "failed", "failure", "panic", "panicked", "abort", "aborted")
SEVERITY_WARNING = ("warn", "warning", "warnings")
PROGRESS_VERBS = (
    "compiling", "checking", "fresh", "finished", "building", "built", "compiled", "downloading", "downloaded", "installing",
    "packaging", "bundled", "bundling", "updating", "removing", "generated",
)
LIBRARY_MARKERS = (
    "node_modules", "node:internal", "node:", "/rustc/", ".cargo/registry", "site-packages", "dist-packages", "/usr/lib",
    "<frozen", "library/std", "library/core", "library/alloc", "internal/",
)
DECLARATION_KEYWORDS = (
    "fn ", "pub ", "impl ", "struct ", "enum ", "trait ", "mod ", "type ", "const ", "static ", "use ", "class ", "def ",
    "function ", "export ", "import ", "interface ", "package ", "namespace ", "async fn", "#!",
)
CODE_KEYWORDS = (
    "fn ", "pub ", "use ", "let ", "const ", "var ", "impl ", "struct ", "enum ", "mod ", "import ", "export ", "function ",
    "class ", "def ", "return", "if ", "elif ", "else", "for ", "while ", "match ", "async ", "await ", "try", "catch", "throw ",
    "case ", "switch ", "type ", "trait ", "interface ", "package ", "namespace ", "local ", "echo ", "set -", "exit ", "then",
    "done", "fi", "esac", "do ", "cd ", "#[", "#!", "//", "/*", "* ", "*/", "@",
)
#: profile id -> shape; None is detection.
PROFILES = {
    "auto/v1": None,
    "build-output/v1": "build-output", "test-output/v1": "test-output", "typecheck-lint/v1": "typecheck-lint",
    "stack-trace/v1": "stack-trace", "unified-diff/v1": "unified-diff", "api-json/v1": "api-json",
    "source-file/v1": "source-file", "terminal-log/v1": "terminal-log",
    "plain-text/v1": "terminal-log", "build-log/v1": "build-output", "test-log/v1": "test-output", "diagnostic/v1": "typecheck-lint",
    "diff/v1": "unified-diff", "json/v1": "api-json", "source-code/v1": "source-file", "unicode/v1": "terminal-log",
    "binary/v1": "terminal-log", "untrusted-text/v1": "terminal-log", "none/v1": "terminal-log",
}
JSON_OPENERS, JSON_CLOSERS = ("{", "["), ("}", "]", "},", "],")
EXCEPTION_STARTS, EXCEPTION_ENDS = ("traceback (most recent call last)", "stack backtrace:", "uncaught "), ("error", "exception")
FAILURE_STARTS, FAILURE_OUTCOMES = ("not ok ", "(fail)", "failures:", "failed (", "assertionerror"), ("fail", "failed", "error")
SUMMARY_STARTS = ("test result:", "tap version", "# tests", "# pass", "# fail", "# subtest")
COUNTED_STARTS = ("running ", "ran ")
CASE_OUTCOMES = ("ok", "ignored", "skipped")
DETAIL_STARTS = ("--> ", "= help:", "= note:")
DIFF_STARTS = ("diff --git ", "--- ", "+++ ", "index ")
CODE_ENDS = "{};(),\\=:[]|"
PREFIX_BYTES, PREFIX_LINES = 65536, 512
JSON_INDENT, JSON_BYTES, DECLARATION_INDENT = 2, 120, 4
SEVERITY_TOKENS = 3
# ----------------------------------------------------------------------------------------------------------------

AGGREGATING = ("build-output", "test-output", "typecheck-lint", "stack-trace", "terminal-log")
DISTRIBUTING = ("unified-diff",)


def either(words) -> str:
    return "|".join(re.sub(r"([.\[\](){}*+?^$|\\/#])", r"\\\1", w) if not w.isalnum() else w for w in words)


def outcome(words) -> str:
    """Three dots and, as the last word, one of these."""
    return rf" \.\.\. (?:.* )?(?:{either(words)})\z"


#: On the line with Unicode white space trimmed and ASCII letters in lower case.
LOWERED = {
    "json_structural": rf'(?s)^(?:{either(JSON_OPENERS)}|(?:{either(JSON_CLOSERS)})\z|"(?:: |.*": ))',
    "frame": rf'(?s)^(?:at .*[^{WS}]|file ".*", line |[0-9]+: )',
    "library_path": f"(?s){either(LIBRARY_MARKERS)}",
    "exception_header": rf"(?s)^(?:{either(EXCEPTION_STARTS)}|thread .*panicked at|[a-z0-9_.]*(?:{either(EXCEPTION_ENDS)})(?:: |\z))",
    "test_failure": rf"(?s)^(?:{either(FAILURE_STARTS)}|test .*failed\z)|{outcome(FAILURE_OUTCOMES)}",
    "test_summary": rf"(?s)^(?:{either(SUMMARY_STARTS)}|(?:{either(COUNTED_STARTS)})(?:.* )?test|1\.\.[0-9]+\z)",
    "test_case": rf"(?s)^(?:\(pass\)|ok [0-9])|: test\z|{outcome(CASE_OUTCOMES)}",
    "diagnostic_detail": rf"(?s)^(?:{either(DETAIL_STARTS)})",
    "progress": f"(?s)^(?:{either(PROGRESS_VERBS)}) .",
    "error_prefixed": r"(?s)^error(?:\[[^\]]*\])?:",
    "warning_prefixed": r"(?s)^warning(?:\[[^\]]*\])?:",
    "assignment": rf'(?s)^[a-z0-9_.\[\]"]+[{WS}]*[()+:]*=(?:[^=]|\z)',
    "code_keyword": f"(?s)^(?:{either(CODE_KEYWORDS)})",
}
#: On the trimmed line, case kept.
TRIMMED = {"path_header": r"(?s)^[^: ]*\.[^: ]*(?::[0-9]+){1,2}:*\z", "code_end": rf"(?s)(?:{either(CODE_ENDS)})\z"}
#: On the line as it stands.
RAW = {
    "hunk_header": r"(?s)^@@ .*@@",
    "diff_header": rf"(?s)^(?:{either(DIFF_STARTS)}).*[^{WS}]",
    "diff_change": rf"(?s)^[+-].*[^{WS}]",
}
#: What a line begins with, in lower case, if any pattern above holds but those of words inside it, of `assignment` and of `code_keyword`.
STARTS = (
    *JSON_OPENERS, *JSON_CLOSERS, '"', "at ", 'file "', *EXCEPTION_STARTS, "thread ", *FAILURE_STARTS, "test ", *SUMMARY_STARTS, *COUNTED_STARTS, "1..", "(pass)", "ok ",
    *DETAIL_STARTS, *(f"{v} " for v in PROGRESS_VERBS), "error", "warning",
)
#: What a line holds somewhere if a pattern of words inside it holds.
INSIDE = (*EXCEPTION_ENDS, " ... ", ": error", ": warning")
#: What every level word holds.
LEVELS = ("err", "fatal", "fail", "panic", "abort", "warn")
#: On a line after its indent, in lower case.
DECLARATION = f"(?s)^(?:{either(DECLARATION_KEYWORDS)})"
TRIM = rf"^[{WS}]+|[{WS}]+\z"
TRIM_START = rf"^[{WS}]+"
PLACED = ":[0-9]+:"
LINE = "[^\n]*\n|[^\n]+"


@lru_cache(None)
def python(pattern: str) -> re.Pattern:
    """The pattern for Python's re."""
    return re.compile(pattern.replace(r"\z", r"\Z"))
