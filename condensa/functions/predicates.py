"""Line predicates as Columns (JVM side, no Python) and as Python functions over the same patterns.

A Line offers the forms of one line that predicates look at. Columns are built from expressions only, so they stay in
whole-stage code generation and filters on them are ordinary filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: The characters of P.WS.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if P.python(f"[{P.WS}]").match(c))


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a balanced tree."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) & ~1 :]
    return conditions[0]


def starts(c: Column, words: tuple) -> Column:
    """Whether a text starts with one of these words: one pattern, tried on as many characters as the longest has."""
    return F.substring(c, 1, max(map(len, words))).rlike(f"(?s)^(?:{P.either(words)})")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, P.UPPER, P.LOWER)


def trim(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.trim(c, F.lit(_BLANK))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(_BLANK))


def body(c: Column) -> Column:
    """A line without its line end, carriage returns included."""
    return F.rtrim(c, F.lit("\r\n"))


class Line:
    """Predicates of one line column; `c` may end in a line end."""

    def __init__(self, c: Column):
        self.raw = body(c)
        self.trimmed = trim(c)
        self.text = ascii_lower(self.trimmed)

    def lowered(self, name: str) -> Column:
        return self.text.rlike(P.LOWERED[name])

    @property
    def loud(self) -> Column:
        """False where no pattern of LOWERED but library_path, assignment and code_keyword can hold: most lines of prose.

        Plain comparisons that spare such lines the patterns; whatever it lets through is still matched.
        """
        t = self.text
        return _any([starts(t, P.STARTS), F.substring(t, 1, 1).between("0", "9"), t.endswith(": test"), *(t.contains(w) for w in P.INSIDE)])

    def outcome(self, words: tuple) -> Column:
        """Three dots and one of these words at the end."""
        return self.text.rlike(f"(?s){P.outcome(words)}")

    def short_diagnostic(self, word: str) -> Column:
        mark = f": {word}"
        placed = F.concat(F.substring_index(self.text, mark, 1), F.lit(":")).rlike(P.PLACED)
        return self.text.contains(mark) & placed

    def _diagnostic(self, word: str) -> Column:
        return self.lowered(f"{word}_prefixed") | self.short_diagnostic(word)

    @property
    def error_diagnostic(self) -> Column:
        return self._diagnostic("error")

    @property
    def warning_diagnostic(self) -> Column:
        return self._diagnostic("warning")

    @property
    def severity(self) -> Column:
        """"error", "warning" or null: the first level word among the first three words."""
        words = F.slice(F.split(self.text, f"[{P.WS}]+"), 1, P.SEVERITY_TOKENS)
        bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[\[\]:()]+|[\[\]:()]+\z", ""))
        levels = F.transform(bare, lambda w: F.when(w.isin(*P.SEVERITY_ERROR), "error").when(w.isin(*P.SEVERITY_WARNING), "warning"))
        return F.when(_any([self.text.contains(x) for x in P.LEVELS]), F.get(F.filter(levels, lambda x: x.isNotNull()), F.lit(0)))

    @property
    def diff_header(self) -> Column:
        return self.raw.rlike(P.RAW["diff_header"])

    @property
    def diff_change(self) -> Column:
        return self.raw.rlike(P.RAW["diff_change"])

    @property
    def hunk_header(self) -> Column:
        return self.raw.rlike(P.RAW["hunk_header"])

    @property
    def path_header(self) -> Column:
        return F.substring(self.trimmed, -1, 1).isin(*"0123456789:") & self.trimmed.rlike(P.TRIMMED["path_header"])

    @property
    def code(self) -> Column:
        return F.substring(self.trimmed, -1, 1).isin(*P.CODE_ENDS) | starts(self.text, P.CODE_KEYWORDS) | (self.text.contains("=") & self.lowered("assignment"))

    def _indent(self) -> tuple[Column, Column]:
        rest = trim_start(self.raw)
        return F.octet_length(self.raw) - F.octet_length(rest), rest

    @property
    def json_skeleton(self) -> Column:
        indent, rest = self._indent()
        return (indent <= P.JSON_INDENT) & (F.octet_length(rest) <= P.JSON_BYTES) & F.substring(self.text, 1, 1).isin("{", "[", "}", "]", '"') & self.lowered("json_structural")

    @property
    def declaration(self) -> Column:
        indent, rest = self._indent()
        return (indent <= P.DECLARATION_INDENT) & starts(ascii_lower(rest), P.DECLARATION_KEYWORDS)

    @property
    def opens_section(self) -> Column:
        return self.hunk_header | self.raw.startswith("diff --git ")

    def classify(self, shape: Column) -> Column:
        """2 mandatory, 1 preferred, 0 ordinary, by the shape of the document."""
        classes = self.classes()
        return F.coalesce(*(F.when(shape == k, c) for k, c in classes.items() if k != "terminal-log"), classes["terminal-log"])

    def classes(self, loud: Column | None = None, severe: Column | None = None) -> dict[str, Column]:
        """The class under each shape; `loud` and `severe` where they are columns already."""
        loud, severe = self.loud if loud is None else loud, self.severity if severe is None else severe
        lint = F.when((loud & self.error_diagnostic) | F.coalesce(severe == "error", F.lit(False)), 2).when((loud & (self.warning_diagnostic | self.lowered("diagnostic_detail"))) | F.coalesce(severe == "warning", F.lit(False)), 1).otherwise(0)
        flag = lambda c: F.when(c, 1).otherwise(0)
        marked = F.substring(self.raw, 1, 1).isin("@", "+", "-", "d", "i")
        return {
            "build-output": lint,
            "typecheck-lint": lint,
            "test-output": F.when(loud & self.lowered("test_failure"), 2).when(loud & self.lowered("test_summary"), 1).otherwise(0),
            "stack-trace": F.when(loud & self.lowered("exception_header"), 2).when(loud & self.lowered("frame") & ~self.lowered("library_path"), 1).otherwise(0),
            "unified-diff": flag(marked & (self.diff_header | self.hunk_header | self.diff_change)),
            "api-json": flag(self.json_skeleton),
            "source-file": flag(self.declaration),
            "terminal-log": flag(severe.isNotNull()),
        }


# ---------------------------------------------------------------- the same in Python, for the kernel

_WORDS = {**dict.fromkeys(P.SEVERITY_ERROR, "error"), **dict.fromkeys(P.SEVERITY_WARNING, "warning")}
_CODE_ENDS, _PLACE_ENDS = frozenset(P.CODE_ENDS), frozenset("0123456789:")


def lower_ascii(text: str) -> str:
    """ASCII letters in lower case, all else as it is: what bytes.lower() does."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class PyLine:
    """The predicates of Line on one str."""

    def __init__(self, line: str):
        self.raw = line.rstrip("\r\n")
        self.trimmed = line.strip(_BLANK)
        self.text = text = lower_ascii(self.trimmed)
        #: Whether no pattern of LOWERED but library_path, assignment and code_keyword can hold: most lines of prose.
        self.quiet = not (text.startswith(P.STARTS) or text[:1].isdigit() or text.endswith(": test") or any(w in text for w in P.INSIDE))

    def lowered(self, name: str) -> bool:
        return P.python(P.LOWERED[name]).search(self.text) is not None

    def rawly(self, name: str) -> bool:
        return P.python(P.RAW[name]).search(self.raw) is not None

    def diagnostic(self, word: str) -> bool:
        mark = f": {word}"
        head, found, _ = self.text.partition(mark)
        return self.lowered(f"{word}_prefixed") or (bool(found) and P.python(P.PLACED).search(head + ":") is not None)

    @property
    def severity(self) -> str | None:
        if not any(x in self.text for x in P.LEVELS):
            return None
        for word in P.python(f"[{P.WS}]+").split(self.text, P.SEVERITY_TOKENS)[: P.SEVERITY_TOKENS]:
            if level := _WORDS.get(word.strip("[]:()")):
                return level
        return None

    @property
    def path_header(self) -> bool:
        return self.trimmed[-1:] in _PLACE_ENDS and P.python(P.TRIMMED["path_header"]).search(self.trimmed) is not None

    @property
    def code(self) -> bool:
        return self.trimmed[-1:] in _CODE_ENDS or self.text.startswith(P.CODE_KEYWORDS) or ("=" in self.text and self.lowered("assignment"))

    def _indent(self) -> tuple[int, str]:
        rest = self.raw.lstrip(_BLANK)
        return len(self.raw.encode("utf-8", "surrogatepass")) - len(rest.encode("utf-8", "surrogatepass")), rest

    @property
    def json_skeleton(self) -> bool:
        indent, rest = self._indent()
        return indent <= P.JSON_INDENT and len(rest.encode("utf-8", "surrogatepass")) <= P.JSON_BYTES and self.lowered("json_structural")

    @property
    def declaration(self) -> bool:
        indent, rest = self._indent()
        return indent <= P.DECLARATION_INDENT and P.python(P.DECLARATION).search(lower_ascii(rest)) is not None

    @property
    def opens_section(self) -> bool:
        return self.rawly("hunk_header") or self.raw.startswith("diff --git ")

    def classify(self, shape: str) -> int:
        if shape in ("build-output", "typecheck-lint"):
            told = not self.quiet
            if (told and self.diagnostic("error")) or self.severity == "error":
                return 2
            return int((told and (self.diagnostic("warning") or self.lowered("diagnostic_detail"))) or self.severity == "warning")
        if self.quiet and shape in ("test-output", "stack-trace"):
            return 0
        if shape == "test-output":
            return 2 if self.lowered("test_failure") else int(self.lowered("test_summary"))
        if shape == "stack-trace":
            return 2 if self.lowered("exception_header") else int(self.lowered("frame") and not self.lowered("library_path"))
        if shape == "unified-diff":
            return int(self.rawly("diff_header") or self.rawly("hunk_header") or self.rawly("diff_change"))
        if shape == "api-json":
            return int(self.json_skeleton)
        if shape == "source-file":
            return int(self.declaration)
        return int(self.severity is not None)
