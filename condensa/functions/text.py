"""Scalar helpers on text and bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def octets(c: Column) -> Column:
    """Bytes of a string in UTF-8."""
    return F.octet_length(c)


def byte_prefix(c: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes that ends on a character boundary."""
    raw = c.cast("binary")
    cut = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(limit, max(limit - 4, -1), -1)]
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*cut, F.lit("")))


def escape_binary(c: Column) -> Column:
    """Bytes as text: \\n stays, \\r and \\t are named, printable ASCII stays, any other byte is \\xNN.

    The bytes are read as Latin-1, one character each; only the characters that don't stay are looked at one by one.
    """
    text = F.decode(c, "ISO-8859-1")
    kept = F.split(text, r"[^\n\x20-\x7E]", -1)
    odd = F.regexp_extract_all(text, F.lit(r"[^\n\x20-\x7E]"), F.lit(0))
    named = F.transform(odd, lambda x: F.when(x == "\r", "\\r").when(x == "\t", "\\t").otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(F.encode(x, "ISO-8859-1"))))))
    return F.array_join(F.zip_with(kept, F.concat(named, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def bounded_chars(c: Column, most: int) -> Column:
    """At most so many characters."""
    return F.substring(c, 1, most)


def valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c.cast("string"))


def base64_canonical(c: Column) -> Column:
    """Decoded bytes of canonical base64, else null."""
    out = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.replace(F.base64(out), F.lit("\r\n"), F.lit("")) == c, out)  # base64() breaks lines of 76 characters


def is_identifier(c: Column, most: int = 128) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]+\z") & (F.octet_length(c) <= most)


def is_artifact_id(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{32}\z")


def basis_points(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 10000 / whole)).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def section_depth(sections: Column) -> Column:
    """How many lines of each section may be candidates when there are so many sections."""
    return F.greatest(F.floor(F.lit(256) / F.greatest(sections, F.lit(1))), F.lit(1)).cast("long")


def focus_terms(c: Column) -> Column:
    """Distinct words of two characters or more, ASCII letters in lower case, the first sixteen."""
    words = F.filter(F.split(c, r"[^\p{L}\p{N}\p{M}_]+"), lambda w: F.char_length(w) >= 2)
    return F.slice(F.array_distinct(F.transform(words, lambda w: F.translate(w, P.UPPER, P.LOWER))), 1, 16)


def template_key(c: Column, most: int = 32) -> Column:
    """The first words of a line between ASCII white space, `*` for those with a digit: what lines of one template share."""
    words = F.slice(F.filter(F.split(c, "[ \\t\\n\\f\\r]+"), lambda w: w != ""), 1, most)
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), "*").otherwise(w))


_QUOTE = "'\"'\"'"
_ARGUMENT = f"'[^']*(?:{_QUOTE}[^']*)*'"


def shell_quote(c: Column) -> Column:
    """A word in single quotes; a quote inside it is closed, quoted and opened again."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit(_QUOTE)), F.lit("'"))


def shell_words(c: Column) -> Column:
    """The words of a command line that is exactly quoted words with one space between; null for any other."""
    words = F.transform(F.regexp_extract_all(c, F.lit(_ARGUMENT), F.lit(0)), lambda w: F.replace(F.substr(w, F.lit(2), F.length(w) - 2), F.lit(_QUOTE), F.lit("'")))
    return F.when(c == "", F.array().cast("array<string>")).when(c.rlike(f"^{_ARGUMENT}(?: {_ARGUMENT})*\\z"), words)
