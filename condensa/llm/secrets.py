"""Secrets in texts by multipart credential linking, with DataFrame functions only.

Three kinds of span count by themselves: an assignment to a telling name, an access key and a long run of hex digits.
Others are weak: a login, an e-mail address, an opaque run of letters and digits, an endpoint. Each is a part of a
credential: access keys, logins and addresses identify, assignments, hex and opaque runs are secrets. A weak candidate is
reported only where the parts that it needs stand in its scope (text between blank lines) and in reach: an identifier
needs a secret, a secret an identifier, an endpoint both.

Spans are found inside each row, without a shuffle. The join of parts and scopes is a sweep over intervals: the parts and
blank lines of a text in order of their starts, with the nearest parts of each sort before and after by running maxima
and minima, so no pairs are made. Only texts that hold an identifier and a secret, one of them weak, take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 6
#: A match of so many characters or more begins where the longest run does, so the bound can be part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i)(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+/=-]{3,}"""
EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]++(?![A-Za-z0-9._%+@-])"
#: Also a lower-case letter, an upper-case one and a digit.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?<![A-Za-z])[A-Za-z]{1,16}+://[^\x00-\x20"'<>]++"""
BREAK = r"\n[\x20\t\r]*\n"
KINDS = ("assign", "access", "hex", "login", "email", "opaque", "endpoint")
BASE, IDENTIFIERS, SECRETS = {0, 1, 2}, {1, 3, 4}, {0, 2, 5}
_BREAK = len(KINDS)
#: Parts of one credential are so many code points apart at most.
REACH = 400
_CHUNK = 256
_PLACED = "array<struct<start:int,end:int,good:boolean>>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _steps(text: Column, matches: Column, pattern: str, good=lambda m: F.lit(True)) -> Column:
    """(gap, len, good) of every match: the code points before it since the last one, its own, and whether it counts.

    What lies between the matches is what a split at the pattern leaves.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    own = F.transform(matches, lambda m: F.struct(F.char_length(m).alias("len"), good(m).alias("good")))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), own.alias("own")), lambda x: x["own"].isNotNull())
    steps = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["own"]["len"].alias("len"), x["own"]["good"].alias("good")))
    return F.when(F.size(matches) > 0, steps)


def _placed(steps: Column) -> Column:
    """(start, end) of the matches that count: a running sum over the steps, in chunks, so that long lists aren't rebuilt at each step."""
    size = F.size(steps)
    last = lambda c: F.least(c * _CHUNK + (_CHUNK - 1), size - 1)
    chunk = lambda c: F.transform(F.sequence(c * _CHUNK, last(c)), lambda i: F.get(steps, i))  # noqa: E731  a slice would copy the whole list
    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / _CHUNK).cast("int")), chunk)
    none = F.array().cast(_PLACED)

    def add(held, x):
        start = held["at"] + x["gap"]
        here = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["good"].alias("good"))
        return F.struct((start + x["len"]).alias("at"), F.concat(held["done"], F.array(here)).alias("done"))

    def inside(held, chunk):
        inner = F.aggregate(chunk, F.struct(held["at"].alias("at"), none.alias("done")), add)
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(held["done"], F.array(r["done"])).alias("done"))), 1)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACED}>").alias("done"))
    whole = F.flatten(F.aggregate(chunks, start, inside)["done"])
    kept = F.transform(F.filter(whole, lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.coalesce(F.when(size > 0, kept), F.array().cast("array<struct<start:int,end:int>>"))


def _has(kinds: set[int], column: Column) -> Column:
    return column.isin(sorted(kinds))


def parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, found (array of start, kind, end) and linkable of every row: the base spans, and where the text is
    linkable also its weak candidates and blank lines. `kind` is a place in KINDS, or one beyond for a blank line."""
    text = F.col("text")
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    searched = {"m0": ASSIGN, "m1": ACCESS, "m2": HEX, "m3": LOGIN, "m4": EMAIL, "m5": OPAQUE}
    rows = rows.select("*", *(_matches(text, p).alias(name) for name, p in searched.items()))
    assigned = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGNED
    identified = (F.size("m1") > 0) | (F.size("m3") > 0) | (F.size("m4") > 0)
    secret = (F.size("m2") > 0) | F.exists("m0", assigned) | F.exists("m5", mixed)
    rows = rows.withColumn("linkable", identified & secret)
    late = {"m6": ENDPOINT, "m7": BREAK}
    none = F.array().cast("array<string>")
    rows = rows.select("*", *(F.when(F.col("linkable"), _matches(text, p)).otherwise(none).alias(name) for name, p in late.items()))
    good = {"m0": assigned, "m5": mixed}
    told = []
    for name, pattern in (searched | late).items():
        wanted = F.col(name) if name in ("m0", "m1", "m2") else F.when(F.col("linkable"), F.col(name)).otherwise(none)
        told.append(_steps(text, wanted, pattern, good.get(name, lambda m: F.lit(True))).alias(f"s{name[1:]}"))
    rows = rows.select("row", "doc_id", "linkable", *told)
    kinds = range(len(told))
    rows = rows.select("row", "doc_id", "linkable", *(_placed(F.col(f"s{k}")).alias(f"p{k}") for k in kinds))
    of_kind = lambda k: F.transform(F.col(f"p{k}"), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    return rows.select("row", "doc_id", F.concat(*map(of_kind, kinds)).alias("found"), "linkable")


def linked(found: DataFrame) -> DataFrame:
    """row, doc_id, found with the weak candidates that are parts of a credential, of the linkable rows of `parts`.

    A weak candidate that overlaps a base span is that span's text and isn't reported again.
    """
    each = found.select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*")
    by_row = Window.partitionBy("row").orderBy("start", "kind", "end")
    each = each.withColumn("scope", F.sum((F.col("kind") == _BREAK).cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("row", "scope").orderBy("start", "kind", "end")
    backward = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    # What follows is what precedes in the other order: a frame that grows is worked out once, one that shrinks for each row.
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (within, backward))

    def near(kinds: set[int], reach: int) -> Column:
        ended, begins = F.max(F.when(_has(kinds, F.col("kind")), F.col("end"))).over(before), F.min(F.when(_has(kinds, F.col("kind")), F.col("start"))).over(after)
        return F.coalesce(F.col("start") - ended <= reach, F.lit(False)) | F.coalesce(begins - F.col("end") <= reach, F.lit(False))

    kind = F.col("kind")
    each = each.select("*", near(IDENTIFIERS, REACH).alias("identified"), near(SECRETS, REACH).alias("secret"), near(BASE, -1).alias("covered"))
    known = F.when(_has(IDENTIFIERS, kind), F.col("secret")).when(_has(SECRETS, kind), F.col("identified")).otherwise(F.col("identified") & F.col("secret"))
    kept = each.where(_has(BASE, kind) | ((kind < _BREAK) & known & ~F.col("covered")))
    span = F.struct("start", "kind", "end")
    gathered = kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("found"))
    left = found.select("row", "doc_id").join(gathered.select("row", "found"), "row", "left")
    return left.select("row", "doc_id", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("found"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs (doc_id, text): array of (kind, start, end, base) by start, then kind.

    Offsets are code points, the end is exclusive; base tells spans that count by themselves from linked ones. Texts are
    read whole; null or empty text has no spans. Rows that repeat, and null ids, are each searched on their own. An empty
    table gives an empty table. Extra columns play no part.
    """
    found = staged(parts(docs), "secrets-parts")
    alone = found.where(~F.col("linkable")).select("row", "doc_id", F.sort_array("found").alias("found"))
    both = alone.unionByName(linked(found.where("linkable")))
    names = F.array(*map(F.lit, KINDS))
    span = lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _has(BASE, x["kind"]).alias("base"))
    return both.select("doc_id", F.transform("found", span).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, from the rows of `secrets`."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(told(F.filter("spans", lambda x: x["base"])).cast("binary"), 256)
    return found.select("doc_id", *map(count, KINDS[:3]), base.alias("base_sha256"), told(F.col("spans")).alias("spans"))
