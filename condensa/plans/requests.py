"""Requests as rows: staged decoding, then validation in order of precedence.

A request is one JSON object a line. Decoding is staged so that a failure keeps what was already known: first the
request id, then the version, then the kind of source, then every field strictly (no unknown key, none missing).
All of it is expressions over parsed structs; no row raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import base64_canonical, is_artifact_id, is_identifier

# ---- Fixed values ----------------------------------------------------------------------------------------------
VERSIONS = ("v2", "v3")
CURRENT = "v3"
KINDS = ("inline", "file", "process", "artifact")
BINARY_POLICIES = ("accept", "reject")
UNITS = ("bytes", "tokens")
TOKEN_PROFILE = "cl100k_base@js-tiktoken-1.0.15"
LINE_BYTES, SOURCE_BYTES = 16 << 20, 10 << 20
IDENTIFIER_BYTES, PATH_BYTES, FOCUS_BYTES = 128, 4096, 256
ARGUMENTS, ARGUMENT_BYTES, EXECUTABLE_BYTES = 4096, 1 << 20, 4096
TIMEOUT_MS, DEFAULT_TIMEOUT_MS = (100, 300_000), 30_000
PATTERN_BYTES, CONTEXT_LINES, MATCHES = 512, 16, 32
DEFAULT_CONTEXT, DEFAULT_MATCHES = 2, 8
#: Fields of a tool call that say what it is about, in the order they are joined.
FOCUS_FIELDS = ("command", "file_path", "path", "pattern", "query")
# ----------------------------------------------------------------------------------------------------------------

ARTIFACT = "struct<schema_version: string, id: string, source_sha256: string, source_bytes: long, created_at: long, expires_at: long>"
SELECTOR = "struct<kind: string, start_line: long, line_count: long, pattern: string, before_lines: long, after_lines: long, max_matches: long>"
SOURCE = (
    "struct<kind: string, bytes: string, media_type: string, root_id: string, relative_path: string, binary_policy: string, executable: string, argv: array<string>, "
    f"cwd_root_id: string, cwd_relative_path: string, timeout_ms: long, environment_profile: string, artifact: {ARTIFACT}, selector: {SELECTOR}>"
)
REQUEST = (
    f"contract_version string, request_id string, source {SOURCE}, budget struct<unit: string, total_visible_limit: long, reserved_envelope: long, token_profile: string>, "
    "preservation_profile string, retention struct<expires_at: long, ttl_seconds: long>, focus string"
)
_ARTIFACT_FIELDS = {"schema_version": "STRING", "id": "STRING", "source_sha256": "STRING", "source_bytes": "BIGINT", "created_at": "BIGINT", "expires_at": "BIGINT"}
#: By place in the request: kinds of values that must be there, and of those that may be missing or null.
FIELDS = {
    "$": ({"contract_version": "STRING", "request_id": "STRING", "source": "OBJECT", "budget": "OBJECT", "preservation_profile": "STRING"}, {"retention": "OBJECT", "focus": "STRING"}),
    "$.budget": ({"unit": "STRING", "total_visible_limit": "BIGINT", "reserved_envelope": "BIGINT"}, {"token_profile": "STRING"}),
    "$.retention": ({}, {"expires_at": "BIGINT", "ttl_seconds": "BIGINT"}),
    "$.source.artifact": (_ARTIFACT_FIELDS, {}),
}
SOURCE_FIELDS = {
    "inline": ({"kind": "STRING", "bytes": "STRING"}, {"media_type": "STRING"}),
    "file": ({"kind": "STRING", "root_id": "STRING", "relative_path": "STRING", "binary_policy": "STRING"}, {}),
    "process": ({"kind": "STRING", "executable": "STRING", "argv": "ARRAY", "cwd_root_id": "STRING", "cwd_relative_path": "STRING"}, {"timeout_ms": "BIGINT", "environment_profile": "STRING"}),
    "artifact": ({"kind": "STRING", "artifact": "OBJECT"}, {"selector": "OBJECT"}),
}
SELECTOR_FIELDS = {
    "lines": ({"kind": "STRING", "start_line": "BIGINT", "line_count": "BIGINT"}, {}),
    "pattern": ({"kind": "STRING", "pattern": "STRING"}, {"before_lines": "BIGINT", "after_lines": "BIGINT", "max_matches": "BIGINT"}),
}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _kind(value: Column, path: str) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY, ... of the value at a path, VOID for null; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def _keys(value: Column, path: str) -> Column:
    """What the object at a path holds, as "key:KIND"; null where there is no object. Worked out once for all rules of the place."""
    held = F.map_entries(F.try_variant_get(value, path, "map<string, variant>"))
    return F.transform(held, lambda e: F.concat(e["key"], F.lit(":"), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0)))


def _shaped(keys: Column, fields: tuple[dict, dict]) -> Column:
    """Whether an object (by `_keys`) has every required key, none that isn't known, and values of the right kinds."""
    required, optional = fields
    needed = [f"{name}:{kind}" for name, kind in required.items()]
    known = [*needed, *(f"{name}:{k}" for name, kind in optional.items() for k in (kind, "VOID"))]
    ok = F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0
    if needed:
        ok &= F.size(F.array_intersect(keys, F.array(*map(F.lit, needed)))) == len(needed)
    return _yes(ok)


#: Places whose keys are checked.
_PLACES = ("$", "$.budget", "$.retention", "$.source", "$.source.artifact", "$.source.selector")


def decoded(lines: DataFrame, column: str = "value", keep: tuple = ()) -> DataFrame:
    """`keep`, request (struct of REQUEST), request_id (where one could be read) and failure (null: decoded).

    Failures come in this order: input_too_large, invalid_request (no JSON object, or an id that is no text),
    schema_unsupported, source_unsupported, invalid_request (unknown, repeated or missing key, or a value of the wrong
    kind: numbers are whole and not negative, bytes are canonical base64).
    """
    # Generated rows, as no filter on what is told of a request is pushed below them: each line is parsed once.
    parsed = F.struct(F.try_parse_json("_text").alias("_v"), F.from_json("_text", REQUEST).alias("request"))
    value, request = F.col("_v"), F.col("request")
    rows = lines.select(*keep, F.col(column).alias("_text")).select(*keep, "_text", F.inline(F.array(parsed)))
    said = lambda path: F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))
    told = F.struct(*(_keys(value, p).alias(f"_at{i}") for i, p in enumerate(_PLACES)), *(said(p).alias(n) for n, p in (("_version", "$.contract_version"), ("_kind", "$.source.kind"), ("_id", "$.request_id"), ("_selector", "$.source.selector.kind"))))
    rows = rows.select(*keep, "_text", "_v", "request", F.inline(F.array(told)))
    keys = {p: F.col(f"_at{i}") for i, p in enumerate(_PLACES)}
    version, kind, id_ = F.col("_version"), F.col("_kind"), F.col("_id")
    object_ = _yes(F.schema_of_variant(value).startswith("OBJECT"))
    absent = lambda path, *kinds: F.coalesce(_kind(value, path).isin(*kinds, "VOID", ""), F.lit(True))
    probed = absent("$.contract_version", "STRING") & absent("$.source", "OBJECT") & absent("$.source.kind", "STRING")
    named = F.when(F.octet_length(id_).between(1, IDENTIFIER_BYTES), id_)
    source, selector = request["source"], request["source"]["selector"]
    strict = _shaped(keys["$"], FIELDS["$"]) & _shaped(keys["$.budget"], FIELDS["$.budget"])
    strict &= absent("$.retention") | _shaped(keys["$.retention"], FIELDS["$.retention"])
    of_kind = F.lit(False)
    for k, fields in SOURCE_FIELDS.items():
        of_kind |= _yes(kind == k) & _shaped(keys["$.source"], fields)
    strict &= of_kind & (_yes(kind != "artifact") | _shaped(keys["$.source.artifact"], FIELDS["$.source.artifact"]))
    selected = F.lit(False)
    for k, fields in SELECTOR_FIELDS.items():
        selected |= _yes(F.col("_selector") == k) & _shaped(keys["$.source.selector"], fields)
    strict &= absent("$.source.selector") | selected
    for c in (*(source[c] for c in ("bytes", "relative_path", "executable", "cwd_relative_path")), selector["pattern"]):
        strict &= c.isNull() | base64_canonical(c).isNotNull()
    strict &= source["argv"].isNull() | (_yes(F.schema_of_variant(F.try_variant_get(value, "$.source.argv", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>")) & F.forall(source["argv"], lambda x: base64_canonical(x).isNotNull()))
    strict &= _yes(request["budget"]["unit"].isin(*UNITS)) & (source["binary_policy"].isNull() | source["binary_policy"].isin(*BINARY_POLICIES))
    numbers = [request["budget"][c] for c in ("total_visible_limit", "reserved_envelope")] + [request["retention"][c] for c in ("expires_at", "ttl_seconds")] + [source["timeout_ms"]]
    numbers += [source["artifact"][c] for c in ("source_bytes", "created_at", "expires_at")] + [selector[c] for c in ("start_line", "line_count", "before_lines", "after_lines", "max_matches")]
    for n in numbers:
        strict &= F.coalesce(n >= 0, F.lit(True))
    failure = (
        F.when(F.octet_length("_text") > LINE_BYTES, "input_too_large")
        .when(~object_ | ~absent("$.request_id", "STRING") | ~probed, "invalid_request")
        .when(_yes(~version.isin(*VERSIONS)), "schema_unsupported")
        .when(_yes(~kind.isin(*KINDS)), "source_unsupported")
        .when(~strict, "invalid_request")
    )
    return rows.select(*keep, "request", named.alias("request_id"), failure.alias("failure"))


def selector_failure(selector: Column) -> Column:
    """What is wrong with an artifact selector's bounds, else null."""
    before, after = (F.coalesce(selector[c], F.lit(DEFAULT_CONTEXT)) for c in ("before_lines", "after_lines"))
    matches, raw = F.coalesce(selector["max_matches"], F.lit(DEFAULT_MATCHES)), base64_canonical(selector["pattern"])
    lines = (selector["start_line"] >= 1) & (selector["line_count"] >= 1)
    found = F.octet_length(raw).between(1, PATTERN_BYTES) & F.is_valid_utf8(raw.cast("string")) & (before <= CONTEXT_LINES) & (after <= CONTEXT_LINES) & matches.between(1, MATCHES)
    return F.when(selector.isNotNull() & ~_yes(F.when(selector["kind"] == "lines", lines).otherwise(found)), "invalid_request")


def _nul(x: Column) -> Column:
    """Whether binary holds a zero byte."""
    return F.contains(x, F.lit(b"\0"))


def process_failure(executable: Column, argv: Column, timeout_ms: Column) -> Column:
    """What is wrong with a process's bounds, else null; `executable` and the items of `argv` are binary."""
    size = F.octet_length(executable) + F.aggregate(argv, F.lit(0), lambda a, x: a + F.octet_length(x))
    return (
        F.when((F.size(argv) > ARGUMENTS) | (size > ARGUMENT_BYTES), "resource_exhausted")
        .when(~F.octet_length(executable).between(1, EXECUTABLE_BYTES) | _nul(executable) | F.exists(argv, _nul), "invalid_request")
        .when(~F.coalesce(timeout_ms, F.lit(DEFAULT_TIMEOUT_MS)).between(*TIMEOUT_MS), "invalid_request")
    )


def _source_failure(source: Column, version: Column, roots: tuple, profiles: tuple) -> Column:
    path = lambda c: F.coalesce(base64_canonical(source[c]), F.lit(b""))
    bad_path = lambda c: (F.octet_length(path(c)) > PATH_BYTES) | _nul(path(c))
    known = lambda c: _yes(source[c].isin(*roots)) if roots else F.lit(False)
    profile = source["environment_profile"]
    argv = F.transform(source["argv"], lambda x: base64_canonical(x))
    process = F.coalesce(
        process_failure(base64_canonical(source["executable"]), argv, source["timeout_ms"]),
        F.when(~_yes(is_identifier(source["cwd_root_id"])) | bad_path("cwd_relative_path"), "invalid_request").when(~known("cwd_root_id"), "unsafe_root")
        .when(profile.isNotNull() & ~(profile.isin(*profiles) if profiles else F.lit(False)), "invalid_request"),
    )
    artifact = F.coalesce(
        F.when(~_yes(is_artifact_id(source["artifact"]["id"])) | ~_yes(source["artifact"]["source_sha256"].rlike(r"^[0-9a-f]{64}\z")), "invalid_request")
        .when(source["selector"].isNotNull() & (version != CURRENT), "schema_unsupported"),
        selector_failure(source["selector"]),
    )
    return (
        F.when(source["kind"] == "inline", F.when(F.octet_length(base64_canonical(source["bytes"])) > SOURCE_BYTES, "input_too_large"))
        .when(source["kind"] == "file", F.when(~_yes(is_identifier(source["root_id"])) | bad_path("relative_path"), "invalid_request").when(~known("root_id"), "unsafe_root"))
        .when(source["kind"] == "process", process)
        .otherwise(artifact)
    )


def retention_failure(retention: Column) -> Column:
    both = retention["expires_at"].isNotNull() & retention["ttl_seconds"].isNotNull()
    return F.when(_yes(both | (retention["ttl_seconds"] == 0)), "invalid_request")


def focus_failure(focus: Column, version: Column) -> Column:
    return F.when(focus.isNotNull(), F.when(version != CURRENT, "schema_unsupported").when(~F.octet_length(focus).between(1, FOCUS_BYTES), "invalid_request"))


def budget_failure(profile: Column, budget: Column) -> Column:
    unit, tokens = budget["unit"], budget["token_profile"]
    return (
        F.when(~_yes(profile.isin(*P.PROFILES)), "invalid_request")
        .when(budget["reserved_envelope"] > budget["total_visible_limit"], "invalid_request")
        .when((unit == "bytes") & tokens.isNotNull(), "invalid_request")
        .when((unit == "tokens") & ~_yes(tokens == TOKEN_PROFILE), "token_profile_unsupported")
    )


def failure(request: Column, now: int | None = None, roots: tuple = (), profiles: tuple = ()) -> Column:
    """The first rule a decoded request breaks: version, id, source, retention, focus, projection, and with `now` a past expiry."""
    version = request["contract_version"]
    first = (
        F.when(~_yes(version.isin(*VERSIONS)), "schema_unsupported")
        .when(~_yes(F.octet_length(request["request_id"]).between(1, IDENTIFIER_BYTES)), "invalid_request")
    )
    rest = [
        _source_failure(request["source"], version, roots, profiles), retention_failure(request["retention"]), focus_failure(request["focus"], version),
        budget_failure(request["preservation_profile"], request["budget"]),
    ]
    if now is not None:
        rest.append(F.when(_yes(request["retention"]["expires_at"] <= now), "invalid_request"))
    return F.coalesce(first, *rest)


def derived_focus(payload: Column) -> Column:
    """The text of a tool input that is a string, or its telling fields joined, cut to the focus's bound; null when blank."""
    from ..functions.predicates import trim
    from ..functions.text import byte_prefix

    fields = F.from_json(payload, ", ".join(f"{f} variant" for f in FOCUS_FIELDS))
    texts = [F.when(F.schema_of_variant(fields[f]) == "STRING", fields[f].cast("string")) for f in FOCUS_FIELDS]
    text = F.when(payload.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"x":'), payload, F.lit("}")), "$.x")).otherwise(F.concat_ws(" ", *texts))
    body = trim(text)
    return F.when(body != "", byte_prefix(body, FOCUS_BYTES))
