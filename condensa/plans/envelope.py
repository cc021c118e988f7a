"""Results as JSON: projections, failures, and what a host's hook is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import saturating_sub
from .codes import keeps_artifact

# ---- Fixed values ----------------------------------------------------------------------------------------------
MESSAGE_CHARS, DIAGNOSTIC_CHARS = 512, 256
# ----------------------------------------------------------------------------------------------------------------
#: Names of this engine's formats.
SCHEMA, RECEIPT_SCHEMA, PROJECTION_VERSION, POLICY_VERSION, RESULT_SCHEMA = "projection/v1", "receipt/v2", "extractive/v1", "preservation/v2", "result/v1"
#: How omitted text can be asked for, with the artifact's id.
RECOVERY = "select lines or a pattern of artifact %s within a budget"
JSON = {"ignoreNullFields": "false"}


def _object(*parts: Column) -> Column:
    """One JSON object of members that are null where they are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _member(name: str, value: Column) -> Column:
    """`"name":value`, the value being JSON."""
    return F.concat(F.lit(f'"{name}":'), value)


def _json(value: Column) -> Column:
    """A scalar or struct as JSON, null included."""
    inside = F.to_json(F.struct(value.alias("x")), JSON)
    return F.substring(inside, F.lit(6), F.length(inside) - 6)


def recovery(fidelity: Column, artifact_id: Column) -> Column:
    """Only what is extractive can be asked for by lines or text; encoded or metadata projections state their omission alone."""
    return F.when((fidelity == "extractive") & artifact_id.isNotNull(), F.format_string(RECOVERY, artifact_id))


def projection(result: dict[str, Column], artifact: Column, source_sha256: Column, unit: Column | str = "bytes", token_profile: Column | str | None = None, acquisition: Column | None = None) -> Column:
    """A projection: visible text, artifact, accounting (`omitted` is a count, left out where the projection is exact),
    receipt, source (with `acquisition`), recovery (where it serves). `result` has fidelity, original_count, visible_count, visible."""
    omitted = saturating_sub(result["original_count"], result["visible_count"])
    accounting = _object(
        _member("original", _json(result["original_count"])), _member("visible", _json(result["visible_count"])), _member("unit", _json(F.lit(unit))),
        _member("token_profile", _json(F.lit(token_profile).cast("string"))), F.when(result["fidelity"] != "exact", _member("omitted", _json(omitted))),
    )
    receipt = F.struct(F.lit(RECEIPT_SCHEMA).alias("schema_version"), source_sha256.alias("source_sha256"), F.lit(PROJECTION_VERSION).alias("projection_version"), F.lit(POLICY_VERSION).alias("policy_version"))
    asked = recovery(result["fidelity"], artifact["id"])
    return _object(
        _member("schema_version", _json(F.lit(SCHEMA))), _member("source_is_untrusted", F.lit("true")), _member("projection", _json(result["visible"])), _member("artifact", _json(artifact)),
        _member("fidelity", _json(result["fidelity"])), _member("accounting", accounting), _member("receipt", _json(receipt)),
        *([_member("source", _json(acquisition))] if acquisition is not None else []), F.when(asked.isNotNull(), _member("recovery", _json(asked))),
    )


def error(code: Column, message: Column, artifact: Column, safety: str = "raw_content_included") -> Column:
    """A failure: code, bounded message, the artifact where one was committed, the safety flag (never raised), recovery (null without artifact)."""
    told = F.struct(code.alias("code"), F.substring(message, 1, MESSAGE_CHARS).alias("message"), artifact.alias("artifact"))
    asked = F.when(artifact.isNotNull(), F.format_string(RECOVERY, artifact["id"]))
    return _object(_member("schema_version", _json(F.lit(SCHEMA))), _member("error", _json(told)), _member(safety, F.lit("false")), _member("recovery", _json(asked)))


def outcome(result: dict[str, Column], code: Column, message: Column, artifact: Column, source_sha256: Column, **options) -> Column:
    """The projection's envelope, or the failure's; a failure names the artifact only where another budget would do."""
    named = F.when(keeps_artifact(code), artifact)
    return F.when(code.isNull(), projection(result, artifact, source_sha256, **options)).otherwise(error(code, message, named))


def result_line(body: Column) -> Column:
    """The line a command prints: schema_version, ok, result; `body` is JSON."""
    return _object(_member("schema_version", _json(F.lit(RESULT_SCHEMA))), _member("ok", F.lit("true")), _member("result", body))


def feedback(body: Column) -> Column:
    """What replaces a tool's output for the host: a decision and, as text, the envelope."""
    return F.to_json(F.struct(F.lit("block").alias("decision"), body.alias("reason")))


def diagnostic(code: Column, message: Column) -> Column:
    """What an observer is told of a failure; nothing of the tool's output."""
    return F.to_json(F.struct(F.concat(F.lit("observe diagnostic ["), code, F.lit("]: "), F.substring(message, 1, DIAGNOSTIC_CHARS)).alias("systemMessage")))
