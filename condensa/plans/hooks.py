"""Hook events as rows: which observe something, what they hold, and what the host is told in each mode.

The same plan serves a batch of event lines and, through foreachBatch, a stream of them: events are correlated by their
id only, so a repeated one is worked on again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_prefix
from .requests import IDENTIFIER_BYTES, derived_focus

# ---- Fixed values ----------------------------------------------------------------------------------------------
MODES = ("off", "observe", "active")
INPUT_BYTES = 16 << 20
TOOL_EVENT, PROMPT_EVENT = "PostToolUse", "UserPromptSubmit"
EVENT_SCHEMA = "v1"
TOOLS, TOOL_PREFIX = ("Bash", "apply_patch", "Edit", "Write", "update_plan", "Agent"), "mcp__"
FIELD_BYTES, CWD_BYTES = 256, 4096
TOTAL_TOKENS, RESERVED_TOKENS = 2250, 800
# ----------------------------------------------------------------------------------------------------------------
TEXTS = ("schema_version", "hook_schema_version", "session_id", "turn_id", "cwd", "hook_event_name", "tool_name", "tool_use_id", "prompt")


def events(lines: DataFrame, column: str = "value", keep: tuple = ()) -> DataFrame:
    """One JSON event a line, as `keep` and kind, session_id, request_id, focus, prompt, source (what was observed), failure.

    kind: tool, prompt, or unsupported (a tool whose output is left alone). A failure leaves source null: input_too_large,
    invalid_request (no JSON object, missing or oversized fields), schema_unsupported (another version or event).
    """
    text = F.col(column)
    parsed = F.from_json(text, ", ".join(f"{t} variant" for t in (*TEXTS, "tool_input", "tool_response")))
    rows = lines.select(*keep, text.alias("_text"), parsed.alias("e"))
    e, text = F.col("e"), F.col("_text")
    kind_of = lambda c: F.schema_of_variant(e[c])
    said = {c: F.when(kind_of(c) == "STRING", e[c].cast("string")) for c in TEXTS}
    wrong = lambda c: e[c].isNotNull() & ~kind_of(c).isin("STRING", "VOID")
    version = F.coalesce(said["schema_version"], said["hook_schema_version"])
    name = said["hook_event_name"]
    within = lambda c, most=FIELD_BYTES: F.coalesce(F.octet_length(said[c]).between(1, most), F.lit(False))
    absent = lambda *cs: F.greatest(*(said[c].isNull() for c in cs)) if len(cs) > 1 else said[cs[0]].isNull()
    prompt = name == PROMPT_EVENT
    malformed = F.coalesce(F.octet_length(text) > INPUT_BYTES, F.lit(False))
    prompt_failure = F.when(absent("session_id", "prompt") | wrong("schema_version"), "invalid_request").when((F.coalesce(version, F.lit(EVENT_SCHEMA)) != EVENT_SCHEMA) | ~within("session_id"), "schema_unsupported")
    tool_failure = (
        F.when(absent("session_id", "cwd", "hook_event_name", "tool_name", "tool_use_id") | e["tool_input"].isNull() | e["tool_response"].isNull() | wrong("turn_id") | wrong("schema_version"), "invalid_request")
        .when(F.coalesce(version, F.lit(EVENT_SCHEMA)) != EVENT_SCHEMA, "schema_unsupported")
        .when(name != TOOL_EVENT, "schema_unsupported")
        .when(~(within("session_id") & within("cwd", CWD_BYTES) & within("tool_name") & within("tool_use_id") & (F.coalesce(F.octet_length(said["turn_id"]), F.lit(0)) <= FIELD_BYTES)), "invalid_request")
        .when(kind_of("tool_input") == "VOID", "invalid_request")
    )
    failure = F.when(malformed, "input_too_large").when(text.isNull() | F.json_object_keys(text).isNull(), "invalid_request").when(F.coalesce(prompt, F.lit(False)), prompt_failure).otherwise(tool_failure)
    supported = said["tool_name"].isin(*TOOLS) | said["tool_name"].startswith(TOOL_PREFIX)
    kind = F.when(F.coalesce(prompt, F.lit(False)), "prompt").when(supported, "tool").otherwise("unsupported")
    out = rows.withColumn("failure", failure).withColumn("kind", F.when(F.col("failure").isNull(), kind))
    live = F.col("kind") == "tool"
    response = F.when(kind_of("tool_response") == "STRING", e["tool_response"].cast("string")).otherwise(F.to_json(e["tool_response"]))
    request_id = byte_prefix(F.concat_ws(":", said["session_id"], said["tool_use_id"]), IDENTIFIER_BYTES)
    return out.select(
        *keep, "kind", said["session_id"].alias("session_id"), F.when(live, request_id).alias("request_id"), F.when(live, derived_focus(F.to_json(e["tool_input"]))).alias("focus"),
        F.when(F.col("kind") == "prompt", said["prompt"]).alias("prompt"), F.when(live, response).alias("source"), "failure",
    )


def told(mode: str, kind: Column, fidelity: Column, code: Column, body: Column, message: Column) -> Column:
    """What the host is told of one event, null for nothing: off says nothing; observe only that a projection failed;
    active replaces what isn't exact. A malformed event is told in both; of an unsupported tool only that it is."""
    from . import envelope

    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "off":
        return F.lit(None).cast("string")
    failed = envelope.feedback(body) if mode == "active" else envelope.diagnostic(code, message)
    shown = F.when(fidelity != "exact", envelope.feedback(body)) if mode == "active" else F.lit(None).cast("string")
    return (
        F.when(kind.isNull(), envelope.feedback(body))
        .when(kind == "unsupported", F.to_json(F.struct(F.lit("unsupported_surface: not a supported local tool").alias("systemMessage"))))
        .when(kind == "prompt", F.lit(None).cast("string"))
        .when(code.isNotNull(), failed)
        .otherwise(shown)
    )
