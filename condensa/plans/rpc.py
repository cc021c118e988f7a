"""JSON-RPC messages as rows, one a line: which ask for an answer, and what is wrong with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- Fixed values ----------------------------------------------------------------------------------------------
MESSAGE_BYTES = 1 << 20
PARSE_ERROR, INVALID_REQUEST = -32700, -32600
SILENT = ("notifications/initialized", "notifications/cancelled")
# ----------------------------------------------------------------------------------------------------------------


def messages(lines: DataFrame, column: str = "value", keep: tuple = ()) -> DataFrame:
    """`keep`, kind, id, method, params, error_code: kind is request (an answer is due), silent (none is), or error.

    id is the JSON of the message's id, `null` where it has none that an answer could name; params is JSON. A line that is
    too long, a version other than 2.0, an empty method and an id that is neither text nor number are invalid requests;
    what is no object, or lacks version or method, can't be parsed. Messages without an id, or with a null one, and the
    two known notifications are silent. Lines are cut by the reader, so an oversized one spoils only itself.
    """
    text = F.col(column)
    rows = lines.select(*keep, text.alias("_text"), F.try_parse_json(text).alias("_v"))
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), "^[A-Z]+", 0)
    said = lambda path: F.get_json_object("_text", path)
    id_kind = F.coalesce(kind("$.id"), F.lit(""))
    named = id_kind.isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    readable = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT") & (kind("$.jsonrpc") == "STRING") & (kind("$.method") == "STRING"), F.lit(False))
    error = (
        F.when(F.octet_length("_text") > MESSAGE_BYTES, INVALID_REQUEST).when(~readable, PARSE_ERROR)
        .when((said("$.jsonrpc") != "2.0") | (said("$.method") == ""), INVALID_REQUEST).when(~named & ~id_kind.isin("", "VOID"), INVALID_REQUEST)
    )
    silent = said("$.method").isin(*SILENT) | ~named
    known = F.to_json(F.try_variant_get("_v", "$.id", "variant"))
    rows = rows.select(*keep, error.alias("error_code"), silent.alias("_silent"), F.when(named & (F.octet_length("_text") <= MESSAGE_BYTES) & readable, known).otherwise("null").alias("id"), said("$.method").alias("method"), F.to_json(F.try_variant_get("_v", "$.params", "variant")).alias("params"))
    what = F.when(F.col("error_code").isNotNull(), "error").when(F.col("_silent"), "silent").otherwise("request")
    asked = F.col("kind") == "request"
    return rows.withColumn("kind", what).select(*keep, "kind", F.when(F.col("kind") != "silent", F.col("id")).alias("id"), F.when(asked, F.col("method")).alias("method"), F.when(asked, F.col("params")).alias("params"), "error_code")
