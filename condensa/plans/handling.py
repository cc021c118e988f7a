"""Requests that run: decoded, validated, joined to their sources, projected, and answered with receipt and envelope, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64_canonical
from ..operators import projection, store
from . import acquisition, codes, envelope, requests

#: Requests of one artifact that share one copy of its source, about.
BLOCK = 512
#: The schema that a reference to an artifact names.
ARTIFACT_SCHEMA = "artifact/v3"
_REFERENCE = ("id", "source_sha256", "source_bytes", "created_at", "expires_at")
_CLAIMS = '{"variant":"%s","complete":true,"partial":false,"truncated":false}'


def _spec(request: Column, refused: Column) -> Column:
    """The request's part of projection.SPEC."""
    budget, selector = request["budget"], request["source"]["selector"]
    within = lambda c, default: F.coalesce(selector[c], F.lit(default).cast("long"))
    chosen = F.struct(
        selector["kind"].alias("kind"), selector["start_line"].alias("start_line"), selector["line_count"].alias("line_count"), base64_canonical(selector["pattern"]).alias("pattern"),
        within("before_lines", requests.DEFAULT_CONTEXT).alias("before_lines"), within("after_lines", requests.DEFAULT_CONTEXT).alias("after_lines"), within("max_matches", requests.DEFAULT_MATCHES).alias("max_matches"),
    )
    return F.struct(
        refused.alias("refused"), request["preservation_profile"].alias("profile"), budget["unit"].alias("unit"), budget["total_visible_limit"].alias("total"), budget["reserved_envelope"].alias("reserved"),
        request["focus"].alias("focus"), F.when(selector.isNotNull(), chosen).alias("selector"),
    )


def _decoded(lines: DataFrame, key: str, column: str, now: int, roots: tuple, profiles: tuple) -> DataFrame:
    told = requests.decoded(lines, column, keep=(key,))
    source = F.col("request")["source"]
    elsewhere = F.when(source["kind"].isin("file", "process"), "acquisition_failed")  # whose bytes nobody has acquired
    reference = F.when((source["kind"] == "artifact") & (source["artifact"]["schema_version"] != ARTIFACT_SCHEMA), "artifact_schema_unsupported")
    refused = F.coalesce("failure", requests.failure(F.col("request"), now, roots, profiles), elsewhere, reference)
    return told.select(key, "request", "request_id", refused.alias("refused"))


def handled(lines: DataFrame, artifacts: DataFrame, tombstones: DataFrame, now: int, key: str = "id", column: str = "value", roots: tuple = (), profiles: tuple = (), ranks_path: str | None = None) -> DataFrame:
    """One row per request line (key, column: JSON): key, request_id, artifact, the columns of projection.RESULT, exit_code,
    receipt and envelope (JSON); receipt is null where the request failed, and error_code says why.

    A request brings its bytes (inline) or names an artifact of `artifacts` (id, schema_version, state, source,
    source_sha256, source_bytes, created_at, expires_at); `tombstones` (id, purge_at) tells expired from unknown ones.
    Files and processes are acquired before: here they are refused. Each row has its own profile, budget, unit, focus and
    selector. The first of these decides: decoding, validation, the reference's schema, whether the artifact is there,
    sound and as referred to, whether it is complete, the projection.

    Requests of one artifact are dealt by hash into blocks of about BLOCK, and its source goes once to each, so neither a
    hot artifact nor its requests meet in one task. A null line is an invalid request; an empty table gives an empty table.
    """
    told = _decoded(lines, key, column, now, roots, profiles).withColumn("_row", F.monotonically_increasing_id())
    source = F.col("request")["source"]
    named = F.when(F.col("refused").isNull() & (source["kind"] == "artifact"), source["artifact"]["id"])
    # How many blocks an artifact's requests make is counted on the lines as they are: more than are valid do no harm.
    asked = lines.select(F.get_json_object(column, "$.source.artifact.id").alias("of")).where("of is not null").groupBy("of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    many = asked.where("blocks > 1")  # at most a BLOCK-th as many as requests
    # Inline and refused requests are blocks of their own and name themselves: no row joins by a null, which all would do in one task.
    own_name = F.concat(F.lit("-"), F.col("_row").cast("string"))
    dealt = told.withColumn("of", named).withColumn("meet", F.coalesce("of", own_name)).join(many.withColumnRenamed("of", "meet"), "meet", "left").withColumn("block", F.pmod(F.xxhash64(key), F.coalesce("blocks", F.lit(1))).cast("int"))

    inline = base64_canonical(source["bytes"])
    digest = F.sha2(inline, 256)
    own = F.when(F.col("refused").isNull() & (source["kind"] == "inline"), F.struct(
        F.lit(ARTIFACT_SCHEMA).alias("schema_version"), F.substring(F.sha2(F.concat(F.col("request_id"), F.lit(":"), digest).cast("binary"), 256), 1, 32).alias("id"), digest.alias("source_sha256"),
        F.octet_length(inline).cast("long").alias("source_bytes"), F.lit(now).cast("long").alias("created_at"), store.expiry(F.lit(now), F.col("request")["retention"]["expires_at"], F.col("request")["retention"]["ttl_seconds"]).alias("expires_at"),
    ))
    item = F.struct(F.col(key), "request_id", F.coalesce(own, source["artifact"]).alias("artifact"), source["kind"].alias("kind"), _spec(F.col("request"), F.col("refused")).alias("spec"))
    blocks = dealt.groupBy("meet", "block").agg(F.first("of").alias("of"), F.collect_list(item).alias("specs"), F.first(F.when(source["kind"] == "inline", inline)).alias("inline"))

    raw = F.col("source").cast("binary")
    unsound = (
        F.when(~F.col("schema_version").isin(1, 2, 3), "artifact_schema_unsupported").when(~F.col("state").isin("complete", "partial"), "commit_failed").when(F.col("expires_at") <= now, "artifact_expired")
        .when((F.octet_length(raw) != F.col("source_bytes")) | (F.sha2(raw, 256) != F.col("source_sha256")), "artifact_corrupt")
    )
    held = artifacts.select(F.col("id").alias("meet"), F.struct("schema_version", "state", "source_sha256", "source_bytes", "created_at", "expires_at").alias("stored"), raw.alias("source"), unsound.alias("unsound"))  # once an artifact, not once a request
    held = held.join(many.withColumnRenamed("of", "meet"), "meet", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    dead = tombstones.select(F.col("id").alias("meet"), (F.col("purge_at") > now).alias("told"))
    met = blocks.join(held, ["meet", "block"], "left").join(dead, "meet", "left")
    stored = F.col("stored")
    missing = F.when(stored.isNull(), F.when(F.col("told"), "artifact_expired").otherwise("artifact_unknown"))
    met = met.select("of", "specs", F.coalesce("inline", "source").alias("source"), "stored", F.when(F.col("of").isNotNull(), F.coalesce(missing, "unsound")).alias("unfit"))

    def judged(x: Column) -> Column:
        as_told = F.lit(True)
        for c in _REFERENCE[1:]:
            as_told &= x["artifact"][c] == stored[c]
        late = F.when(F.col("of").isNotNull(), F.coalesce(F.col("unfit"), F.when(~F.coalesce(as_told, F.lit(False)), "artifact_corrupt"), F.when(stored["state"] == "partial", "acquisition_failed")))
        spec = x["spec"].withField("refused", F.coalesce(x["spec"]["refused"], late))
        return F.struct(x[key].alias(key), x["request_id"].alias("request_id"), x["artifact"].alias("artifact"), x["kind"].alias("kind"), x["spec"]["profile"].alias("profile"), x["spec"]["unit"].alias("unit"), x["spec"]["focus"].isNotNull().alias("focused"), spec.alias("spec"))

    out = projection.project_each(met.select(F.transform("specs", judged).alias("specs"), "source"), ranks_path)
    return answered(out, key)


def answered(out: DataFrame, key: str) -> DataFrame:
    """Projections (key, request_id, artifact, kind, profile, unit, focused, the columns of RESULT) with exit code, receipt and envelope."""
    code, artifact = F.col("error_code"), F.col("artifact")
    claims = F.from_json(F.when(F.col("kind") == "artifact", _CLAIMS % "artifact").otherwise(_CLAIMS % "inline"), acquisition.RECEIPT)
    result = {c: F.col(c) for c in ("fidelity", "applied_profile", "original_count", "visible_count", "visible", "retained", "omitted", "fact_ids", "aggregates")}
    receipt = store.receipt(result, artifact, F.col("request_id"), F.col("profile"), claims, F.col("unit"), F.col("focused"))
    tokens = F.when(F.col("unit") == "tokens", requests.TOKEN_PROFILE)
    body = envelope.outcome(result, code, F.concat(F.lit("the request failed: "), code), artifact, artifact["source_sha256"], unit=F.col("unit"), token_profile=tokens, acquisition=claims)
    kept = F.when(code.isNull() | codes.keeps_artifact(code), artifact)
    columns = projection.RESULT.replace("struct<start: long, end: long>", "s").replace("struct<start: long, end: long, lines: long>", "s").split(", ")
    return out.select(key, "request_id", kept.alias("artifact"), *(f.split(" ")[0] for f in columns), codes.exit_code(code).alias("exit_code"), F.when(code.isNull(), F.to_json(receipt, envelope.JSON)).alias("receipt"), body.alias("envelope"))


def receipt_rows(answers: DataFrame) -> DataFrame:
    """(artifact_id, request_id, receipt, receipt_sha256) of the requests that were answered, as a lineage takes them."""
    return answers.where("receipt is not null").select(F.col("artifact")["id"].alias("artifact_id"), "request_id", "receipt", F.sha2("receipt", 256).alias("receipt_sha256"))
