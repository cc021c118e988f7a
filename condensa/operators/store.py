"""The artifact store's relations: digests, lineage chains, retention, tombstones, status.

Tables: artifacts (id, source, source_sha256, source_bytes, metadata, metadata_sha256, created_at, expires_at, ...),
receipts (artifact_id, sequence, request_id, receipt, receipt_sha256, chain_sha256), heads (artifact_id, receipts, bytes,
head: what each lineage claims to be), tombstones (id, expired_at, purge_at). Time is epoch seconds and always a
parameter. Functions take and give DataFrames; sources/store.py keeps them as Parquet on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import acquisition, envelope, requests

# ---- Fixed values ----------------------------------------------------------------------------------------------
DEFAULT_TTL = 7 * 86400
TOMBSTONE_SECONDS = 30 * 86400
STORE_BYTES = 512 << 20
LINEAGE_BYTES = 1 << 20
LINEAGE_TOTAL_BYTES = 64 << 20
MOST_SPANS, MOST_FACTS = 257, 256
#: The head of a lineage without receipts: the digest of nothing.
EMPTY_HEAD = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# ----------------------------------------------------------------------------------------------------------------
CHAIN_DOMAIN = b"lineage/v1\x00"


def digested(sources: DataFrame, key: str = "doc_id", source: str = "text", keep: tuple = ()) -> DataFrame:
    """(key, id, source_sha256, source_bytes, and `keep`): an id of 32 hex digits derived from the content's digest and the key."""
    raw = F.col(source).cast("binary")
    sha = F.sha2(raw, 256)
    named = F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), sha).cast("binary"), 256), 1, 32)
    return sources.where(F.col(source).isNotNull()).select(key, named.alias("id"), sha.alias("source_sha256"), F.octet_length(raw).cast("long").alias("source_bytes"), *keep)


def expiry(created_at: Column, expires_at: Column, ttl: Column, default_ttl: int = DEFAULT_TTL) -> Column:
    """When an artifact expires: an absolute time after `created_at`, else a positive TTL, else the default; null if contradictory."""
    return (
        F.when(expires_at.isNotNull() & ttl.isNotNull(), None)
        .when(expires_at.isNotNull(), F.when(expires_at > created_at, expires_at))
        .when(ttl.isNotNull(), F.when(ttl > 0, created_at + ttl))
        .otherwise(created_at + default_ttl)
        .cast("long")
    )


def status(artifacts: DataFrame, now: int) -> DataFrame:
    expired = F.col("expires_at") <= now
    return artifacts.agg(
        F.count("*").alias("artifacts"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("source_bytes"),
        F.count_if(expired).alias("expired"), F.coalesce(F.sum(F.when(expired, F.col("source_bytes"))), F.lit(0)).alias("expired_bytes"),
    )


def split_expired(artifacts: DataFrame, now: int) -> DataFrame:
    """Adds expired and, for those, when the tombstone goes."""
    return artifacts.withColumn("expired", F.col("expires_at") <= now).withColumn("purge_at", F.when(F.col("expired"), F.lit(now + TOMBSTONE_SECONDS)).cast("long"))


def upsert_tombstones(tombstones: DataFrame, artifacts: DataFrame, now: int) -> DataFrame:
    """Tombstones after a collection: new ones replace old ones of the same id, outdated ones are purged."""
    fresh = artifacts.where(F.col("expires_at") <= now).select("id", F.col("expires_at").alias("expired_at"), F.lit(now + TOMBSTONE_SECONDS).cast("long").alias("purge_at"))
    return tombstones.select("id", "expired_at", "purge_at").join(fresh.select("id"), "id", "left_anti").where(F.col("purge_at") > now).union(fresh)


def survivors(receipts: DataFrame, artifacts: DataFrame, now: int) -> DataFrame:
    """Receipts of artifacts that stay: deletion cascades."""
    return receipts.join(artifacts.where(F.col("expires_at") > now).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")


def expired_lineage(receipts: DataFrame, artifacts: DataFrame, now: int) -> DataFrame:
    gone = artifacts.where(F.col("expires_at") <= now).select(F.col("id").alias("artifact_id"))
    return receipts.join(gone, "artifact_id", "left_semi").agg(F.count("*").alias("receipts"), F.coalesce(F.sum(F.octet_length("receipt")), F.lit(0)).cast("long").alias("bytes"))


def lineage_shape(receipts: DataFrame) -> DataFrame:
    """Per artifact: count, bytes, first, last, distinct sequence numbers, and whether they run 0 .. n - 1."""
    n = F.count("*")
    return receipts.groupBy("artifact_id").agg(
        n.alias("receipts"), F.sum(F.octet_length("receipt")).cast("long").alias("bytes"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.countDistinct("sequence").alias("distinct"),
    ).withColumn("dense", (F.col("low") == 0) & (F.col("high") == F.col("receipts") - 1) & (F.col("distinct") == F.col("receipts")))


def oversized(receipts: DataFrame, cap: int = LINEAGE_BYTES) -> DataFrame:
    return receipts.groupBy("artifact_id").agg(F.sum(F.octet_length("receipt")).cast("long").alias("bytes")).where(F.col("bytes") > cap)


def _link(prev: Column, sequence: Column, receipt: Column, domain: bytes) -> Column:
    return F.sha2(F.concat(F.lit(domain), prev.cast("binary"), F.unhex(F.lpad(F.hex(sequence), 16, "0")), receipt), 256)


def _items(*more: str) -> Column:
    """An artifact's receipts in order; the lineage cap bounds what one task holds of it."""
    return F.array_sort(F.collect_list(F.struct("sequence", F.col("receipt").cast("binary").alias("receipt"), *more)))


def chained(receipts: DataFrame, domain: bytes = CHAIN_DOMAIN) -> DataFrame:
    """(artifact_id, receipts, head): sha256 over domain, previous digest in hex, sequence (8 bytes, big-endian), receipt."""
    head = F.aggregate("items", F.lit(EMPTY_HEAD), lambda prev, x: _link(prev, x["sequence"], x["receipt"], domain))
    return receipts.groupBy("artifact_id").agg(F.count("*").alias("receipts"), _items().alias("items")).select("artifact_id", "receipts", head.alias("head"))


def links(receipts: DataFrame, heads: DataFrame | None = None, domain: bytes = CHAIN_DOMAIN) -> DataFrame:
    """Each receipt (artifact_id, sequence, request_id, receipt) with its own digest and the chain's up to it.

    `heads` (artifact_id, head) says where lineages go on from; without it they begin.
    """
    rows = receipts.groupBy("artifact_id").agg(_items("request_id").alias("items"))
    rows = rows.join(heads.select("artifact_id", "head"), "artifact_id", "left") if heads is not None else rows.withColumn("head", F.lit(EMPTY_HEAD))
    grown = F.aggregate(
        "items", F.array(F.coalesce("head", F.lit(EMPTY_HEAD))), lambda a, x: F.concat(a, F.array(_link(F.element_at(a, -1), x["sequence"], x["receipt"], domain)))
    )
    each = rows.select("artifact_id", F.explode(F.arrays_zip("items", F.slice(grown, F.lit(2), F.size("items")).alias("chain"))).alias("z")).select("artifact_id", "z.items.*", F.col("z.chain").alias("chain_sha256"))
    return each.select("artifact_id", "sequence", "request_id", "receipt", F.sha2("receipt", 256).alias("receipt_sha256"), "chain_sha256")


def heads(receipts: DataFrame) -> DataFrame:
    """(artifact_id, receipts, bytes, head): what the lineages of linked receipts claim."""
    return receipts.groupBy("artifact_id").agg(F.count("*").alias("receipts"), F.sum(F.octet_length("receipt")).cast("long").alias("bytes"), F.max_by("chain_sha256", "sequence").alias("head"))


def verified_lineages(receipts: DataFrame, claims: DataFrame, artifacts: DataFrame | None = None, cap: int = LINEAGE_BYTES) -> DataFrame:
    """(artifact_id, failure) of every artifact with receipts or a claim: artifact_corrupt where anything doesn't hold, else null.

    Sequences run from 0 without gaps; every digest and link is recomputed from the stored bytes; counts, bytes and head
    are those claimed, within the cap; request ids are the receipts' own. With `artifacts` (id, source_sha256, source_bytes,
    created_at, expires_at) each receipt must also be valid for its artifact (`receipt_sound`).

    Each link is checked by itself against the digest that is stored with the receipt before it: if all hold, so does the
    chain, and a long lineage is as parallel as many short ones.
    """
    before = receipts.groupBy("artifact_id", (F.col("sequence") + 1).alias("sequence")).agg(F.min("chain_sha256").alias("previous"))
    told = receipts.join(before, ["artifact_id", "sequence"], "left")
    previous = F.when(F.col("sequence") == 0, EMPTY_HEAD).otherwise(F.col("previous"))
    told = told.withColumn("digest", F.sha2(F.col("receipt").cast("binary"), 256)).withColumn("chain", _link(previous, F.col("sequence"), F.col("receipt").cast("binary"), CHAIN_DOMAIN))
    parsed = F.from_json(F.col("receipt").cast("string"), RECEIPT)
    ok = F.col("receipt_sha256").eqNullSafe(F.col("digest")) & F.col("chain_sha256").eqNullSafe(F.col("chain"))
    if artifacts is not None:
        told = told.join(artifacts.select(F.col("id").alias("artifact_id"), F.struct("id", "source_sha256", "source_bytes", "created_at", "expires_at").alias("artifact")), "artifact_id", "left")
        ok &= F.col("artifact").isNotNull() & parsed["request_id"].eqNullSafe(F.col("request_id")) & receipt_sound(parsed, F.col("artifact"))
    seen = told.groupBy("artifact_id").agg(
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("*").alias("n"), F.countDistinct("sequence").alias("distinct"), F.min("sequence").alias("low"), F.max("sequence").alias("high"),
        F.sum(F.octet_length("receipt")).alias("size"), F.max_by("chain", "sequence").alias("last"),
    )
    met = claims.select("artifact_id", F.col("receipts").alias("claimed"), F.col("bytes").alias("claimed_bytes"), "head").join(seen, "artifact_id", "full")
    n = F.coalesce("n", F.lit(0))
    dense = (n == 0) | ((F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("distinct") == n))
    claimed = (F.col("claimed") == n) & (F.col("claimed_bytes") == F.coalesce("size", F.lit(0))) & (F.col("claimed_bytes") <= cap) & (F.col("head") == F.coalesce("last", F.lit(EMPTY_HEAD)))
    return met.select("artifact_id", F.when(~(F.coalesce(dense & claimed, F.lit(False)) & F.coalesce("ok", F.lit(True))), "artifact_corrupt").alias("failure"))


# ---------------------------------------------------------------- receipts

_SPANS = "array<struct<start: long, end: long>>"
RECEIPT = (
    f"schema_version string, request_id string, source_sha256 string, artifact {requests.ARTIFACT}, projection_version string, policy_version string, token_profile string, "
    f"original_count long, visible_count long, count_unit string, fidelity string, retained_spans {_SPANS}, omitted_spans {_SPANS}, "
    "preservation struct<profile: string, applied_profile: string, mandatory_fact_ids: array<string>, aggregates: array<struct<span: struct<start: long, end: long>, lines: long>>, focus_applied: boolean>, "
    f"acquisition {acquisition.RECEIPT}"
)
#: Formats that stay readable beside the current ones.
SCHEMAS, POLICIES = (envelope.RECEIPT_SCHEMA, "receipt/v1"), (envelope.POLICY_VERSION, "preservation/v1")


def receipt(projected: dict[str, Column], artifact: Column, request_id: Column, profile: Column, claims: Column, unit: Column | str = "bytes", focused: Column | None = None) -> Column:
    """The receipt of a projection (columns fidelity, applied_profile, original_count, visible_count, retained, omitted, fact_ids, aggregates)."""
    runs = F.transform(projected["aggregates"], lambda x: F.struct(F.struct(x["start"], x["end"]).alias("span"), x["lines"].alias("lines")))
    kept = F.struct(
        profile.alias("profile"), projected["applied_profile"].alias("applied_profile"), projected["fact_ids"].alias("mandatory_fact_ids"), runs.alias("aggregates"),
        (focused if focused is not None else F.lit(False)).alias("focus_applied"),
    )
    return F.struct(
        F.lit(SCHEMAS[0]).alias("schema_version"), request_id.alias("request_id"), artifact["source_sha256"].alias("source_sha256"), artifact.alias("artifact"), F.lit(envelope.PROJECTION_VERSION).alias("projection_version"),
        F.lit(POLICIES[0]).alias("policy_version"), F.when(F.lit(unit) == "tokens", requests.TOKEN_PROFILE).alias("token_profile"), projected["original_count"].alias("original_count"),
        projected["visible_count"].alias("visible_count"), F.lit(unit).alias("count_unit"), projected["fidelity"].alias("fidelity"), projected["retained"].alias("retained_spans"), projected["omitted"].alias("omitted_spans"),
        kept.alias("preservation"), claims.alias("acquisition"),
    )


def _follow(spans: Column, size: Column, touching: bool) -> Column:
    """Whether spans are in order without overlap inside the source (empty ones only of an empty source), or, `touching`, tile it from 0."""
    step = lambda a, s: F.struct(
        (a["ok"] & ((s["start"] == a["at"]) if touching else (s["start"] >= a["at"])) & (s["end"] >= s["start"]) & (s["end"] <= size) & ((s["end"] > s["start"]) | (size == 0))).alias("ok"), s["end"].alias("at")
    )
    done = lambda a: a["ok"] & (a["at"] == size) if touching else a["ok"]
    return F.coalesce(F.aggregate(spans, F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("at")), step, done), F.lit(False))


def spans_sound(r: Column, size: Column) -> Column:
    """Whether a receipt's spans partition the source as its fidelity says, and its collapsed runs lie in it."""
    kept, left = r["retained_spans"], r["omitted_spans"]
    runs = F.forall(r["preservation"]["aggregates"], lambda x: (x["lines"] > 0) & (x["span"]["end"] > x["span"]["start"]) & (x["span"]["end"] <= size))
    shape = F.when(r["fidelity"] == "exact", F.size(left) == 0).when(r["fidelity"] == "extractive", True).when(r["fidelity"].isin("encoded", "metadata_only"), F.size(kept) == 0)
    return F.coalesce(_follow(kept, size, False) & _follow(left, size, False) & runs & _follow(F.array_sort(F.concat(kept, left)), size, True) & shape, F.lit(False))


def receipt_sound(r: Column, artifact: Column) -> Column:
    """Whether a receipt is valid for an artifact (id, source_sha256, source_bytes, created_at, expires_at)."""
    named = lambda c, low=1: F.octet_length(c).between(low, requests.IDENTIFIER_BYTES)
    kept = r["preservation"]
    same = F.lit(True)
    for c in ("id", "source_sha256", "source_bytes", "created_at", "expires_at"):
        same &= r["artifact"][c] == artifact[c]
    unit = F.when(r["count_unit"] == "bytes", r["token_profile"].isNull()).when(r["count_unit"] == "tokens", F.coalesce(r["token_profile"] == requests.TOKEN_PROFILE, F.lit(False)))
    facts = kept["mandatory_fact_ids"]
    return F.coalesce(
        r["schema_version"].isin(*SCHEMAS) & same & (r["source_sha256"] == artifact["source_sha256"]) & (r["projection_version"] == envelope.PROJECTION_VERSION) & r["policy_version"].isin(*POLICIES)
        & named(r["request_id"]) & named(kept["profile"]) & named(kept["applied_profile"], 0) & ((r["schema_version"] != SCHEMAS[0]) | (kept["applied_profile"] != ""))
        & (F.size(kept["aggregates"]) <= MOST_SPANS) & (F.size(facts) <= MOST_FACTS) & F.forall(facts, lambda x: named(x)) & (F.size(r["retained_spans"]) <= MOST_SPANS) & (F.size(r["omitted_spans"]) <= MOST_SPANS)
        & unit & spans_sound(r, artifact["source_bytes"]) & acquisition.state(r["acquisition"], artifact["source_bytes"]).isNotNull(),
        F.lit(False),
    )


def verified(artifacts: DataFrame, now: int) -> DataFrame:
    """(id, failure): what loading an artifact would say, in the order it is checked; null when sound.

    `artifacts` has id, schema_version, state, expires_at, source (binary), source_bytes, source_sha256, and where they
    are kept metadata (the acquisition as JSON) and metadata_sha256: another schema or state, expiry, length, digest,
    then the metadata's digest and whether its claims hold for so many bytes.
    """
    failure = (
        F.when(~F.col("schema_version").isin(1, 2, 3), "artifact_corrupt")
        .when(~F.col("state").isin("complete", "partial"), "artifact_corrupt")
        .when(F.col("expires_at") <= now, "artifact_expired")
        .when(F.octet_length("source") != F.col("source_bytes"), "artifact_corrupt")
        .when(F.sha2("source", 256) != F.col("source_sha256"), "artifact_corrupt")
    )
    if "metadata" in artifacts.columns:
        claims = F.from_json(F.col("metadata").cast("string"), acquisition.RECEIPT)
        failure = failure.when(~F.coalesce(F.sha2("metadata", 256) == F.col("metadata_sha256"), F.lit(False)) | acquisition.state(claims, F.col("source_bytes")).isNull(), "artifact_corrupt")
    return artifacts.select("id", failure.alias("failure"))


def lookup(ids: DataFrame, artifacts: DataFrame, tombstones: DataFrame, now: int) -> DataFrame:
    """(id, found): live, expired (a tombstone still says so) or unknown."""
    live = artifacts.select("id", F.col("expires_at"))
    dead = tombstones.select("id", F.col("purge_at"))
    found = F.when(F.col("expires_at") > now, "live").when(F.col("expires_at").isNotNull() | (F.col("purge_at") > now), "expired").otherwise("unknown")
    return ids.join(live, "id", "left").join(dead, "id", "left").select("id", found.alias("found"))


def latest(receipts: DataFrame) -> DataFrame:
    """The last receipt of every artifact."""
    return receipts.groupBy("artifact_id").agg(F.max("sequence").alias("sequence"), F.max_by("receipt", "sequence").alias("receipt"))


def resequenced(receipts: DataFrame) -> DataFrame:
    """Old lineages in a dense order from 0."""
    order = Window.partitionBy("artifact_id").orderBy("sequence")
    return receipts.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))
