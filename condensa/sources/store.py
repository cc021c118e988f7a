"""The artifact store on Parquet: immutable segments and one manifest a version; the newest manifest is the store.

A commit collects what expired, writes a segment, reads it back, checks capacity and digests of what was written, and
only then publishes the next manifest; readers see whole versions. One writer at a time holds a lock file, which names
its owner and is taken over once it is older than LOCK_SECONDS, so that a driver that died blocks no one for ever.
Manifests and the lock go through Hadoop's file system interface, as segments do: any file system that all drivers and
executors share will do.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as S
from ..plans import acquisition

TABLES = {
    "artifacts": "id string, schema_version int, state string, created_at long, expires_at long, source binary, source_bytes long, source_sha256 string, metadata binary, metadata_sha256 string",
    "receipts": "artifact_id string, sequence long, request_id string, receipt binary, receipt_sha256 string, chain_sha256 string",
    "heads": "artifact_id string, receipts long, bytes long, head string",
    "tombstones": "id string, expired_at long, purge_at long",
}
#: A lock this old belongs to a writer that is gone.
LOCK_SECONDS = 3600
SCHEMA_VERSION = 3


class StoreError(Exception):
    """One of plans.codes: store_busy, store_full, commit_failed, artifact_unknown, artifact_expired, artifact_corrupt, ..."""


class Store:
    """`root` is a path or URI on a file system that driver and executors share; `now` is always a parameter."""

    def __init__(self, spark: SparkSession, root: str, capacity: int = S.STORE_BYTES, lineage_capacity: int = S.LINEAGE_TOTAL_BYTES):
        self.spark, self.root, self.capacity, self.lineage_capacity = spark, root.rstrip("/"), capacity, lineage_capacity
        jvm = spark._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._mode = lambda octal: jvm.org.apache.hadoop.fs.permission.FsPermission(octal)
        if not self._fs.exists(self._path()):
            self._fs.mkdirs(self._path())
            self._fs.setPermission(self._path(), self._mode("700"))

    # ------------------------------------------------------------ files

    def _read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _create(self, name: str, data: bytes) -> bool:
        """Write a new file for the owner alone; False where it exists."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        self._fs.setPermission(self._path(name), self._mode("600"))
        return True

    # ------------------------------------------------------------ versions

    def _versions(self) -> list[int]:
        names = [str(x.getPath().getName()) for x in self._fs.listStatus(self._path())]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self) -> dict[str, list[str]]:
        known = self._versions()
        return json.loads(self._read(f"manifest-{known[-1]:012d}.json")) if known else {t: [] for t in TABLES}

    def _publish(self, manifest: dict) -> None:
        """The next version, whole or not at all: written aside, then renamed."""
        known = self._versions()
        aside = f"aside-{uuid.uuid4().hex}"
        self._create(aside, json.dumps(manifest).encode())
        if not self._fs.rename(self._path(aside), self._path(f"manifest-{(known[-1] + 1) if known else 0:012d}.json")):
            raise StoreError("commit_failed")
        for old in known[:-1]:  # the version before stays for those who are reading it
            self._fs.delete(self._path(f"manifest-{old:012d}.json"), False)

    @contextmanager
    def _writer(self):
        owner = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "token": uuid.uuid4().hex}).encode()
        if not self._create("LOCK", owner):
            age = self.spark._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(self._path("LOCK")).getModificationTime()
            if age < LOCK_SECONDS * 1000:
                raise StoreError("store_busy")
            self._fs.delete(self._path("LOCK"), False)
            if not self._create("LOCK", owner):
                raise StoreError("store_busy")
        try:
            yield
        finally:
            if self._fs.exists(self._path("LOCK")) and self._read("LOCK") == owner:
                self._fs.delete(self._path("LOCK"), False)

    def _segment(self, df: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self._fs.setPermission(self._path(name), self._mode("700"))
        return name

    def _open(self, table: str, parts: list[str]) -> DataFrame:
        read = [self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{p}") for p in parts]
        return reduce(DataFrame.union, read) if read else self.spark.createDataFrame([], TABLES[table])

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        return self._open(name, (manifest or self._manifest()).get(name, []))

    # ------------------------------------------------------------ operations

    def commit(self, sources: DataFrame, now: int) -> DataFrame:
        """Commit rows (id, source, and optionally expires_at, ttl, state, acquisition); the references, verified from disk.

        `acquisition` is a struct of plans.acquisition.RECEIPT; without it a row was given inline. Whatever `sources`
        gives when it is read, what counts is the segment that was written: it is checked, then published, or removed.
        """
        with self._writer():
            manifest = self._collected(self._manifest(), now)
            cols = {c: F.col(c) if c in sources.columns else F.lit(None).cast("long") for c in ("expires_at", "ttl")}
            state = F.col("state") if "state" in sources.columns else F.lit("complete")
            inline = F.from_json(F.lit('{"variant":"inline","complete":true,"partial":false,"truncated":false}'), acquisition.RECEIPT)
            claims = F.to_json(F.col("acquisition") if "acquisition" in sources.columns else inline).cast("binary")
            raw = F.col("source").cast("binary")
            new = sources.select(
                "id", F.lit(SCHEMA_VERSION).alias("schema_version"), state.alias("state"), F.lit(now).cast("long").alias("created_at"), S.expiry(F.lit(now), cols["expires_at"], cols["ttl"]).alias("expires_at"),
                raw.alias("source"), F.octet_length(raw).cast("long").alias("source_bytes"), F.sha2(raw, 256).alias("source_sha256"), claims.alias("metadata"), F.sha2(claims, 256).alias("metadata_sha256"),
            )
            name = self._segment(new)
            try:
                back = self._open("artifacts", [name])
                used = self.table("artifacts", manifest).agg(F.coalesce(F.sum("source_bytes"), F.lit(0))).first()[0]
                wanted, bad = back.agg(F.coalesce(F.sum("source_bytes"), F.lit(0)), F.count_if(F.col("expires_at").isNull())).first()
                if bad:
                    raise StoreError("invalid_request")
                if used + wanted > self.capacity:
                    raise StoreError("store_full")
                if not S.verified(back, now).where("failure is not null").isEmpty():
                    raise StoreError("artifact_corrupt")
                twice = back.select("id").union(self.table("artifacts", manifest).select("id")).groupBy("id").count().where("count > 1")
                if not twice.isEmpty():
                    raise StoreError("commit_failed")
            except StoreError:
                self._fs.delete(self._path(name), True)
                raise
            self._publish(manifest | {"artifacts": [*manifest["artifacts"], name]})
            return back.drop("source", "metadata")

    def append(self, receipts: DataFrame) -> None:
        """Append receipts (artifact_id, place, receipt, and optionally request_id) in order of `place` to their lineages.

        The lineages appended to are verified first; caps hold for each artifact and for the store.
        """
        with self._writer():
            manifest = self._manifest()
            old, claims, known = self.table("receipts", manifest), self.table("heads", manifest), self.table("artifacts", manifest)
            given = F.col("request_id") if "request_id" in receipts.columns else F.lit(None).cast("string")
            fresh = S.resequenced(receipts.select("artifact_id", F.col("place").cast("long").alias("sequence"), given.alias("request_id"), F.col("receipt").cast("binary").alias("receipt")))
            touched = fresh.select("artifact_id").distinct()
            if not touched.join(known.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti").isEmpty():
                raise StoreError("artifact_unknown")
            sound = S.verified_lineages(old.join(touched, "artifact_id", "left_semi"), claims.join(touched, "artifact_id", "left_semi"))
            if not sound.where("failure is not null").isEmpty():
                raise StoreError("artifact_corrupt")
            fresh = fresh.join(claims.select("artifact_id", F.col("receipts").alias("n")), "artifact_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("n", F.lit(0))).drop("n")
            name = self._segment(S.links(fresh, claims))
            every = self._open("receipts", [*manifest["receipts"], name])
            if not S.oversized(every).isEmpty() or (every.agg(F.sum(F.octet_length("receipt"))).first()[0] or 0) > self.lineage_capacity:
                self._fs.delete(self._path(name), True)
                raise StoreError("resource_exhausted")
            self._publish(manifest | {"receipts": [*manifest["receipts"], name], "heads": [self._segment(S.heads(every))]})

    def resolve(self, artifact_id: str, now: int) -> DataFrame:
        """The artifact's row after verification; expired and unknown ids are told apart."""
        return self._resolved(artifact_id, now, self._manifest())

    def _resolved(self, artifact_id: str, now: int, manifest: dict) -> DataFrame:
        ids = self.spark.createDataFrame([(artifact_id,)], "id string")
        found = S.lookup(ids, self.table("artifacts", manifest), self.table("tombstones", manifest), now).first()["found"]
        if found != "live":
            raise StoreError({"expired": "artifact_expired", "unknown": "artifact_unknown"}[found])
        row = self.table("artifacts", manifest).where(F.col("id") == artifact_id)
        if failure := S.verified(row, now).first()["failure"]:
            raise StoreError(failure)
        return row

    def retrieve(self, artifact_id: str, now: int) -> DataFrame:
        """`resolve`, for reading: an expired artifact is collected before the failure is raised; a partial one is only for diagnosis."""
        try:
            row = self.resolve(artifact_id, now)
        except StoreError as told:
            if str(told) == "artifact_expired":
                self.collect_garbage(now)
            raise
        if row.first()["state"] != "complete":
            raise StoreError("acquisition_failed")
        return row

    def trace(self, artifact_id: str, now: int, strict: bool = False) -> DataFrame:
        """The receipts in order with the lineage's head, after every digest, link and claim has been recomputed.

        `strict` also validates every receipt (JSON of operators.store.RECEIPT) against the artifact.
        """
        manifest = self._manifest()
        row = self._resolved(artifact_id, now, manifest)
        mine = self.table("receipts", manifest).where(F.col("artifact_id") == artifact_id)
        claims = self.table("heads", manifest).where(F.col("artifact_id") == artifact_id)
        if not S.verified_lineages(mine, claims, row if strict else None).where("failure is not null").isEmpty():
            raise StoreError("artifact_corrupt")
        return mine.join(claims.select("artifact_id", "head"), "artifact_id").orderBy("sequence")

    def status(self, now: int) -> DataFrame:
        return S.status(self.table("artifacts"), now)

    def _collected(self, manifest: dict, now: int) -> dict:
        artifacts = self.table("artifacts", manifest)
        old = self.table("tombstones", manifest)
        if artifacts.where(F.col("expires_at") <= now).isEmpty() and old.where(F.col("purge_at") <= now).isEmpty():
            return manifest
        return {
            "tombstones": [self._segment(S.upsert_tombstones(old, artifacts, now))],
            "receipts": [self._segment(S.survivors(self.table("receipts", manifest), artifacts, now))],
            "heads": [self._segment(S.survivors(self.table("heads", manifest), artifacts, now))],
            "artifacts": [self._segment(artifacts.where(F.col("expires_at") > now))],
        }

    def collect_garbage(self, now: int) -> None:
        """Bury what expired, and delete segments that neither the newest version nor the one before it names."""
        with self._writer():
            self._publish(self._collected(self._manifest(), now))
            named = {p for v in self._versions()[-2:] for parts in json.loads(self._read(f"manifest-{v:012d}.json")).values() for p in parts}
            for x in self._fs.listStatus(self._path()):
                name = str(x.getPath().getName())
                if name.startswith("segment-") and name not in named:
                    self._fs.delete(x.getPath(), True)

    def migrate(self, artifacts: DataFrame, receipts: DataFrame) -> None:
        """Take over tables of an older schema into an empty store: artifacts without metadata, receipts without chain.

        Sources are verified, receipts ordered by (artifact_id, sequence) and numbered densely, chains and heads built anew,
        and all of it is published as one version. A receipt without its artifact, or a lineage over its cap, is corrupt.
        """
        with self._writer():
            if any(self._manifest().values()):
                raise StoreError("commit_failed")
            inline = F.lit('{"variant":"inline","complete":true,"partial":false,"truncated":false}').cast("binary")
            meta = F.col("metadata") if "metadata" in artifacts.columns else inline
            rows = artifacts.withColumn("metadata", meta).withColumn("metadata_sha256", F.sha2("metadata", 256)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
            names = [f.split(" ")[0] for f in TABLES["artifacts"].split(", ")]
            segment = self._segment(rows.select(*names))
            back = self._open("artifacts", [segment])
            given = F.col("request_id") if "request_id" in receipts.columns else F.lit(None).cast("string")
            linked = self._segment(S.links(S.resequenced(receipts.select("artifact_id", "sequence", given.alias("request_id"), F.col("receipt").cast("binary").alias("receipt")))))
            kept = self._open("receipts", [linked])
            orphans = kept.join(back.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti")
            bad = S.verified(back, -1).where("failure is not null")
            if not (orphans.isEmpty() and bad.isEmpty() and S.oversized(kept).isEmpty()):
                self._fs.delete(self._path(segment), True)
                self._fs.delete(self._path(linked), True)
                raise StoreError("artifact_corrupt")
            self._publish({"artifacts": [segment], "receipts": [linked], "heads": [self._segment(S.heads(kept))], "tombstones": []})
