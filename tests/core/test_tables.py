"""DataFrame operators against the kernel and small models of their own."""

import hashlib
import random
import struct
import time

import pytest
from core.test_kernel import logs
from pyspark.sql import functions as F

from condensa import plan_queries
from condensa.operators import evaluation, focus, kernel, lines, projection, retrieval, shape, spans, store
from condensa.plans import acquisition, codes, hooks, requests, rpc, sql
from condensa.sources import corpus, files, process
from condensa.sources.store import Store, StoreError
from condensa.streaming import intent


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = [logs(rng, rng.randint(0, 60)) for _ in range(60)]
    return {i: t for i, t in enumerate(made + ["", "é\n\n🙂", "no end", "\n", "a\r\nb\r\n", "\u00a0{\n[1]\n", "x" * 70000 + "\n{", None])}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").cache()


def test_lines_have_exact_offsets(docs, texts):
    got = {}
    for r in lines.lines(docs).collect():
        assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.line
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(x) for d, x in got.items()} == {d: s for d, t in texts.items() if t for s in [kernel.line_spans(t.encode())]}


def test_shapes_equal_the_kernel(docs, texts):
    assert {r.doc_id: r["shape"] for r in shape.detect(docs).collect()} == {d: kernel.detect_shape(t) for d, t in texts.items() if t is not None}


def test_focus_scores_equal_the_kernels(docs, texts):
    what = "request code zebra took É"
    got = {(r.doc_id, r.line_no): r.score for r in focus.ranked(lines.lines(docs), what).collect()}
    terms = kernel.focus_terms(what)
    for d, t in texts.items():
        low = [t.encode()[a:b].decode().encode().lower().decode() for a, b in kernel.line_spans(t.encode())] if t else []
        telling = [w for w in terms if 0 < (n := sum(w in x for x in low)) and n * 4 <= len(low)]
        assert [got[d, i] for i in range(len(low))] == [sum(w in x for w in telling) for x in low]


@pytest.mark.parametrize("pattern,before,after,most", [("re", 1, 2, 3), ("e", 0, 0, 8), ("zzz", 2, 2, 2), ("a", 5, 0, 1)])
def test_regions_equal_the_kernel(docs, texts, pattern, before, after, most):
    got = {}
    for r in retrieval.by_pattern(lines.lines(docs), pattern, before, after, most).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(x) for d, x in got.items()} == {d: s for d, t in texts.items() if t and (s := kernel.select_pattern(t.encode(), pattern.encode(), before, after, most))}
    some = {r.doc_id: (r.start, r.end) for r in retrieval.by_lines(lines.lines(docs), 2, 3).collect()}
    assert some == {d: s[0] for d, t in texts.items() if t and (s := kernel.select_lines(t.encode(), 2, 3))}


def test_span_algebra(spark):
    rng = random.Random(2)
    picked = {d: sorted({(a, a + rng.randint(1, 9)) for a in rng.sample(range(80), rng.randint(1, 12))}) for d in range(40)}
    frame = spark.createDataFrame([(d, *s) for d, x in picked.items() for s in x], "doc_id long, start long, end long")
    sizes = spark.createDataFrame([(d, 100) for d in range(42)], "doc_id long, size long")

    def by_doc(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.doc_id, []).append((r.start, r.end))
        return {d: sorted(x) for d, x in out.items()}

    def merged(x):
        out = []
        for a, b in x:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    whole = spans.merge(frame)
    assert by_doc(whole) == {d: merged(x) for d, x in picked.items()}
    left = spans.complement(whole, sizes)
    assert by_doc(left) == {d: kernel.complement(100, merged(picked.get(d, []))) for d in range(42)}
    assert all(r.gapless for r in spans.is_partition(whole.union(left.select(*whole.columns)), sizes).collect())
    assert not any(r.gapless for r in spans.is_partition(whole, sizes).collect() if r.doc_id >= 40)
    wanted = spark.createDataFrame([(d, 3, 17) for d in picked], "doc_id long, start long, end long")
    assert by_doc(spans.translate(whole, wanted)) == {d: t for d, x in picked.items() if (t := kernel.translate(merged(x), [(3, 17)]))}


def test_projection_rows_never_raise(spark, docs, texts):
    out = {r.doc_id: r for r in projection.project(docs, total=300, focus="code").collect()}
    assert len(out) == len(texts)
    for d, t in texts.items():
        try:
            want = kernel.project(t.encode(), total=300, focus="code") if t is not None else None
        except kernel.Refused as e:
            assert out[d].error_code == str(e)
            continue
        if t is None:
            assert out[d].error_code == "invalid_request"
        else:
            assert out[d].visible == want["visible"] and [tuple(s) for s in out[d].retained] == want["retained"] and out[d].applied_profile == want["shape"] + "/v1"
    assert {r.error_code for r in projection.project(docs, unit="tokens").collect()} == {"token_profile_unsupported", "invalid_request"}
    two = [projection.project(docs.repartition(n), total=500).orderBy("doc_id").collect() for n in (1, 5)]
    assert two[0] == two[1]


def test_native_projections_equal_the_kernel(docs, texts):
    assert {r.doc_id: r.visible for r in projection.exact(docs, 500).collect()} == {d: t for d, t in texts.items() if t is not None and len(t.encode()) <= 500}
    for r in projection.prefix(docs, 64).collect():
        assert r.visible == kernel.project(texts[r.doc_id].encode(), "terminal-log/v1", 64)["visible"]


# ---------------------------------------------------------------- store

def chain(receipts):
    head = hashlib.sha256(b"").hexdigest()
    for i, r in enumerate(receipts):
        head = hashlib.sha256(store.CHAIN_DOMAIN + head.encode() + struct.pack(">Q", i) + r).hexdigest()
    return head


def test_chain_equals_hashlib(spark):
    rows = [(a, i, bytearray(f"{a}-{i}".encode())) for a in ("x", "y") for i in range(5)]
    got = {r.artifact_id: r["head"] for r in store.chained(spark.createDataFrame(rows[::-1], "artifact_id string, sequence long, receipt binary")).collect()}
    assert got == {a: chain([f"{a}-{i}".encode() for i in range(5)]) for a in ("x", "y")}


def test_store_life(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), capacity=1000)
    one, two = "1" * 32, "2" * 32
    src = spark.createDataFrame([(one, "hello", 10), (two, "wörld", None)], "id string, source string, ttl long")
    refs = {r.id: r for r in s.commit(src, now=100).collect()}
    assert refs[one].expires_at == 110 and refs[two].expires_at == 100 + store.DEFAULT_TTL and refs[two].source_sha256 == hashlib.sha256("wörld".encode()).hexdigest()
    s.append(spark.createDataFrame([(one, 0, "a"), (two, 0, "b"), (two, 1, "c")], "artifact_id string, place long, receipt string"))
    s.append(spark.createDataFrame([(two, 0, "d")], "artifact_id string, place long, receipt string"))
    rows = s.trace(two, 105).collect()
    assert [bytes(r.receipt) for r in rows] == [b"b", b"c", b"d"] and rows[0]["head"] == chain([b"b", b"c", b"d"]) == rows[2].chain_sha256
    assert s.status(105).first().artifacts == 2
    with pytest.raises(StoreError, match="artifact_unknown"):
        s.resolve("9" * 32, 105)
    with pytest.raises(StoreError, match="artifact_expired"):
        s.resolve(one, 110)
    with pytest.raises(StoreError, match="store_full"):
        s.commit(spark.createDataFrame([("3" * 32, "x" * 999)], "id string, source string"), now=106)
    with pytest.raises(StoreError, match="commit_failed"):
        s.commit(spark.createDataFrame([(two, "again")], "id string, source string"), now=106)
    with pytest.raises(StoreError, match="artifact_unknown"):
        s.append(spark.createDataFrame([("9" * 32, 0, "a")], "artifact_id string, place long, receipt string"))
    with pytest.raises(StoreError, match="artifact_expired"):
        s.retrieve(one, 120)  # and it is collected
    assert s.status(120).first().artifacts == 1 and s.table("receipts").count() == 3 and s.table("heads").count() == 1
    with pytest.raises(StoreError, match="artifact_expired"):
        s.resolve(one, 120)
    s.collect_garbage(120 + store.TOMBSTONE_SECONDS)
    with pytest.raises(StoreError, match="artifact_unknown"):
        s.resolve(one, 120 + store.TOMBSTONE_SECONDS)
    (tmp_path / "s" / "LOCK").touch()
    with pytest.raises(StoreError, match="store_busy"):
        s.collect_garbage(1)


def tampered(s, spark, table, change):
    """The store with another table in place of one of its own."""
    manifest = s._manifest()
    s._publish(manifest | {table: [s._segment(change(s.table(table, manifest)))]})


@pytest.mark.parametrize("table,column,value", [("receipts", "receipt", "x"), ("receipts", "receipt_sha256", "0" * 64), ("receipts", "chain_sha256", "0" * 64), ("receipts", "sequence", 5), ("heads", "head", "0" * 64), ("heads", "receipts", 9), ("heads", "bytes", 9)])
def test_a_changed_lineage_is_noticed(spark, tmp_path, table, column, value):
    s, one = Store(spark, str(tmp_path / "s")), "1" * 32
    s.commit(spark.createDataFrame([(one, "hello")], "id string, source string"), now=100)
    s.append(spark.createDataFrame([(one, 0, "a"), (one, 1, "b")], "artifact_id string, place long, receipt string"))
    assert s.trace(one, 101).count() == 2
    tampered(s, spark, table, lambda df: df.withColumn(column, F.lit(value).cast(df.schema[column].dataType)))
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.trace(one, 101)
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.append(spark.createDataFrame([(one, 0, "c")], "artifact_id string, place long, receipt string"))


def test_metadata_partial_artifacts_and_strict_receipts(spark, tmp_path):
    s, one, two = Store(spark, str(tmp_path / "s")), "1" * 32, "2" * 32
    s.commit(spark.createDataFrame([(one, "hello", "complete"), (two, "wo", "partial")], "id string, source string, state string"), now=100)
    with pytest.raises(StoreError, match="acquisition_failed"):
        s.retrieve(two, 101)
    s.append(spark.createDataFrame([(one, 0, "{}", "r")], "artifact_id string, place long, receipt string, request_id string"))
    assert s.trace(one, 101).count() == 1
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.trace(one, 101, strict=True)  # no receipt of a projection
    tampered(s, spark, "artifacts", lambda df: df.withColumn("metadata", F.lit("{}").cast("binary")))
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.resolve(one, 101)


def test_a_dead_writers_lock_is_taken_over_and_a_living_ones_is_not(spark, tmp_path):
    import os
    import time

    s = Store(spark, str(tmp_path / "s"))
    lock = tmp_path / "s" / "LOCK"
    lock.touch()
    os.utime(lock, (time.time() - 4000,) * 2)
    s.collect_garbage(1)
    assert not lock.exists() and oct((tmp_path / "s").stat().st_mode & 0o777) == "0o700"
    lock.touch()
    with pytest.raises(StoreError, match="store_busy"):
        s.collect_garbage(1)


def test_migration(spark, tmp_path):
    s, one = Store(spark, str(tmp_path / "s")), "1" * 32
    old = spark.createDataFrame([(one, 1, "complete", 5, 500, bytearray(b"hi"), 2, hashlib.sha256(b"hi").hexdigest())], "id string, schema_version int, state string, created_at long, expires_at long, source binary, source_bytes long, source_sha256 string")
    receipts = lambda *rows: spark.createDataFrame(list(rows), "artifact_id string, sequence long, receipt string")
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.migrate(old, receipts(("2" * 32, 0, "a")))
    with pytest.raises(StoreError, match="artifact_corrupt"):
        s.migrate(old.withColumn("source_bytes", F.lit(3).cast("long")), receipts((one, 0, "a")))
    s.migrate(old, receipts((one, 40, "b"), (one, 7, "a")))
    rows = s.trace(one, 100).collect()
    assert [(r.sequence, bytes(r.receipt)) for r in rows] == [(0, b"a"), (1, b"b")] and rows[0]["head"] == chain([b"a", b"b"])
    with pytest.raises(StoreError, match="commit_failed"):
        s.migrate(old, receipts((one, 0, "a")))


def test_corruption_is_told(spark):
    good = ("a", 3, "complete", 200, bytearray(b"x"), 1, hashlib.sha256(b"x").hexdigest())
    rows = [good, ("b", 9, *good[2:]), ("c", 3, "odd", *good[3:]), ("d", 3, "complete", 50, *good[4:]), ("e", *good[1:5], 2, good[6]), ("f", *good[1:6], "0" * 64)]
    frame = spark.createDataFrame(rows, "id string, schema_version int, state string, expires_at long, source binary, source_bytes long, source_sha256 string")
    assert {r.id: r.failure for r in store.verified(frame, 100).collect()} == {"a": None, "b": "artifact_corrupt", "c": "artifact_corrupt", "d": "artifact_expired", "e": "artifact_corrupt", "f": "artifact_corrupt"}


# ---------------------------------------------------------------- sources, requests, evaluation

def test_files_stay_beneath_their_root(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_bytes(b"hi")
    (tmp_path / "d" / "b.bin").write_bytes(b"\xff\x00")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    assert files.beneath(str(tmp_path), "d/f.txt").endswith("d/f.txt")
    for bad in ("", "/etc/passwd", "../x", "d/../d/f.txt", "link/f.txt", "d", "d//f.txt", "none"):
        with pytest.raises(files.Confined):
            files.beneath(str(tmp_path), bad)
    got = {r.path.rsplit("/", 1)[1]: r.error_code for r in files.read_files(spark, str(tmp_path / "d"), True).collect()}
    assert got == {"f.txt": None, "b.bin": "invalid_request"}


def test_files_are_read_beneath_their_root_and_checked_after(spark, tmp_path, monkeypatch):
    import os

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_bytes(b"hi")
    (tmp_path / "d" / "big").write_bytes(b"x" * 30)
    (tmp_path / "link").symlink_to(tmp_path / "d")
    os.mkfifo(tmp_path / "pipe")
    monkeypatch.setattr(files, "MOST_BYTES", 20)
    root = files.Root(str(tmp_path))
    read = files.read_beneath(spark, root, ["d/f.txt", "d/big", "link/f.txt", "../x", "none", "pipe", "d"])
    got = {r.relative_path: (None if r.source is None else bytes(r.source), r.error_code) for r in read.collect()}
    assert got == {"d/f.txt": (b"hi", None), "d/big": (None, "input_too_large"), "link/f.txt": (None, "unsafe_root"), "../x": (None, "unsafe_root"), "none": (None, "acquisition_failed"), "pipe": (None, "acquisition_failed"), "d": (None, "acquisition_failed")}
    late = files.read_beneath(spark, root, ["d/f.txt"])
    (tmp_path / "d" / "f.txt").write_bytes(b"other")
    assert late.first().error_code == "acquisition_failed" and late.first().source is None
    os.rename(tmp_path / "d", tmp_path / "e")
    (tmp_path / "d").symlink_to(tmp_path / "e")
    with pytest.raises(files.Confined):
        root.open("d/f.txt")
    with pytest.raises(files.Confined):
        files.Root(str(tmp_path / "e" / "big"))
    inner = files.Root(str(tmp_path / "e"))
    os.rename(tmp_path / "e", tmp_path / "gone")
    (tmp_path / "e").mkdir()
    with pytest.raises(files.Confined, match="unsafe_root"):
        inner.open("f.txt")  # another directory of that name


def test_streams_are_read_up_to_a_bound():
    import io

    assert files.read_bounded(io.BytesIO(b"abc"), 3) == b"abc"
    with pytest.raises(files.Confined, match="input_too_large"):
        files.read_bounded(io.BytesIO(b"abcd"), 3)


def test_an_oversized_message_spoils_only_itself(spark):
    rows = ['{"jsonrpc":"2.0","id":1,"method":"' + "x" * (1 << 20) + '"}', '{"jsonrpc":"2.0","id":2,"method":"y"}', None]
    got = [(r.kind, r.id, r.error_code) for r in rpc.messages(spark.createDataFrame(list(enumerate(rows)), "i int, value string"), keep=("i",)).orderBy("i").collect()]
    assert got == [("error", "null", -32600), ("request", "2", None), ("error", "null", -32700)]


def test_processes(spark):
    r = process.observe(spark, ["/bin/sh", "-c", "printf out; sleep 0.2; printf err >&2; exit 3"]).first()
    assert (bytes(r.source), r.status, r.exit_code) == (b"outerr", "complete", 3)
    assert [(e.order, e.stream, e.start, e.end) for e in r.events] == [(0, "stdout", 0, 3), (1, "stderr", 3, 6)]
    assert process.run(["/bin/sh", "-c", "sleep 9"], "/", {}, 200)[1] == "partial"
    with pytest.raises(ValueError):
        process.run([], "/", {}, 200)
    for argv, code in ((["/bin/true"] + ["x"] * 4097, "resource_exhausted"), (["/bin/true", "é" * (1 << 19)], "resource_exhausted"), (["/bin/true", "a\0"], "invalid_request"), ([""], "invalid_request")):
        with pytest.raises(ValueError, match=code):
            process.run(argv, "/", {}, 200)


def test_processes_run_beneath_a_root_and_claim_what_holds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = files.Root(str(tmp_path))
    for script, state in (("pwd", "process_complete"), ("exit 3", "process_complete"), ("kill -9 $$", "process_partial"), ("echo x; sleep 9", "process_partial")):
        row = process.observe_beneath(spark, ["/bin/sh", "-c", script], "repo", root, "in", timeout_ms=400)
        got = row.select("source", acquisition.state(F.col("acquisition"), F.octet_length("source")).alias("state"), "acquisition").first()
        assert got.state == state and got.acquisition.process.working_directory == "repo:<2 path bytes>", script
        assert script != "pwd" or bytes(got.source).decode().strip() == str(tmp_path / "in")
    with pytest.raises(files.Confined):
        process.observe_beneath(spark, ["/bin/true"], "repo", root, "..")


def test_requests_are_decoded_strictly(spark):
    rows = [r[0] for r in plan_queries.REQUESTS] + ["", None, '{"a": {"a": 1}, "a": 2}', "{" * 50]
    frame = spark.createDataFrame(list(enumerate(rows)), "i long, value string")
    out = {r.i: r for r in requests.decoded(frame, keep=("i",)).collect()}
    for i, (_, id_, failure, _) in enumerate(plan_queries.REQUESTS):
        assert (out[i].request_id, out[i].failure) == (id_, failure), rows[i]
    assert all(out[i].failure == "invalid_request" for i in range(len(plan_queries.REQUESTS), len(rows)))


def test_exit_codes_cover_every_code():
    assert len(codes.EXIT_CODES) == 18 and set(codes.EXIT_CODES.values()) == {2, 3, 4, 5, 6, 70}


def test_hooks_in_a_stream(spark, tmp_path):
    lines = [e[0].replace("@", "7") for e in plan_queries.EVENTS]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.txt").write_text("\n".join(lines))
    seen = []

    def batch(df, _):
        seen.extend(hooks.events(df).select("kind", "source", "failure").collect())

    q = spark.readStream.text(str(tmp_path / "in")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(str(r.kind) for r in seen) == sorted(str(e[1]) for e in plan_queries.EVENTS)
    with pytest.raises(ValueError):
        hooks.told("loud", F.lit("tool"), F.lit("exact"), F.lit(None), F.lit(""), F.lit(""))


def test_manifests_number_their_lines(spark, tmp_path):
    lines = ['{"id": "a"}', "", "broken", '{"id": "b"}', "[1]"] + [f'{{"id": "x{i}"}}' for i in range(3000)]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.line_no: (r.id, r.malformed) for r in corpus.manifest(spark, str(tmp_path / "m.jsonl"), "id string").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[1] == ("a", False) and got[3][1] and got[4] == ("b", False) and got[5][1] and 2 not in got
    assert all(got[6 + i] == (f"x{i}", False) for i in range(3000))


def test_bounded_fixtures_and_identities(spark):
    cases = [b"short", b"line one\nline two is long", b"no line end at all here", "ääääääääää".encode(), b"\nno other line end", b"\x80" * 40]
    want = [b"short", b"line one\n", b"no line end", "äääää".encode(), b"\nno other l", b""]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary").select("i", corpus.bounded(F.col("b"), 12).alias("x")).collect()
    assert [bytes(r.x.bytes) for r in sorted(got)] == want and [r.x.truncated for r in sorted(got)] == [False] + [True] * 5
    text = "/home/ann/work/x /home/ann/y Ann Lee ann@host.org ann annex ann-1"
    out = spark.range(1).select(corpus.normalised(F.lit(text), {"/home/ann": "<home>", "/home/ann/work": "<work>"}, ("Ann Lee", "<author>"), ("ann", "<user>"))).first()[0]
    assert out == "<work>/x <home>/y <author> dev@example.invalid <user> annex ann-1"


def test_derived_focus(spark):
    rows = ['"text"', '{"command": "ls", "path": "/a", "other": "x"}', '{"query": " "}', "{}", None]
    rows += ['{"command": 5, "path": ["a"], "query": "q"}', '"' + "é" * 200 + '"']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "p string").select(requests.derived_focus(F.col("p"))).collect()]
    assert got == ["text", "ls /a", None, None, None, "q", "é" * 128]


def test_intent_as_of(spark):
    rows = [("s", 0, " find bugs "), ("s", 10, None), ("s", 20, "  "), ("s", 43200, None), ("s", 43201, None), ("t", 5, None)]
    got = {(r.session, r.ts): r.intent for r in intent.as_of(spark.createDataFrame(rows, "session string, ts long, prompt string"), "session", "ts", F.col("prompt")).collect()}
    assert got[("s", 10)] == got[("s", 20)] == got[("s", 43200)] == "find bugs" and got[("s", 43201)] is None and got[("t", 5)] is None


def test_intent_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", 1, " find bugs "), ("s", 2, None), ("t", 1, None), ("s", 3, " ")]
    schema = "session string, ts long, prompt string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    q = intent.stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("intents").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    for _ in range(120):  # state that expires keeps the query busy for ever, so its rows are waited for
        if spark.table("intents").count() >= 2:
            break
        time.sleep(0.5)
    q.stop()
    got = {(r.session, r.ts): r.intent for r in spark.table("intents").collect()}
    assert got[("s", 2)] == "find bugs" and got[("t", 1)] is None


def test_evaluation(spark):
    low, high = spark.range(1).select(*evaluation.wilson(F.lit(50), F.lit(50)), ).first()
    assert abs(low - 0.92865) < 1e-4 and high == 1.0
    got = {(r.doc_id, r.rule) for r in evaluation.secret_scan(spark.createDataFrame([(1, "AKIA" + "A" * 16), (2, "x@y.org password = hunter2hunter"), (3, "clean")], "doc_id long, text string")).collect()}
    assert got == {(1, "aws-access-key")}
    rows = [(1, "password = " + "a1" * 12), (2, "password = short"), (3, "see /home/ann/x and ann@host.org"), (4, "/home/dev/x dev@example.invalid")]
    seen = {(r.doc_id, r.rule) for r in evaluation.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"), rules=evaluation.SECRETS | evaluation.IDENTITIES).collect()}
    assert seen == {(1, "secret-assignment"), (3, "home-path"), (3, "email")}
    seen = spark.createDataFrame([(1, "abc"), (2, "x")], "k long, visible string")
    facts = spark.createDataFrame([(1, "b"), (1, "z")], "k long, fact string")
    assert {r.k: r.recall for r in evaluation.fact_recall(seen, facts, "k").collect()} == {1: 0.5, 2: 1.0}


def test_acquisitions(spark):
    cover = lambda events, n: spark.createDataFrame([(events,)], "e array<struct<order: long, stream: string, start: long, end: long>>").select(acquisition.events_cover(F.col("e"), F.lit(n))).first()[0]
    assert cover([], 0) and cover([(0, "stdout", 0, 3), (1, "stderr", 3, 6)], 6)
    for bad in ([(0, "stdout", 0, 3), (2, "stderr", 3, 6)], [(0, "stdout", 0, 3), (1, "stderr", 4, 6)], [(0, "stdout", 0, 3)], [(0, "x", 0, 6)], []):
        assert not cover(bad, 6)
    rows = [(c[0], c[1], c[2]) for c in plan_queries.CLAIMS]
    got = spark.createDataFrame(rows, "c string, n long, want string").select("want", acquisition.state(F.from_json("c", acquisition.RECEIPT), F.col("n")).alias("got"), "c").collect()
    assert all(r.want == r.got for r in got), [r for r in got if r.want != r.got]
    assert {r.got for r in got} - {None} == set(acquisition.STATES)
    assert spark.range(1).select(acquisition.path_summary(F.lit("/é"))).first()[0] == "<3 path bytes>"


def test_lateral_projection(spark, docs, texts):
    sql.register(spark)
    docs.createOrReplaceTempView("some_docs")
    got = {r.doc_id: r for r in spark.sql("select d.doc_id, p.* from some_docs d, lateral project_text(d.text, 'auto/v1', 300, 0, null) p").collect()}
    want = {r.doc_id: r for r in projection.project(docs, total=300).collect()}
    assert {d: (r.visible, r.retained, r.omitted, r.error_code) for d, r in got.items()} == {d: (r.visible, r.retained, r.omitted, r.error_code) for d, r in want.items()}


def test_fixtures(spark):
    rows = [(0, ("utf8", "hé", None, None, None)), (1, ("base64", None, "YQ==", None, None)), (2, ("base64", None, "YR==", None, None)), (3, ("padded", "ab", None, "xyz", 7)), (4, ("padded", "abc", None, "x", 2)), (5, ("odd", "a", None, None, None))]
    got = {r.i: None if r.b is None else bytes(r.b) for r in spark.createDataFrame(rows, f"i int, p {corpus.PAYLOAD}").select("i", corpus.materialised(F.col("p")).alias("b")).collect()}
    assert got == {0: "hé".encode(), 1: b"a", 2: None, 3: b"abxyzxy", 4: None, 5: None}
    events = [(1, ("utf8", "b", None, None, None)), (0, ("utf8", "a", None, None, None))]
    assert bytes(spark.createDataFrame([(events,)], f"e array<struct<order: int, payload: {corpus.PAYLOAD}>>").select(corpus.joined_events(F.col("e"))).first()[0]) == b"ab"
    facts = lambda *x: [(f"f{i}", c, n) for i, (c, n) in enumerate(x)]
    made = [("ok", "a b", facts(("P0", "a")), "s"), ("gone", "a", facts(("P0", "z")), "s"), ("class", "a", facts(("P9", "a")), "s"), ("budget", "a", facts(("P1", "a")), "t"), ("twice", "a", [("f", "P0", "a"), ("f", "P1", "a")], "s")]
    frame = spark.createDataFrame(made, "id string, source string, facts array<struct<id: string, class: string, needle: string>>, budget string").withColumn("budgets", F.array(F.lit("s")))
    assert {r.id: r.problem for r in corpus.invalid(frame).collect()} == {"gone": "absent_fact", "class": "unknown_class", "budget": "unknown_budget", "twice": "repeated_fact"}
