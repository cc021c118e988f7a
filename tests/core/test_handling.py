"""Requests that run: every row has its own profile, budget and selector, and gets what the kernel gives for it alone."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from condensa.operators import kernel, store
from condensa.plans import handling

NOW = 1000
TEXT = "start\n" + "".join(f"line {i} {'error: broken' if i % 40 == 7 else 'fine'}\n" for i in range(200)) + "end\n"
SOURCES = {"a" * 32: TEXT.encode(), "b" * 32: b"\xff\x00bin\n", "c" * 32: b"", "d" * 32: "été\nλ = 1\nλ = 2\n".encode()}
HELD = "id string, schema_version int, state string, source binary, source_sha256 string, source_bytes long, created_at long, expires_at long"


def reference(id_, **changes):
    source = SOURCES.get(id_, b"")
    return {"schema_version": "artifact/v3", "id": id_, "source_sha256": hashlib.sha256(source).hexdigest(), "source_bytes": len(source), "created_at": 1, "expires_at": 5000} | changes


def request(source, total=300, reserved=20, profile="auto/v1", version="v3", **more):
    return {"contract_version": version, "request_id": "r", "source": source, "budget": {"unit": "bytes", "total_visible_limit": total, "reserved_envelope": reserved}, "preservation_profile": profile} | more


def of(id_, selector=None, **changes):
    return {"kind": "artifact", "artifact": reference(id_, **changes)} | ({"selector": selector} if selector else {})


def b64(raw):
    return base64.b64encode(raw).decode()


def artifacts(spark, **changes):
    rows = [(i, 3, "complete", bytearray(s), hashlib.sha256(s).hexdigest(), len(s), 1, 5000) for i, s in SOURCES.items()]
    return spark.createDataFrame(rows, HELD)


def run(spark, asked, held=None, dead=()):
    lines = spark.createDataFrame([(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(asked)], "id long, value string")
    told = handling.handled(lines, held if held is not None else artifacts(spark), spark.createDataFrame(list(dead), "id string, purge_at long"), NOW)
    return sorted(told.collect(), key=lambda r: r.id)


@pytest.mark.parametrize("block", [512, 4])
def test_each_row_has_its_own_rule(spark, monkeypatch, block):
    monkeypatch.setattr(handling, "BLOCK", block)
    asked, want = [], []
    for i in range(60):  # one hot artifact
        total, profile, focus = 120 + 37 * i, ["auto/v1", "build-log/v1", "json/v1", "source-code/v1"][i % 4], "line 150" if i % 5 == 0 else None
        asked.append(request(of("a" * 32), total, 20, profile, **({"focus": focus} if focus else {})))
        try:
            want.append(kernel.project(SOURCES["a" * 32], profile, total, 20, focus)["visible"])
        except kernel.Refused as refused:
            want.append(str(refused))
    for n, pattern in enumerate([b"error", b"fine\nline 3", "λ".encode(), b"nowhere"]):
        id_ = "d" * 32 if n == 2 else "a" * 32
        asked.append(request(of(id_, {"kind": "pattern", "pattern": b64(pattern), "before_lines": 1, "after_lines": 0, "max_matches": 3}), 400))
        source = SOURCES[id_]
        want.append(kernel.project_selection(source, kernel.select_pattern(source, pattern, 1, 0, 3), "auto/v1", 400, 20)["visible"])
    asked.append(request(of("b" * 32)))
    want.append(kernel.project(SOURCES["b" * 32], "auto/v1", 300, 20)["visible"])
    asked.append(request(of("c" * 32), 20, 20))
    want.append("")
    asked.append(request({"kind": "inline", "bytes": b64(TEXT.encode())}, 500, 0))
    want.append(kernel.project(TEXT.encode(), "auto/v1", 500)["visible"])
    got = run(spark, asked)
    assert [r.error_code or r.visible for r in got] == want
    for r in got:
        body = json.loads(r.envelope)
        assert (r.exit_code == 0) == ("error" not in body) == (r.receipt is not None)
        if r.error_code is None:
            receipt = json.loads(r.receipt)
            assert receipt["artifact"] == body["artifact"] == r.artifact.asDict() and body["source"]["variant"] == receipt["acquisition"]["variant"] == ("inline" if r.id == len(asked) - 1 else "artifact")
            assert receipt["visible_count"] == len(r.visible.encode()) == body["accounting"]["visible"]


def test_what_decides_first(spark):
    a = "a" * 32
    held = artifacts(spark)
    odd = spark.createDataFrame([("e" * 32, 9, "complete", bytearray(b""), reference("e" * 32)["source_sha256"], 0, 1, 5000), ("f" * 32, 3, "partial", bytearray(b""), reference("f" * 32)["source_sha256"], 0, 1, 5000), ("1" * 32, 3, "complete", bytearray(b"x"), reference("1" * 32)["source_sha256"], 0, 1, 5000), ("2" * 32, 3, "complete", bytearray(b""), reference("2" * 32)["source_sha256"], 0, 1, NOW), ("3" * 32, 3, "began", bytearray(b""), reference("3" * 32)["source_sha256"], 0, 1, 5000)], HELD)
    cases = [
        (None, "invalid_request"), ("", "invalid_request"), ("[]", "invalid_request"), (request(of(a), version="v1"), "schema_unsupported"), (request({"kind": "socket"}), "source_unsupported"),
        (request(of(a), profile="other/v1"), "invalid_request"), (request(of(a, schema_version="artifact/v2")), "artifact_schema_unsupported"), (request(of(a, created_at=2)), "artifact_corrupt"), (request(of(a, source_sha256="0" * 64)), "artifact_corrupt"),
        (request(of("9" * 32)), "artifact_unknown"), (request(of("8" * 32)), "artifact_expired"), (request(of("7" * 32)), "artifact_unknown"), (request(of("e" * 32)), "artifact_schema_unsupported"), (request(of("f" * 32)), "acquisition_failed"),
        (request(of("f" * 32, created_at=9)), "artifact_corrupt"), (request(of("1" * 32)), "artifact_corrupt"), (request(of("2" * 32)), "artifact_expired"), (request(of("3" * 32)), "commit_failed"), (request(of(a), 20, 20), "budget_unsatisfiable"),
        (request({"kind": "inline", "bytes": b64(b"x" * 90)}, retention={"expires_at": NOW}), "invalid_request"), (request(of(a, {"kind": "lines", "start_line": 1, "line_count": 1}), version="v2"), "schema_unsupported"),
    ]
    got = run(spark, [c for c, _ in cases], held.union(odd), [("8" * 32, NOW + 1), ("7" * 32, NOW)])
    assert [r.error_code for r in got] == [w for _, w in cases]
    assert [r.artifact is not None for r in got] == [w == "budget_unsatisfiable" for _, w in cases]


def test_inline_artifacts_expire_as_asked_and_tokens_want_their_file(spark):
    asked = [request({"kind": "inline", "bytes": b64(b"x" * 100)}, retention=r) for r in ({"ttl_seconds": 5}, {"expires_at": 2000}, {})]
    asked.append(request({"kind": "inline", "bytes": ""}) | {"budget": {"unit": "tokens", "total_visible_limit": 9, "reserved_envelope": 0, "token_profile": "cl100k_base@js-tiktoken-1.0.15"}})
    got = run(spark, asked)
    assert [r.artifact and r.artifact.expires_at for r in got] == [NOW + 5, 2000, NOW + store.DEFAULT_TTL, None] and got[3].error_code == "token_profile_unsupported"
    rows = handling.receipt_rows(handling.handled(spark.createDataFrame([(1, json.dumps(asked[0]))], "id long, value string"), artifacts(spark), spark.createDataFrame([], "id string, purge_at long"), NOW)).collect()
    assert len(rows) == 1 and hashlib.sha256(rows[0].receipt.encode()).hexdigest() == rows[0].receipt_sha256


def test_no_requests_and_a_source_once_a_block(spark, monkeypatch):
    assert run(spark, []) == []
    monkeypatch.setattr(handling, "BLOCK", 8)
    lines = spark.createDataFrame([(i, json.dumps(request(of("a" * 32)))) for i in range(64)], "id long, value string")
    plan = handling.handled(lines, artifacts(spark), spark.createDataFrame([], "id string, purge_at long"), NOW)
    assert plan.count() == 64 and "Cartesian" not in plan._jdf.queryExecution().toString()


def test_base64_of_any_length(spark):
    from condensa.functions.text import base64_canonical

    raw = [bytes(i % 251 for i in range(n)) for n in (0, 1, 57, 58, 76, 77, 1000)]
    got = spark.createDataFrame([(i, b64(r)) for i, r in enumerate(raw)] + [(7, b64(raw[4])[:40] + "\r\n" + b64(raw[4])[40:]), (8, "YQ"), (9, "YR==")], "i int, b string").select("i", base64_canonical(F.col("b")).alias("x")).collect()
    assert [None if r.x is None else bytes(r.x) for r in sorted(got)] == [*raw, None, None, None]
