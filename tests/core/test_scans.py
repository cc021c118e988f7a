"""Scans over whole documents in batches of any size, against plain loops."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensa.functions.predicates import Line, PyLine
from condensa.operators import kernel, lines, retrieval, scans, store

BITS = ["diff --git a b\n", "@@ -1 +1 @@\n", "+x\n", "-y\n", "fn main() {\n", "error: bad\n", "click\n", "\n", "plain words\n", "class A:\n", "é click\n", "def f():\n"]


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(i, "".join(rng.choices(BITS, k=rng.choice([0, 1, 2, 9, 40]))).rstrip("\n") + rng.choice(["", "\n"])) for i in range(n)]


@pytest.fixture(params=[10_000, 3])
def batched(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield spark
    spark.conf.set(key, before)


def test_sections_and_caps_equal_loops(batched):
    rows = texts(1) + [(7, "class B:\nclick\n"), (100, "x\n" * 500), (101, None), (102, "")]
    docs = batched.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    cut = lines.lines(docs.select("row", "text"), "row")
    text_of = {r.row: r.text for r in docs.collect()}
    ranked, admitted = {}, {}
    for row, text in text_of.items():
        each = [text.encode()[a:b].decode() for a, b in kernel.line_spans(text.encode())] if text else []
        opens = [PyLine(x).opens_section for x in each]
        depth = max(256 // max(sum(opens), 1), 1)
        section = rank = kinds = hits = 0
        for n, (line, open_) in enumerate(zip(each, opens)):
            section, rank = section + open_, 0 if open_ else rank + 1
            ranked[row, n] = (bool(open_), section, rank)
            kind, hit = "error" in line and rank <= depth, "click" in line
            kinds, hits = kinds + kind, hits + hit
            if (kind and kinds <= 4) or (hit and hits <= 4):
                admitted[row, n] = (kind and kinds <= 4, hit and hits <= 4)
    assert {(r.row, r.line_no): (r.opens, r.section, r["rank"]) for r in lines.section_ranks(cut, "row").collect()} == ranked
    got = lines.admitted(cut, F.col("line").contains("error"), F.col("line").contains("click"), True, 4, "row")
    assert {(r.row, r.line_no): (r.by_kind, r.by_focus) for r in got.collect()} == admitted
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert Line(F.col("line")).opens_section is not None


@pytest.mark.parametrize("sizes", [[5], [1] * 12, [3, 4, 5], [0, 12], []])
def test_documents_come_whole(sizes):
    numbers = [0, 1, 2, 0, 0, 1, 0, 1, 2, 3, 4, 0]
    rows, at, given = pa.record_batch({"line_no": pa.array(numbers, pa.int32())}), 0, []
    for n in [*sizes, len(numbers)]:
        given.append(rows.slice(at, n))
        at += n
    out = [b.column(0).to_pylist() for b in scans.whole_documents(g for g in given if g.num_rows)]
    assert sum(out, []) == numbers and all(b[0] == 0 for b in out)


@pytest.mark.parametrize("pattern", ["click", "click\n", ".\nT", "\n\n", "words\nplain", "x\nx", "é click\ndef f", "none"])
def test_any_literal_equals_the_kernel(batched, pattern):
    rows = texts(2) + [(200, "x\n" * 50), (200, "x\nx\nx"), (201, None), (202, ""), (None, "a click\nb\nc\nd click\n"), (203, "click")]
    docs = batched.createDataFrame(rows, "doc_id long, text string")
    for before, after, most in ((2, 2, 8), (0, 0, 2), (1, 3, 1)):
        want = sorted(((-1 if i is None else i), *r) for i, t in rows if t for r in kernel.select_pattern(t.encode(), pattern.encode(), before, after, most))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.end) for r in retrieval.by_text(docs, pattern, before, after, most).collect()) == want
    with pytest.raises(ValueError):
        retrieval.by_text(docs, "")


def test_a_hot_lineage_is_verified_link_by_link(spark, tmp_path):
    made = [("hot", i) for i in range(400)] + [(f"a{i % 200}", i // 200) for i in range(800)]
    rows = spark.createDataFrame([(a, n, f"r{a}{n}", bytearray(f'{{"request_id":"r{a}{n}"}}'.encode())) for a, n in made], "artifact_id string, sequence long, request_id string, receipt binary")
    store.links(rows).write.parquet(str(tmp_path / 'linked'))
    linked = spark.read.parquet(str(tmp_path / 'linked'))
    claims = store.heads(linked)
    assert store.verified_lineages(linked, claims).where("failure is not null").count() == 0
    for spoil in (
        F.when((F.col("artifact_id") == "hot") & (F.col("sequence") == 200), F.lit("0" * 64)).otherwise(F.col("chain_sha256")),
        F.when((F.col("artifact_id") == "hot") & (F.col("sequence") == 399), F.lit(None)).otherwise(F.col("chain_sha256")),
    ):
        bad = store.verified_lineages(linked.withColumn("chain_sha256", spoil), claims).where("failure is not null").collect()
        assert [(r.artifact_id, r.failure) for r in bad] == [("hot", "artifact_corrupt")]
    for bad in (linked.where("not (artifact_id = 'hot' and sequence = 7)"), linked.union(linked.where("artifact_id = 'hot' and sequence = 7")), linked.withColumn("receipt", F.when((F.col("artifact_id") == "hot") & (F.col("sequence") == 0), F.lit(b"{}")).otherwise(F.col("receipt")))):
        assert [r.artifact_id for r in store.verified_lineages(bad, claims).where("failure is not null").collect()] == ["hot"]
    plan = store.verified_lineages(linked, claims)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
