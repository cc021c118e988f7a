"""What queries cost as tables grow: each line parsed once, each source rendered once, no task that gets all rows, bounded batches."""

import json
import time

import pyarrow as pa
import pytest
from core.test_handling import NOW, artifacts, of, request
from pyspark.sql import functions as F

from condensa.operators import lines, shape
from condensa.plans import handling
from condensa.queries import QUERIES
from condensa.sources import corpus

SF = "/root/testdata/sf0.001"


def planned(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_refused_requests_do_not_meet_in_one_task(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(i, "nope" if i % 9 else json.dumps(request(of("a" * 32)))) for i in range(200)], "id long, value string")
        out = handling.handled(asked, artifacts(spark), spark.createDataFrame([], "id string, purge_at long"), NOW)
        told = out.where("error_code = 'invalid_request'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in told) == 177 and max(r["count"] for r in told) < 100


def test_requests_are_parsed_once(spark):
    assert planned(QUERIES["request_validation"](spark, SF)).count("from_json") == 1


@pytest.mark.parametrize("name", ["project_focus_checked", "project_auto_checked"])
def test_checked_projections_render_their_sources_once(spark, name):
    assert planned(QUERIES[name](spark, SF)).count("Relation [") == 1


def test_small_rows_that_become_large_are_dealt(spark):
    assert QUERIES["process_validation"](spark, SF).rdd.getNumPartitions() > 1


def test_long_words_are_normalised_in_linear_time(spark):
    begin = time.monotonic()
    texts = ["a" * 150_000, "a" * 150_000 + " @ x@y.org_z@y.org @", "ann" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", corpus.normalised(F.col("t"), {}, None, ("ann", "<user>")).alias("t")).sort("i").collect()
    assert [r.t for r in got] == [texts[0], "a" * 150_000 + " @ dev@example.invaliddev@example.invalid @", texts[2]] and time.monotonic() - begin < 20


def test_forms_of_a_line_are_worked_out_once(spark):
    assert planned(QUERIES["rendered_classes"](spark, SF)).count("translate(") <= 2


def test_shapes_trim_without_patterns(spark):
    docs = spark.createDataFrame([(1, "　 a\r\n b\r\r\n\n")], "doc_id long, text string")
    assert "regexp_replace" not in planned(shape.detect(docs)) and shape.features(docs).first().lines == 2


def test_lines_are_cut_in_bounded_batches():
    texts = ["line\n" * 40_000] * 30 + [None, "", "x" * (3 << 20)] + ["a\nb"] * 1000
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    made = list(lines._cut([batch]))
    assert max(b.num_rows for b in made) <= 5 * 40_000 + 40_000 + 512 and sum(b.num_rows for b in made) == 30 * 40_000 + 1 + 2000
    assert max(len(set(b.column(0).to_pylist())) for b in made) <= 256


def test_projections_come_in_bounded_batches(spark):
    from condensa.operators import scans

    batch = pa.record_batch([pa.array(range(5)), pa.array(["x" * 600_000, "y", None, "z" * 600_000, "w" * (2 << 20)])], names=["key", "source"])
    assert [p.column(0).to_pylist() for p in scans.pieces(batch, 1)] == [[0, 1, 2], [3], [4]]
    assert [p.num_rows for p in scans.pieces(batch.slice(1, 2), 1)] == [2] and not list(scans.pieces(batch.slice(0, 0), 1))
