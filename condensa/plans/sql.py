"""Projection inside SQL: SELECT ... FROM documents, LATERAL project_text(text, 'auto/v1', 8192, 0, NULL)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import kernel
from ..sources.files import MOST_BYTES


_SPANS = "array<struct<start: long, end: long>>"


@udtf(returnType=f"fidelity string, applied_profile string, original_count long, visible_count long, visible string, retained {_SPANS}, omitted {_SPANS}, error_code string", useArrow=True)
class ProjectText:
    """One row a call; a refused text is a row with its error_code. Rows come and go in Arrow batches."""

    def eval(self, text: str, profile: str, total: int, reserved: int, focus: str):
        try:
            if text is None:
                raise kernel.Refused("invalid_request")
            source = text.encode("utf-8", "surrogatepass")
            if len(source) > MOST_BYTES:
                raise kernel.Refused("input_too_large")
            r = kernel.project(source, profile, total, reserved, focus)
        except kernel.Refused as refused:
            yield None, None, None, None, None, None, None, str(refused)
        else:
            yield r["fidelity"], f"{r['shape']}/v1", r["original_count"], r["visible_count"], r["visible"], r["retained"], r["omitted"], None


def register(spark: SparkSession, name: str = "project_text") -> None:
    spark.udtf.register(name, ProjectText)
