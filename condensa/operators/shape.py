"""The shape of a document: features counted over its first lines, then the first test that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import Line, ascii_lower, trim_start
from ..functions.text import byte_prefix
from .scans import spread

FEATURES = ("lines", "json_structural", "hunk_headers", "diff_headers", "diff_changes", "frames", "project_frames", "exceptions", "tests", "diagnostics", "errors", "path_headers", "progress", "code")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, opens_json, shebang, the 14 features) per document with text.

    The prefix is cut before anything is exploded, so a long document costs no more than its prefix; counts are
    combined before the shuffle.
    """
    head = spread(docs.where(F.col(text).isNotNull()).select(key, byte_prefix(F.col(text), P.PREFIX_BYTES).alias("head")))
    rows = F.slice(F.regexp_extract_all("head", F.lit(P.LINE), F.lit(0)), 1, P.PREFIX_LINES)
    opens = F.substring(trim_start(F.col("head")), 1, 1).isin("{", "[")
    each = head.select(key, opens.alias("opens_json"), F.col("head").startswith("#!").alias("shebang"), F.explode_outer(rows).alias("line"))
    line = F.col("line")
    each = each.withColumn("line", F.when(line.endswith("\r\n"), F.substr(line, F.lit(1), F.char_length(line) - 2)).otherwise(F.rtrim(line, F.lit("\n"))))
    x = Line(F.col("line"))
    x.raw = F.col("line")
    each = each.select(key, "opens_json", "shebang", x.raw.alias("raw"), x.trimmed.alias("trimmed"))
    x.raw, x.trimmed = F.col("raw"), F.col("trimmed")
    each = each.withColumn("text", ascii_lower(x.trimmed))
    x.text = F.col("text")
    each = each.withColumn("loud", x.loud).withColumn("marked", F.substring("raw", 1, 1).isin("@", "+", "-", "d", "i"))
    loud, marked = F.col("loud"), F.col("marked")
    # What several features need is worked out once a line.
    each = each.select("*", (marked & x.diff_header).alias("header"), (loud & x.lowered("frame")).alias("frame"), (loud & x.error_diagnostic).alias("error"))
    header, frame, error = F.col("header"), F.col("frame"), F.col("error")
    hits = {
        "lines": F.lit(True), "json_structural": loud & x.lowered("json_structural"), "hunk_headers": marked & x.hunk_header, "diff_headers": header,
        "diff_changes": marked & ~header & x.diff_change, "frames": frame, "project_frames": frame & ~x.lowered("library_path"),
        "exceptions": loud & x.lowered("exception_header"), "tests": loud & (x.lowered("test_failure") | x.lowered("test_summary") | x.lowered("test_case")),
        "diagnostics": error | (loud & (x.warning_diagnostic | x.lowered("diagnostic_detail"))), "errors": error,
        "path_headers": x.path_header, "progress": loud & x.lowered("progress"), "code": x.code,
    }
    filled = F.col("trimmed").isNotNull() & (F.col("trimmed") != "")
    return each.groupBy(key).agg(F.first("opens_json").alias("opens_json"), F.first("shebang").alias("shebang"), *(F.count_if(filled & hit).alias(name) for name, hit in hits.items()))


def decision() -> Column:
    """The shape by the columns of features(); the order of the tests is part of the meaning."""
    c, n = F.col, F.greatest(F.col("lines"), F.lit(1))
    return (
        F.when(c("opens_json") & (c("json_structural") * 5 >= n * 3), "api-json")
        .when((c("hunk_headers") >= 1) & (c("diff_headers") >= 1), "unified-diff")
        .when((c("frames") >= 2) & (c("exceptions") >= 1) & (c("tests") < 2) & ((c("frames") >= 3) | (c("project_frames") >= 1)), "stack-trace")
        .when((c("tests") >= 2) | ((c("tests") >= 1) & (c("tests") * 4 >= n)), "test-output")
        .when(((c("diagnostics") >= 1) | (c("path_headers") >= 1)) & (c("progress") >= 1) & (c("errors") >= 1), "build-output")
        .when((c("diagnostics") >= 1) | (c("path_headers") >= 1), "typecheck-lint")
        .when((c("hunk_headers") == 0) & (c("diff_changes") * 2 >= n), "typecheck-lint")
        .when(c("progress") * 3 >= n, "build-output")
        .when(c("shebang") | (c("code") * 5 >= n * 2), "source-file")
        .otherwise("terminal-log")
    )


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shape) of every document with text."""
    return features(docs, key, text).select(key, decision().alias("shape"))
