"""Projection of documents: native plans where no sequential choice is made, the kernel elsewhere."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import byte_prefix
from . import kernel
from .scans import pieces, spread

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lines", pa.int64())]))
RESULT = (
    "fidelity string, applied_profile string, original_count long, visible_count long, visible string, "
    "retained array<struct<start: long, end: long>>, omitted array<struct<start: long, end: long>>, fact_ids array<string>, "
    "aggregates array<struct<start: long, end: long, lines: long>>, error_code string"
)


def token_counter(ranks_path: str | None) -> Callable[[bytes], int] | None:
    """Counts ordinary tokens by a local ranks file of the profile's vocabulary; none without a file."""
    if ranks_path is None:
        return None
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
    model = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda b: len(model.encode_ordinary(b.decode()))


def project(
    docs: DataFrame, key: str = "doc_id", text: str = "text", profile: str = "auto/v1", total: int = 8192, reserved: int = 0,
    focus: Column | str | None = None, unit: str = "bytes", ranks_path: str | None = None, selector: dict | None = None, label: str = kernel.LABEL, keep: tuple = (),
) -> DataFrame:
    """key, the columns `keep` and the columns of RESULT for every row; a row never raises but carries its error_code.

    `text` is a string or binary column (null: error_code invalid_request). `focus` is a string for all rows or a
    column. `selector` is {"lines": (first, number)} or {"pattern": (text, before, after, most)}. Token budgets need
    the vocabulary's ranks file; without one every row is refused with token_profile_unsupported. Whole documents go
    to the kernel in Arrow batches; only a table of fewer splits than cores is dealt anew.
    """

    spec = {"profile": profile, "total": total, "reserved": reserved, "unit": unit, "selector": selector}

    def run(batches):
        count = token_counter(ranks_path) if unit == "tokens" else None
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            rows = [_one(source, spec | {"focus": about}, count, label) for source, about in zip(batch.column("source").to_pylist(), batch.column("focus").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(f"_{c}") for c in keep), *_columns(rows)], names=[key, *keep, *_NAMES])

    about = focus if isinstance(focus, Column) else F.lit(focus).cast("string")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return spread(docs.select(F.col(key).alias("key"), F.col(text).alias("source"), about.alias("focus"), *(F.col(c).alias(f"_{c}") for c in keep))).mapInArrow(run, f"{kinds}, {RESULT}")


def _one(source, spec: dict, count, label: str = kernel.LABEL) -> tuple:
    """The columns of RESULT for one source under a spec: profile, total, reserved, unit, focus, selector."""
    if source is None:
        return (*[None] * 9, "invalid_request")
    source = source.encode("utf-8", "surrogatepass") if isinstance(source, str) else source
    rule = spec["profile"], spec["total"], spec["reserved"], spec["focus"], count
    try:
        if spec["unit"] == "tokens" and count is None:
            raise kernel.Refused("token_profile_unsupported")
        if len(source) > 10 * 1024 * 1024:
            raise kernel.Refused("input_too_large")
        if selector := spec["selector"]:
            if "lines" in selector:
                regions = kernel.select_lines(source, *selector["lines"])
            else:
                what, *rest = selector["pattern"]
                regions = kernel.select_pattern(source, what.encode() if isinstance(what, str) else what, *rest)
            out = kernel.project_selection(source, regions, *rule)
        else:
            out = kernel.project(source, *rule, label=label)
    except kernel.Refused as refused:
        return (*[None] * 9, str(refused))
    spans = lambda xs: [{"start": a, "end": b} for a, b in xs]
    runs = [{"start": a, "end": b, "lines": n} for a, b, n in out["aggregates"]]
    return out["fidelity"], f"{out['shape']}/v1", out["original_count"], out["visible_count"], out["visible"], spans(out["retained"]), spans(out["omitted"]), out["fact_ids"], runs, None


_NAMES = [f.split(" ")[0] for f in RESULT.replace("struct<start: long, end: long>", "s").replace("struct<start: long, end: long, lines: long>", "s").split(", ")]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), _SPAN, _SPAN, pa.list_(pa.string()), _RUN, pa.string()]
    return [pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [[]] * 10, kinds)]


#: What a row asks for: `refused` is the code of a request that was refused before, so that it comes out with the others.
SPEC = (
    "refused: string, profile: string, unit: string, total: long, reserved: long, focus: string, "
    "selector: struct<kind: string, start_line: long, line_count: long, pattern: binary, before_lines: long, after_lines: long, max_matches: long>"
)


def project_each(blocks: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """A row for each spec of every block (source: binary or string, specs: array of structs that hold spec, of SPEC, and
    whatever else comes along): the struct's other fields and the columns of RESULT.

    Profile, budget, unit, focus and selector are the row's own. A source is read once for all specs of its block, and
    projected once for those that are the same. A null source gives invalid_request to the specs that aren't refused already; a block without specs gives no rows.
    """
    item = blocks.schema["specs"].dataType.elementType
    kept = [f for f in item.fields if f.name != "spec"]

    def selector(told: dict | None) -> dict | None:
        if told is None:
            return None
        names = ("start_line", "line_count") if told["kind"] == "lines" else ("pattern", "before_lines", "after_lines", "max_matches")
        return {told["kind"]: tuple(told[n] for n in names)}

    def run(batches):
        count = token_counter(ranks_path)
        for batch in batches:
            told = batch.column("specs")
            flat, rows = told.flatten(), []
            of = pa.compute.list_parent_indices(told).to_pylist()
            sources = batch.column("source").to_pylist()
            block, known = -1, {}
            for i, spec in zip(of, flat.field("spec").to_pylist()):
                if i != block:
                    block, known = i, {}
                if spec["refused"]:
                    rows.append((*[None] * 9, spec["refused"]))
                    continue
                asked = spec | {"selector": selector(spec["selector"])}
                as_asked = json.dumps(asked, default=bytes.hex)
                if as_asked not in known:
                    known[as_asked] = _one(sources[i], asked, count)
                rows.append(known[as_asked])
            yield pa.RecordBatch.from_arrays([*(flat.field(f.name) for f in kept), *_columns(rows)], names=[*(f.name for f in kept), *_NAMES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return blocks.select("source", "specs").mapInArrow(run, f"{schema}, {RESULT}")


def repeated_runs(docs: DataFrame, shape: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, lines): the runs of repeated ordinary lines that a note could stand for, before any is chosen.

    Templates are learned line by line, so each document is one call of the kernel; documents go in Arrow batches.
    """

    def run(batches):
        for batch in batches:
            rows = [(k, *r) for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in kernel.runs_of(source.encode("utf-8", "surrogatepass"), shape)]
            cells = list(zip(*rows)) if rows else [[]] * 4
            kinds = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=[key, "start", "end", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, end long, lines long")


def exact(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that fit the budget, as they are: a filter, with the length pushed next to the scan."""
    size = F.octet_length(text).cast("long")
    return docs.where(size <= limit).select(key, F.lit("exact").alias("fidelity"), size.alias("original_count"), size.alias("visible_count"), F.col(text).alias("visible"))


def prefix(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The prefix projection of one-line documents over the budget under a shape without mandatory lines."""
    only = F.locate("\n", F.col(text)).isin(0) | (F.locate("\n", F.col(text)) == F.length(text))
    over = docs.where((F.octet_length(text) > limit) & only)
    cut = byte_prefix(F.col(text), limit)
    return over.select(key, F.lit("extractive").alias("fidelity"), F.octet_length(text).cast("long").alias("original_count"), F.octet_length(cut).cast("long").alias("visible_count"), cut.alias("visible"))


def policies(spark) -> DataFrame:
    """The closed policy table, twenty rows: profile, shape (null: detect), applied_profile."""
    return spark.createDataFrame([(k, v, f"{v}/v1" if v else None) for k, v in P.PROFILES.items()], "profile string, shape string, applied_profile string")


def with_policy(spark, requests: DataFrame) -> DataFrame:
    """Requests (profile, ...) with the shape of their policy (null: detect) and error_code invalid_request where there is none."""
    known = policies(spark).select("profile", "shape", F.lit(True).alias("_known"))
    return requests.join(F.broadcast(known), "profile", "left").withColumn("error_code", F.when(F.col("_known").isNull(), "invalid_request")).drop("_known")
