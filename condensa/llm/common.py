"""What the operators share: the cluster's shared folder, staged tables, word hashing, components.

Conventions of all operators: the id column is read as long; a null text counts as empty unless an
operator says otherwise; only the columns named in a signature are read, so extra columns, whatever
their names, neither clash nor change a result.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- shared folder

def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process (tests).

    On a cluster executors wouldn't find each other's files in a folder of one machine, so it is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="condensa-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch where the session has Spark's defaults: whole texts make large rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def lean(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches for this session, unless it has its own; both the JVM and Python hold a batch per task.

    They stay set: plans run when their rows are asked for, after the operator has returned. They change no result.
    """
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
    return spark


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/condensa/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


_staged: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has staged so far; results read from them must be written by then."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- words and shingles in numpy

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=U64, endpoint=False) | U64(1)
_BYTE[_SEPARATOR] = 0
#: Bytes of letters and digits in lower-cased UTF-8: what is left of words without punctuation.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of `kept` bytes (all but ASCII white space); runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = (~_SEPARATOR if kept is None else kept)[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | border[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every word; bytes that aren't `kept` add nothing to the word before them."""
    if not len(starts):
        return np.zeros(0, U64)
    at = starts - starts[0]
    body = data[starts[0] :]
    place = np.arange(len(body)) - np.repeat(at, np.diff(np.append(at, len(body))))
    return mix(np.add.reduceat((_BYTE if kept is None else np.where(kept, _BYTE, U64(0)))[body] * _power(int(place.max()) + 1)[place], at))


def row_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted row numbers: each entry's place in its row and the size of its row."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size = np.diff(np.append(first, len(rows)))
    return np.arange(len(rows)) - np.repeat(first, size), np.repeat(size, size)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; the last k - 1 entries run into what follows."""
    out, n, power = np.zeros(len(words), U64), len(words), _power(k + 1)
    for j in range(k):
        out[: n - j] += words[j:] * power[k - j]
    return mix(out)


def shingles(words: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of 1 to k - 1 words has one shingle of all its words."""
    if not len(words):
        return words, rows
    place, size = row_places(rows)
    whole = np.flatnonzero(place <= size - k)
    hashed, of = gram_hashes(words, k)[whole], rows[whole]
    short = np.flatnonzero((size < k) & (place == 0))
    if len(short):
        less = np.zeros(len(short), U64)
        for j in range(k - 1):
            there = size[short] > j
            less += np.where(there, words[np.minimum(short + j, len(words) - 1)], U64(j + 1)) * _power(k + 1)[k - j]
        hashed, of = np.r_[hashed, mix(less ^ U64(0x5851F42D4C957F2D))], np.r_[of, rows[short]]
        order = np.argsort(of, kind="stable")
        hashed, of = hashed[order], of[order]
    return hashed, of


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return what a worker no longer uses to the machine."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Cut a batch so that each part holds about `limit` bytes of one column, or one longer row."""
    _, offsets = utf8(batch.column(column)) if batch.num_rows else (None, np.zeros(1, np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    give_back()


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (u, v); nodes without edges are absent.

    Smallest-label propagation with pointer jumping. Every round is written to the shared folder; the driver
    sees one count a round. An empty table gives an empty table.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = staged(both, f"{name}-edges")
    label = staged(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), f"{name}-0")
    rounds = 0
    while True:
        rounds += 1
        of = label.select(F.col("node").alias("v"), F.col("component").alias("near"))
        near = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        low = label.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        up = label.select(F.col("node").alias("low"), F.col("component").alias("up"))
        low = staged(low.join(up, "low").select("node", F.least("low", "up").alias("component"), "was"), f"{name}-{rounds}")
        moved = low.where("component <> was").limit(1).count()
        label = low.select("node", "component")
        if not moved:
            return label
