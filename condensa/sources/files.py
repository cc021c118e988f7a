"""Files under named roots as byte observations, and logs made of events."""

from __future__ import annotations

import errno
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024


class Confined(Exception):
    """A path that leaves its root, or is no regular file (or directory) under it: unsafe_root or acquisition_failed."""


class Root:
    """A directory that paths are taken from; it must stay the directory that it was when it was named."""

    def __init__(self, path: str):
        self.path = path
        told = os.stat(path)
        if not os.path.isabs(path) or not stat.S_ISDIR(told.st_mode):
            raise Confined("unsafe_root")
        self.identity = (told.st_dev, told.st_ino)

    def open(self, relative: str, directory: bool = False) -> tuple[str, os.stat_result]:
        """The path and state of a file beneath the root, opened part by part from the root's own descriptor.

        No empty, "." or ".." part, no absolute path, no symbolic link on the way: what was opened is what is described,
        whatever is renamed meanwhile. "" is the root itself, for directories.
        """
        parts = relative.split("/") if relative else []
        if relative.startswith("/") or "\0" in relative or any(p in ("", ".", "..") for p in parts) or not (parts or directory):
            raise Confined("unsafe_root")
        held = []
        try:
            held.append(os.open(self.path, os.O_RDONLY | os.O_DIRECTORY))
            told = os.fstat(held[0])
            if (told.st_dev, told.st_ino) != self.identity:
                raise Confined("unsafe_root")
            for k, part in enumerate(parts):
                last = k == len(parts) - 1 and not directory
                held.append(os.open(part, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK | (0 if last else os.O_DIRECTORY), dir_fd=held[-1]))
            told = os.fstat(held[-1])
            if not (stat.S_ISDIR if directory else stat.S_ISREG)(told.st_mode):
                raise Confined("acquisition_failed")
            return os.path.join(self.path, *parts), told
        except OSError as error:
            raise Confined("unsafe_root" if error.errno in (errno.ELOOP, errno.ENOTDIR) else "acquisition_failed") from None
        finally:
            for fd in held:
                os.close(fd)


def beneath(root: str, relative: str) -> str:
    """The path of a regular file under a root: no absolute or empty part, no "..", no symbolic link on the way."""
    return Root(root).open(relative)[0]


def read_files(spark: SparkSession, paths: list[str] | str, reject_binary: bool = False) -> DataFrame:
    """(path, modified, size, source, error_code) of files by Spark's binary reader; too large or binary ones carry an error.

    The content of files over the limit isn't read.
    """
    read = spark.read.format("binaryFile").load(paths).withColumnRenamed("modificationTime", "modified").withColumnRenamed("length", "size")
    binary = ~F.is_valid_utf8(F.col("content").cast("string")) | F.col("content").cast("string").contains("\0")
    error = F.when(binary, "invalid_request") if reject_binary else F.lit(None).cast("string")
    small = read.where(F.col("size") <= MOST_BYTES).select("path", "modified", "size", F.col("content").alias("source"), error.alias("error_code"))
    large = read.where(F.col("size") > MOST_BYTES).select("path", "modified", "size", F.lit(None).cast("binary").alias("source"), F.lit("input_too_large").alias("error_code"))
    return small.union(large)


def read_beneath(spark: SparkSession, root: Root, relatives: list[str], reject_binary: bool = False) -> DataFrame:
    """(relative_path, size, source, error_code) of files named relative to a root on a file system that executors share.

    Each is opened and described first; what was read must have the length and time of change it had then, else
    error_code is acquisition_failed. A path that isn't allowed, or isn't there, is a row with its error.
    """
    told, refused = [], []
    for relative in relatives:
        try:
            path, state = root.open(relative)
            told.append((relative, f"file:{path}", state.st_size, state.st_mtime_ns // 1_000_000))
        except Confined as error:
            refused.append((relative, None, None, str(error)))
    out = spark.createDataFrame(refused, "relative_path string, size long, source binary, error_code string")
    if told:
        named = spark.createDataFrame(told, "relative_path string, path string, _size long, _at long")
        read = read_files(spark, [t[1] for t in told], reject_binary).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
        changed = F.col("path").isNull() | (F.col("size") != F.col("_size")) | (F.unix_millis("modified") != F.col("_at")) | F.coalesce(F.octet_length("source") != F.col("_size"), F.lit(False))
        met = named.withColumnRenamed("path", "_path").join(read, F.col("path") == F.col("_path"), "left")
        error = F.when(changed, "acquisition_failed").otherwise(F.col("error_code"))
        out = out.union(met.select("relative_path", F.col("_size").alias("size"), F.when(error.isNull(), F.col("source")).alias("source"), error.alias("error_code")))
    return out


def event_logs(events: DataFrame) -> DataFrame:
    """(user_id, text): a log per user, one line an event in order of time and id."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    line = F.format_string("%s [%s] %s event %d\n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "event_type", "event_id")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return events.groupBy("user_id").agg(ordered.alias("x")).select("user_id", F.array_join(F.transform("x", lambda e: e["line"]), "").alias("text"))


def event_diffs(events: DataFrame) -> DataFrame:
    """(user_id, text): a patch per user: views open hunks, errors open files, the rest are changes or context."""
    n = F.col("event_id")
    line = (
        F.when(F.col("event_type") == "error", F.format_string("diff --git a/%d b/%d\n", n, n)).when(F.col("event_type") == "view", F.format_string("@@ -%d,1 +%d,1 @@\n", n, n))
        .when(F.col("event_type") == "click", F.format_string("+event %d\n", n)).when(F.col("event_type") == "signup", F.format_string("-event %d\n", n)).otherwise(F.format_string(" event %d\n", n))
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return events.groupBy("user_id").agg(ordered.alias("x")).select("user_id", F.array_join(F.transform("x", lambda e: e["line"]), "").alias("text"))


def read_bounded(stream, limit: int = MOST_BYTES) -> bytes:
    """All of a binary stream (standard input, a socket's file) if it is no longer than `limit`; a byte more is read at most."""
    data = stream.read(limit + 1)
    if len(data) > limit:
        raise Confined("input_too_large")
    return data
