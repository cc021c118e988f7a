"""What an acquisition claims about itself, checked row by row without exploding anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_identifier

# ---- Fixed values ----------------------------------------------------------------------------------------------
PATH_BYTES = 4096
# ----------------------------------------------------------------------------------------------------------------
EVENT = "struct<order: long, stream: string, start: long, end: long>"
PROCESS = f"struct<events: array<{EVENT}>, exit_code: int, signal: int, timed_out: boolean, working_directory: string>"
RECEIPT = f"struct<variant: string, complete: boolean, partial: boolean, truncated: boolean, root_id: string, relative_path: string, process: {PROCESS}>"
STATES = ("inline", "file", "artifact", "process_complete", "process_partial", "process_failed", "acquisition_failed")


def events_cover(events: Column, size: Column) -> Column:
    """Whether stream events (order, stream, start, end) are numbered from 0, follow each other and cover 0 .. size."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda a, e: F.struct(
        (a["ok"] & (e["order"] == a["n"]) & (e["start"] == a["at"]) & (e["end"] > e["start"]) & e["stream"].isin("stdout", "stderr")).alias("ok"), e["end"].cast("long").alias("at"), (a["n"] + 1).alias("n")
    )
    return F.aggregate(events, start, step, lambda a: F.coalesce(a["ok"] & (a["at"] == size), F.lit(False)))


def path_summary(path: Column) -> Column:
    """A path as it may be shown: its length alone; null for one that is too long."""
    return F.when(F.octet_length(path) <= PATH_BYTES, F.format_string("<%d path bytes>", F.octet_length(path)))


def is_path_summary(c: Column) -> Column:
    digits = F.regexp_extract(c, r"^<([0-9]+) path bytes>\z", 1)
    return F.coalesce((digits != "") & (F.try_to_number(F.when(F.length(digits) <= 9, digits), F.lit("999999999")) <= PATH_BYTES), F.lit(False))


def state(receipt: Column, size: Column) -> Column:
    """The state an acquisition of so many bytes is in, null when its claims contradict each other.

    Complete excludes partial; truncated implies partial; only a process is partial; a failure holds no bytes. Inline and
    artifact carry nothing else; a file names its root and its path's length; a process names its root, its working
    directory under that root, events that cover its bytes, and exactly one of exit code and signal, the code alone if
    it is complete.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = {k: receipt[k] for k in ("variant", "complete", "partial", "truncated", "root_id", "relative_path", "process")}
    p = {k: c["process"][k] for k in ("events", "exit_code", "signal", "timed_out", "working_directory")}
    complete, partial, truncated = yes(c["complete"]), yes(c["partial"]), yes(c["truncated"])
    failed = ~complete & ~partial
    sound = ~(complete & partial) & ~(truncated & ~partial) & ~(partial & yes(c["variant"] != "process")) & ~(failed & (size != 0))
    bare = c["root_id"].isNull() & c["relative_path"].isNull() & c["process"].isNull() & ~truncated
    rooted = yes(is_identifier(c["root_id"]))
    a_file = rooted & yes(is_path_summary(c["relative_path"])) & c["process"].isNull() & ~truncated
    inside = yes(p["working_directory"].startswith(F.concat(c["root_id"], F.lit(":")))) & yes(is_path_summary(F.substr(p["working_directory"], F.length(c["root_id"]) + 2)))
    one_end = p["exit_code"].isNull() != p["signal"].isNull()
    nothing = (F.size(p["events"]) == 0) & p["exit_code"].isNull() & p["signal"].isNull() & ~yes(p["timed_out"])
    ended = F.when(failed, nothing).otherwise(one_end & ~(complete & (yes(p["timed_out"]) | p["signal"].isNotNull())))
    a_process = rooted & c["relative_path"].isNull() & c["process"].isNotNull() & inside & yes(events_cover(p["events"], size)) & yes(ended)
    named = F.when(complete, c["variant"]).otherwise("acquisition_failed")
    return F.when(
        sound,
        F.when(c["variant"].isin("inline", "artifact") & bare, named).when((c["variant"] == "file") & a_file, named)
        .when((c["variant"] == "process") & a_process, F.when(complete, "process_complete").when(partial, "process_partial").otherwise("process_failed")),
    )
