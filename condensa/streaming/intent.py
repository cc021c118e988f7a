"""The latest prompt of a session, as an as-of lookup in batch and as expiring state in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 12 * 3600
PROMPT_BYTES = 256


def bounded(prompt: Column, limit: int = PROMPT_BYTES) -> Column:
    """The trimmed prompt cut to so many bytes on a character boundary; null when blank."""
    from ..functions.predicates import trim
    from ..functions.text import byte_prefix

    body = trim(prompt)
    return F.when(body != "", byte_prefix(body, limit))


def as_of(rows: DataFrame, session: str, ts: str, prompt: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds intent: the last non-blank prompt of the session up to this row and at most `ttl` seconds old.

    One window by session over a range of time: no self-join. `prompt` is null on rows that aren't prompts.
    """
    reach = Window.partitionBy(session).orderBy(F.col(ts)).rangeBetween(-ttl, 0)
    return rows.withColumn("intent", F.last(bounded(prompt), ignorenulls=True).over(reach))


def as_of_sliced(rows: DataFrame, session: str, ts: str, prompt: Column, ttl: int = TTL_SECONDS, seconds: int = 3600) -> DataFrame:
    """`as_of` with the work of one session split by time: slices of so many seconds, and what each carries into the next.

    Rows are put in order inside their slice only; a slice hands on its last prompt, so the one order that spans a session
    is of a row a slice. Of prompts of one instant the greatest counts, so reruns agree. Rows without a session or a time
    have no intent; columns that start with _ are the operator's own.
    """
    said = bounded(prompt)
    told = F.when(said.isNotNull(), F.struct(F.col(ts).alias("ts"), said.alias("intent")))
    cut = rows.withColumn("_slice", F.floor(F.col(ts) / seconds)).withColumn("_said", told)
    inside = Window.partitionBy(session, "_slice").orderBy(F.col(ts)).rangeBetween(Window.unboundedPreceding, 0)
    every = cut.groupBy(F.col(session).alias("_session"), "_slice").agg(F.max("_said").alias("_last"))  # a row a slice
    before = Window.partitionBy("_session").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_session", F.col("_slice").alias("_at"), F.max("_last").over(before).alias("_carried")).where("_carried is not null")
    met = cut.withColumn("_own", F.max("_said").over(inside)).join(carried, (F.col(session) == F.col("_session")) & (F.col("_slice") == F.col("_at")), "left")
    known = F.coalesce("_own", "_carried")
    fresh = F.col(session).isNotNull() & (F.col(ts) - known["ts"] <= ttl)
    return met.withColumn("intent", F.when(fresh, known["intent"])).select(*rows.columns, "intent")


def session_digest(session: Column) -> Column:
    """What names a session's record: sha256 in hex, so nothing of the host's text reaches a path; null for none."""
    return F.sha2(session.cast("binary"), 256)


def records(prompts: DataFrame, session: str, ts: str, prompt: Column, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    """(digest, intent, ts): the records of `latest` under the digests of their sessions; sessions without a name have none."""
    known = latest(prompts.where(F.col(session).isNotNull()), session, ts, prompt, now, ttl)
    return known.select(session_digest(F.col(session)).alias("digest"), "intent", "ts")


def latest(prompts: DataFrame, session: str, ts: str, prompt: Column, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    """(session, intent, ts): what each session said last that isn't blank, unless that is older than `ttl`.

    The record of a session is one row whatever its prompts; partial aggregates meet in the shuffle. Expired records go.
    """
    said = prompts.select(session, F.col(ts).alias("ts"), bounded(prompt).alias("intent")).where("intent is not null")
    last = said.groupBy(session).agg(F.max(F.struct("ts", "intent")).alias("last")).select(session, "last.intent", "last.ts")
    return last.where(F.lit(now) - F.col("ts") <= ttl)


class Intent(StatefulProcessor):
    """Per session: prompts set the state, tool events are emitted with it; the state expires by itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("prompt", "prompt string", ttlDurationMs=TTL_SECONDS * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            for r in frame.sort_values("ts", kind="stable").itertuples():
                if r.prompt is not None and r.prompt == r.prompt:
                    if text := r.prompt.strip():
                        self.state.update((text.encode()[:PROMPT_BYTES].decode("utf-8", "ignore"),))
                else:
                    known = self.state.get() if self.state.exists() else None
                    out.append((key[0], r.ts, known[0] if known else None))
            yield pd.DataFrame(out, columns=["session", "ts", "intent"])

    def close(self) -> None:
        pass


def stream(rows: DataFrame) -> DataFrame:
    """(session, ts, intent) of the tool events of a streaming (session string, ts long, prompt string)."""
    return rows.groupBy("session").transformWithStateInPandas(Intent(), "session string, ts long, intent string", "Append", "ProcessingTime")
