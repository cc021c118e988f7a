"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

A turn is written between the marks of its role; control strings inside a text are escaped by a backslash, which
unescape() takes out again. Conversations are cut into nodes, one per distinct sequence of turns from the first.
Sorted by the digests of their nodes, conversations come in depth-first order, and each emits the nodes it doesn't
share with the one before it: its segment of the global sequence of code points.

Two Parquet tables are written under one path:

segments  start, text, position (position id of the first code point; they count along the conversation, so shared
          turns keep theirs), attend (intervals of the ancestors in the global sequence, in order: what the segment
          attends to besides its own earlier code points), loss (intervals of the segment under the loss mask)
paths     part, number (place in depth-first order), conv_id, n_turns, pieces (segment, start, end: where in which
          segments the conversation lies, in order)
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, new_table_path, staged

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<<TURN ", ">> ", " <</TURN>>")
#: Strings that must not stand in a text as they are.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<TURN", "<</TURN>>", ">>")
LOSS_ROLE = "assistant"
_CONTROL = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_ROLE = re.compile(r"[\\<>\[\]/]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def escape_role(role: str) -> str:
    """A role's name between marks: every character that a mark is made of is escaped by itself, so no mark is left, its end least of all."""
    return _ROLE.sub(r"\\\g<0>", role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(formatted turn, start and end of its body). A null role is an empty name, a null text an empty text."""
    body = escape(text or "")
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER[0] + escape_role(role or "") + OTHER[1], OTHER[2]
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the body) of every turn of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        for role, (head, tail) in MARKS.items():
            if formatted.startswith(head, at):
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at {at}")
            end = formatted.index(OTHER[1], at)
            role, head, tail = unescape(formatted[at + len(OTHER[0]) : end]), formatted[at : end + len(OTHER[1])], OTHER[2]
        start = at + len(head)
        end = formatted.index(tail, start)
        out.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(tail)
    return out


# ---------------------------------------------------------------- the tree

_TURNS = "turns array<struct<turn: long, role: string, text: string>>"


def _digests(batches):
    """Add the path: the chained digests of the conversation's turns, 16 bytes each."""
    for batch in batches:
        paths = []
        for turns in batch.column("turns").to_pylist():
            chain, path = b"", []
            for t in turns:
                part = render_turn(t["role"], t["text"])[0].encode("utf-8", "surrogatepass")
                chain = hashlib.blake2b(part, digest_size=16, key=chain).digest()
                path.append(chain)
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary())], names=[*batch.schema.names, "path"])


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    while a[n : n + 16] and a[n : n + 16] == b[n : n + 16]:
        n += 16
    return n // 16


def _number(batches):
    """In depth-first order: number the conversations of a partition and count the turns shared with the one before."""
    number, before = 0, b""
    for batch in batches:
        shared, numbers = [], []
        for path in batch.column("path").to_pylist():
            shared.append(_shared(before, path) if number else 0)
            numbers.append(number)
            number, before = number + 1, path
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(shared, pa.int64())], names=[*batch.schema.names, "number", "shared"])


_NODE = pa.struct([("i", pa.int32()), ("digest", pa.binary()), ("at", pa.int64()), ("size", pa.int64()), ("own", pa.bool_())])


def _emit(batches):
    """Segments: the text of the turns that aren't shared, and every turn's place in its own conversation's segment."""
    for batch in batches:
        out = []
        for turns, path, shared in zip(batch.column("turns").to_pylist(), batch.column("path").to_pylist(), batch.column("shared").to_pylist()):
            parts, nodes, loss, at, position = [], [], [], 0, 0
            for i, t in enumerate(turns):
                text, a, b = render_turn(t["role"], t["text"])
                own = i >= shared
                nodes.append({"i": i, "digest": path[16 * i : 16 * i + 16], "at": at if own else 0, "size": len(text), "own": own})
                if own:
                    parts.append(text)
                    if t["role"] == LOSS_ROLE:
                        loss.append({"start": at + a, "end": at + b})
                    at += len(text)
                else:
                    position += len(text)
            out.append(("".join(parts), at, position, loss, nodes))
        text, size, position, loss, nodes = zip(*out) if out else ([],) * 5
        cells = [pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(position, pa.int64()), pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(nodes, pa.list_(_NODE))]
        keep = ["conv_id", "part", "number"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cells], names=[*keep, "text", "size", "position", "loss", "nodes"])


def write_tree(conversations: DataFrame, path: str) -> None:
    """Write `segments` and `paths` of all conversations (conv_id, turn, role, text) under `path`.

    Turns are ordered by turn (null first), then role and text, so ties are settled and repeated rows are turns of
    their own. Rows with a null conv_id are one conversation. A conversation is one unit of work: its turns meet in
    one task; nothing else that shares a key does. An empty table writes empty tables.
    """
    lean(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long"), "role", "text").alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    keyed = gathered.mapInArrow(_digests, f"conv_id long, {_TURNS}, path binary")
    keyed = staged(keyed, "chat-keyed")
    ordered = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = ordered.mapInArrow(_number, f"conv_id long, {_TURNS}, path binary, number long, shared long")
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()), "chat-ordered")

    # Where a partition begins, what is shared is counted against the last conversation of the one before.
    ends = ordered.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("before is not null")
    cut = lambda c: F.expr(f"transform(sequence(0, cast(length({c}) / 16 - 1 as int)), i -> substring({c}, i * 16 + 1, 16))")
    differ = F.array_position(F.zip_with(cut("first"), cut("before"), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    ends = ends.select("part", F.lit(0).cast("long").alias("number"), F.when(differ == 0, F.length("first") / 16).otherwise(differ - 1).cast("long").alias("across"))
    fixed = ordered.join(F.broadcast(ends), ["part", "number"], "left").withColumn("shared", F.coalesce("across", "shared"))  # a row a partition
    emitted = fixed.select("conv_id", "part", "number", "turns", "path", "shared").mapInArrow(
        _emit,
        "conv_id long, part int, number long, text string, size long, position long, loss array<struct<start: long, end: long>>, "
        "nodes array<struct<i: int, digest: binary, at: long, size: long, own: boolean>>",
    )
    emitted = staged(emitted, "chat-emitted")

    sizes = emitted.select("part", "number", "size")
    parts = sizes.groupBy("part").agg(F.sum("size").alias("sum"))
    parts = parts.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, "part").select("part", "number", (F.col("base") + F.col("ahead")).alias("start"))

    located = emitted.join(starts, ["part", "number"])
    turns = located.select("conv_id", "part", "number", "start", F.explode("nodes").alias("n"))
    owners = turns.where("n.own").select(F.col("n.digest").alias("digest"), F.col("start").alias("segment"), F.col("n.at").alias("at"))
    places = turns.select("conv_id", "part", "number", F.col("n.i").alias("i"), F.col("n.digest").alias("digest"), F.col("n.size").alias("size"), F.col("n.own").alias("own")).join(owners, "digest")
    piece = F.struct("i", "segment", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"), "own")
    gathered = places.groupBy("part", "number").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.first("conv_id").alias("conv_id"), F.count("*").alias("n_turns"))
    # Neighbouring turns in one segment are one piece.
    joined = lambda items: F.expr(f"""aggregate({items}, cast(array() as array<struct<segment: bigint, start: bigint, end: bigint>>),
        (a, x) -> case when size(a) > 0 and element_at(a, -1).segment = x.segment and element_at(a, -1).end = x.start
                  then concat(slice(a, 1, size(a) - 1), array(named_struct('segment', x.segment, 'start', element_at(a, -1).start, 'end', x.end)))
                  else concat(a, array(named_struct('segment', x.segment, 'start', x.start, 'end', x.end))) end)""")  # noqa: E731
    gathered = staged(gathered.withColumn("pieces", joined("p")).withColumn("above", joined("filter(p, x -> not x.own)")).drop("p"), "chat-paths")
    gathered.select("part", "number", "conv_id", "n_turns", "pieces").write.parquet(f"{path}/paths")
    attend = F.transform("above", lambda x: F.struct((x["segment"] + x["start"]).alias("start"), (x["segment"] + x["end"]).alias("end")))
    segments = located.where("size > 0").join(gathered.select("part", "number", "above"), ["part", "number"])
    shifted = F.transform("loss", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["end"]).alias("end")))
    segments.select("start", "text", "position", attend.alias("attend"), shifted.alias("loss")).write.parquet(f"{path}/segments")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Read the tables back: conv_id, n_turns, formatted, loss (intervals of `formatted` under the mask).

    Null texts were written as empty ones, and rows of a null conv_id as one conversation with that id; repeated conversations
    come back each. Tables without conversations give no rows.
    """
    paths = spark.read.parquet(f"{path}/paths")
    pieces = paths.select("part", "number", "conv_id", "n_turns", F.posexplode("pieces").alias("k", "p")).select("part", "number", "conv_id", "n_turns", "k", "p.*")
    segments = spark.read.parquet(f"{path}/segments").withColumnRenamed("start", "segment").select("segment", "text", "loss")
    cut = F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))")
    inside = F.expr("filter(transform(loss, x -> named_struct('start', x.start - segment - start, 'end', x.end - segment - start)), x -> x.start >= 0 and x.end <= end - start)")
    found = pieces.join(segments, "segment").select("part", "number", "conv_id", "n_turns", F.struct("k", cut.alias("text"), inside.alias("loss")).alias("x"))
    whole = found.groupBy("part", "number").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list("x")).alias("x"))
    loss = F.expr("""aggregate(x, named_struct('at', 0L, 'loss', cast(array() as array<struct<start: bigint, end: bigint>>)),
        (a, y) -> named_struct('at', a.at + length(y.text), 'loss', concat(a.loss, transform(y.loss, z -> named_struct('start', a.at + z.start, 'end', a.at + z.end))))).loss""")
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("x", lambda y: y["text"]), "").alias("formatted"), loss.alias("loss"))


def _digest_rows(batches):
    for batch in batches:
        out = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = parse(text)
            told = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body, _, _ in turns).encode("utf-8", "surrogatepass")).hexdigest()
            learned = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            out.append((len(turns), told, len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        n, told, chars, learned, size = zip(*out) if out else ([],) * 5
        cells = [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(chars, pa.int64()), pa.array(learned, pa.string()), pa.array(size, pa.int64())]
        yield pa.RecordBatch.from_arrays(cells, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """What the written conversations say, by digest: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A row a conversation, of a null conv_id too; no conversations give no rows.
    """
    return read_conversations(spark, path).select("conv_id", "formatted", "loss").mapInArrow(
        _digest_rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def formatted(conversations: DataFrame) -> str:
    """Write the tree to a new place in the shared folder; the path. Nulls, ties, repeats and empty tables as in `write_tree`."""
    path = new_table_path(conversations.sparkSession, "chat")
    write_tree(conversations, path)
    return path
