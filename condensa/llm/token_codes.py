"""Token ids as directly addressable codes: random access to any token without decoding a block.

An id is cut into chunks of WIDTH bits, lowest first. Level 0 holds the lowest chunk of every id; level k holds
chunk k of those ids that have one. A bitmap per level says which entries go on to the next level, and a rank
directory counts the set bits before every RANK_EVERY bits, so the place of entry i in level k + 1 is
rank(level k, i). Layout of one shard, little-endian:

    magic "DAC1" | u8 width | u8 levels | u16 zero | u64 number of ids
    per level:  u64 entries | entries x u8 chunks | bitmap, padded to 8 bytes | u32 rank directory

A shard is the payload column of one row of a Parquet table in the shared folder. Spark's commit protocol makes
a shard whole or absent when executors are lost, and any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, new_table_path, slices, utf8

WIDTH = 8
RANK_EVERY = 512
MAGIC = b"DAC1"
#: Ids in a shard, a whole document more or less.
SHARD_IDS = 1 << 18
#: Bytes of pieces and their ids that a worker remembers; it forgets them all and begins again.
CACHE_BYTES = 8 << 20


# ---------------------------------------------------------------- the code

def encode_ids(ids: np.ndarray) -> bytes:
    """The shard of an array of ids below 2**32."""
    ids, levels = np.asarray(ids, np.uint32), []
    while True:
        rest = ids >> WIDTH
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % 8, np.uint8))
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY)) if len(more) else np.zeros(0, int)
        rank = np.r_[0, np.cumsum(counts)].astype("<u4")
        levels.append(struct.pack("<Q", len(ids)) + (ids & ((1 << WIDTH) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        ids = rest[more]
        if not len(ids):
            break
    first = struct.unpack_from("<Q", levels[0])[0]
    return MAGIC + struct.pack("<BBHQ", WIDTH, len(levels), 0, first) + b"".join(levels)


class Codes:
    """A shard opened for reading: len(), [i] for one id, slice(a, b) for a run of ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC1 shard")
        self.width, levels, _, self.n = struct.unpack_from("<BBHQ", payload, 4)
        self.levels, at = [], 16
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n
            size = -(-n // 64) * 8
            bits = np.frombuffer(payload, np.uint8, size, at)
            at += size
            rank = np.frombuffer(payload, "<u4", -(-n // RANK_EVERY) + 1, at)
            at += rank.nbytes
            self.levels.append((chunks, bits, rank))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        _, bits, rank = self.levels[level]
        block = i // RANK_EVERY
        part = np.unpackbits(bits[block * RANK_EVERY // 8 : -(-i // 8)], bitorder="little")
        return int(rank[block]) + int(part[: i - block * RANK_EVERY].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << (k * self.width)
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self._rank(k, i)
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        out, at, where = np.zeros(b - a, np.uint32), a, np.arange(b - a)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            n = len(where)
            out[where] |= chunks[at : at + n].astype(np.uint32) << np.uint32(k * self.width)
            more = np.unpackbits(bits[at >> 3 : (at + n + 7) >> 3], bitorder="little")[at & 7 : (at & 7) + n].astype(bool)
            at, where = self._rank(k, at), where[more]
        return out


# ---------------------------------------------------------------- tokens

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
#: Second bytes of the small letters U+00DF to U+00FF after 0xC3.
_SMALL_C3 = np.zeros(256, bool)
_SMALL_C3[0x9F:0xC0] = True
_SMALL_C3[0xB7] = False
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: What a tokenizers file must say, besides its vocabulary, for its texts to be encoded piece by piece.
BY_PIECES = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def by_pieces(path: str) -> bool:
    """Whether a tokenizers file has the properties that make the ids of a text those of its pieces: see WordTokens."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocabulary = told.get("model", {}).get("vocab", {})
    told["model"] = {k: v for k, v in told.get("model", {}).items() if k not in ("vocab", "merges")}
    special = all(x["content"].startswith("<|") and not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in told.get("added_tokens", []))
    return special and all(told.get(k) == v for k, v in BY_PIECES.items()) and sum(len(t.removesuffix("</w>")) == 1 for t in vocabulary) == 512


class WordTokens:
    """Ids of whole texts by a tokenizers file, each distinct piece of text encoded once.

    A tokenizer that lower-cases, drops white space and never joins a letter with a following .,;:!? gives a text the ids
    of its pieces, one after another, where pieces start after white space and at such a mark after a letter. The file
    is read for that (`by_pieces`); every other one, and `whole=True`, encodes each text in one call. Pieces of common
    small Latin letters are one word each, which the normaliser and the pattern leave as it is: many are encoded in one
    call and told apart by their last ids, those of tokens that end a word. A worker remembers CACHE_BYTES of pieces.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.whole = Tokenizer.from_file(path), whole or not by_pieces(path)
        self.plain = Tokenizer(self.model.model)  # shares the vocabulary
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab() if not self.whole else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces, self.ids, self.sizes = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by word) of words of small letters."""
        spaced = pc.binary_join_element_wise(words, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        body = memoryview(spaced.buffers()[2])
        cuts = [*range(0, len(words), 1024), len(words)]
        found = self.plain.encode_batch_fast([str(body[at[i] : at[j]], "utf-8") for i, j in zip(cuts[:-1], cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer's words don't end with an end token")
        return ids, np.diff(np.r_[-1, last]).astype(np.int32)

    def _learn(self, new: pa.Array) -> None:
        """Encode pieces and remember them."""
        at = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
        body = np.frombuffer(new.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        small = _SMALL[body]
        if len(body) > 1:
            pair = np.flatnonzero((body[:-1] == 0xC3) & _SMALL_C3[body[1:]])
            small[pair] = small[pair + 1] = True
        ahead = np.r_[0, np.cumsum(small)]
        size = np.diff(at)
        plain = (ahead[at[1:] - at[0]] - ahead[at[:-1] - at[0]] == size) & (size > 0)
        other = new.filter(pa.array(~plain))
        parts = [np.array(x.ids, np.uint32) for i in range(0, len(other), 4096) for x in self.model.encode_batch_fast([str(y, "utf-8", "replace") for y in other.slice(i, 4096).to_pylist()], add_special_tokens=False)]
        ids, sizes = [np.concatenate([np.zeros(0, np.uint32), *parts])], [np.array([len(x) for x in parts], np.int32)]
        words = new.filter(pa.array(plain))
        if len(words):
            found, count = self._words(words)
            ids.append(found), sizes.append(count)
        self.pieces, self.ids, self.sizes = pa.concat_arrays([self.pieces, other, words]), np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])

    def _indices(self, words: pa.Array) -> np.ndarray:
        """Where in what is remembered each of some distinct pieces stands."""
        if self.pieces.nbytes + self.ids.nbytes + self.sizes.nbytes > CACHE_BYTES:
            self.pieces, self.ids, self.sizes = self.pieces[:0], self.ids[:0], self.sizes[:0]
        at = pc.index_in(words, value_set=self.pieces)
        if at.null_count:
            known = len(self.pieces)
            missing = pc.is_null(at)
            new = pa.concat_arrays([words.filter(missing)])
            self._learn(new)
            at = np.where(missing.to_numpy(zero_copy_only=False), pc.index_in(words, value_set=self.pieces.slice(known)).fill_null(0).to_numpy() + known, at.fill_null(0).to_numpy())
            return at
        return at.to_numpy()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends by row)."""
        if self.whole:
            found = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([len(x) for x in found])
        data, offsets = utf8(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if b"<|" not in data.tobytes():  # strings of special tokens keep their case
            data = _LOWER[data]
            high = np.flatnonzero(data[:-1] == 0xC3) + 1  # U+00C0 to U+00DE but the multiplication sign
            high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
            data[high] += 32
        blank = (data == 32) | (data == 10)
        begins = np.zeros(n + 1, bool)
        begins[1:-1] = (blank[:-1] & ~blank[1:]) | (_LETTER[data[:-1]] & _STOP[data[1:]])
        begins[offsets] = True
        cuts = np.flatnonzero(begins[:-1])
        gaps = np.flatnonzero(blank)  # white space ends a piece and is no part of one
        ends = np.append(cuts - np.searchsorted(gaps, cuts), n - len(gaps)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(data[~blank])])
        coded = pieces.dictionary_encode()
        index = self._indices(coded.dictionary)[coded.indices.to_numpy()]
        first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        count = self.sizes[index]
        ends = np.cumsum(count, dtype=np.int32)  # a slice has far fewer than 2**31 ids
        at = np.arange(int(ends[-1]), dtype=np.int32) + np.repeat((first[index] - (ends - count)).astype(np.int32), count)
        row_end = np.r_[0, ends][np.searchsorted(cuts, offsets[1:], "left")]
        return self.ids[at], row_end


_workers: dict[tuple[str, bool], WordTokens] = {}


def _tokens(tokenizer: str, whole: bool) -> WordTokens:
    """One tokenizer a worker process, so that its words outlive a task."""
    if (tokenizer, whole) not in _workers:
        _workers[tokenizer, whole] = WordTokens(tokenizer, whole)
    return _workers[tokenizer, whole]


def _encode(tokenizer: str, end_id: int, whole: bool):
    schema = pa.schema([("number", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        tokens = _tokens(tokenizer, whole)
        held, docs, sizes, total, number = [], [], [], 0, 0

        def shard():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"number": [number], "doc_ids": [docs], "n_tokens": [sizes], "n_ids": [len(ids)], "payload": [encode_ids(ids)]}, schema)

        for batch in (part for whole in batches for part in slices(whole, "text", 2 << 20)):
            names = batch.column("doc_id").to_pylist()
            ids, ends = tokens(batch.column("text"))
            for doc, a, b in zip(names, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                held.append(np.append(ids[a:b], np.uint32(end_id)))
                docs.append(doc)
                sizes.append(b - a + 1)
                total += b - a + 1
                if total >= SHARD_IDS:
                    yield shard()
                    held, docs, sizes, total, number = [], [], [], 0, number + 1
        if docs:
            yield shard()

    return run, "number long, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary"


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, whole: bool = False) -> None:
    """Write the ids of every text to `path`, in ascending doc_id order (nulls first), rows of one id by their text's hash.

    A null or empty text has the end id alone. Rows that repeat a doc_id, or have none, are written each, at places that
    their texts settle; rows equal in both are alike. Ranges cut through the rows of one id, so a hot id isn't one task.
    An empty table writes a table without shards. Memory: one batch and one shard a task.
    """
    lean(docs.sparkSession)
    run, schema = _encode(tokenizer, end_id, whole)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, schema).withColumn("part", F.spark_partition_id()).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            codes, local = Codes(row["payload"]), np.r_[0, np.cumsum(row["n_tokens"])]
            ids = memoryview(codes.slice(0, len(codes)).astype("<u4").tobytes())
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist())]
            k = len(crc)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(row["doc_ids"], pa.int64()), "part": pa.array([row["part"]] * k, pa.int32()), "number": pa.array([row["number"]] * k, pa.int64()), "at": pa.array(local[:-1], pa.int64()), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every row that was written.

    A null text was written as an empty one and comes back as its end id; repeated rows and null ids come back each; a table
    without shards gives no rows.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "number", "n_ids")  # payloads stay unread
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("ahead", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "number", (F.col("base") + F.col("ahead")).alias("base"))
    docs = shards.select("part", "number", "doc_ids", "n_tokens", "payload").mapInArrow(_decode, "doc_id long, part int, number long, at long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = 2, whole: bool = False) -> DataFrame:
    """Write codes to a new table in the shared folder and read them back."""
    path = new_table_path(docs.sparkSession, "codes")
    write_codes(docs, path, tokenizer, end_id, whole)
    return read_codes(docs.sparkSession, path)
