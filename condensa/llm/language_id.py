"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A score is the softmax at a temperature fitted on held-back texts cut to pieces of many lengths, so that it is about the
share of right answers at that score. A text is rejected under the lowest score at which, among accepted pieces and as
many pieces of windows drawn from nowhere, PRECISION are right: short texts of a known language pass, others don't.

Subwords are the 3- and 4-byte windows of the lower-cased text whose second byte belongs to a word (a to z or any
byte from 128); other bytes count as one kind of border. As both layers are linear, prediction folds them into one
table of class scores per bucket: a text's score is the mean of its windows' rows plus the bias.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices, utf8

BUCKETS = 1 << 16
DIM = 12
#: The bound of the training sample: documents a language, the first by md5 of id and text.
SAMPLE = 300
EPOCHS = 12
#: What calibration holds to: the share of right answers among what is accepted, on pieces of so many windows.
PRECISION, PIECES = 0.97, (6, 12, 25, 50, 100, 400)
#: Up to so many chosen ids (of 32 characters) go to the scan of the texts; with more languages both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Up to so many languages' counts are sent to the scan of the ids.
BROADCAST_LANGS = 10_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword window of every whole text."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), "  ", "")
    data, offsets = utf8(padded)
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _KEPT[data].astype(np.uint32)
    at = np.flatnonzero(c[1:-2] != 32)  # a row starts with one border and ends with two, so windows stay inside
    a, b, d, e = c[at], c[at + 1], c[at + 2], c[at + 3]
    three = (a | b << np.uint32(8) | d << np.uint32(16)) * np.uint32(2654435761)
    four = ((a | b << np.uint32(8) | d << np.uint32(16) | e << np.uint32(24)) ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)
    rows = np.searchsorted(offsets, at, "right") - 1
    return np.stack([three >> np.uint32(16), four >> np.uint32(16)], 1).astype(np.int32), rows


class Model:
    """langs, table (bucket x language), bias, temperature, threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def scores(self, texts: pa.Array) -> np.ndarray:
        at, rows = windows(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if len(rows):
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sums = np.add.reduceat(self.table[at[:, 0]] + self.table[at[:, 1]], first, axis=0, dtype=np.float64)
            out[rows[first]] = sums / (2 * np.diff(np.append(first, len(rows))))[:, None]
        return (out + self.bias) / self.temperature

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        z = self.scores(texts)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = np.array([bool(x) and _LETTER.search(x) is not None for x in texts.to_pylist()], bool)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, known)], np.where(known, p.max(1), 0.0)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train on (lang, buckets, counts) rows: a fifth of each language is held back for the temperature and threshold.

    Both are fitted on pieces of the held-back texts (`calibrated`). No rows give a model with the one language "und"; a language of one row trains and isn't held back.
    """
    langs = sorted({x[0] for x in samples})
    if not langs:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    seen: dict[str, int] = {}
    train, held = [], []
    for lang, at, n in samples:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 5 == 0 else train).append((langs.index(lang), at, n / max(1, n.sum())))
    rng = np.random.default_rng(seed)
    table, weight, bias = rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    share = np.bincount([y for y, *_ in train], minlength=len(langs)) / len(train)
    balance = 1 / np.maximum(share * len(langs), 1e-9)
    for epoch in range(EPOCHS):
        rate = 20.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(train)):
            y, at, w = train[i]
            if not len(at):
                continue
            x = w @ table[at]
            z = x @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(balance[y], 5.0)
            back = weight @ p
            weight -= 0.01 * rate * np.outer(x, p)
            bias -= 0.001 * rate * p
            table[at] -= rate * np.outer(w, back)
    model = Model(langs, (table @ weight).astype(np.float32), bias)
    return calibrated(model, [(y, at, n) for y, at, n in held if len(at)], np.random.default_rng([seed, 1]))


def calibrated(model: Model, held: list[tuple[int, np.ndarray, np.ndarray]], rng: np.random.Generator) -> Model:
    """The model with temperature and threshold from (language, buckets, shares) of held-back texts; none leave it as it is.

    The temperature has the least log loss on pieces of PIECES windows of each text. The threshold is the lowest score of
    a piece at which PRECISION of what is accepted is right, pieces of random buckets counted as wrong; it is no
    higher than the score of 199 of 200 right pieces of the longest kind, so that long texts aren't sacrificed to it.
    """
    if not held:
        return model
    score = lambda at: model.table[at].mean(0, dtype=np.float64) + model.bias
    z, y, long_ = [], [], []
    for lang, at, share in held:
        for k in PIECES:
            z.append(score(rng.choice(at, k, p=share / share.sum())))
            y.append(lang)
            long_.append(k == PIECES[-1])
    z, y, long_ = np.array(z), np.array(y), np.array(long_)
    noise = np.array([score(rng.integers(0, BUCKETS, k)) for k in PIECES for _ in held])

    def soft(z, t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    share = 1 / (len(y) + 2)  # of each target that goes to all languages alike: pieces that are all right don't prove certainty

    def loss(t):
        logs = np.log(np.maximum(soft(z, t), 1e-300))
        return -((1 - share) * logs[np.arange(len(y)), y] + share * logs.mean(1)).mean()

    model.temperature = float(min(np.geomspace(0.005, 5, 121), key=loss))
    p = soft(z, model.temperature)
    right, top = p.argmax(1) == y, p.max(1)
    if not right.any():
        return model
    every, good = np.r_[top, soft(noise, model.temperature).max(1)], np.r_[right, np.zeros(len(noise), bool)]
    order = np.argsort(-every, kind="stable")
    precision = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(precision >= PRECISION)
    lowest = every[order][enough[-1]] if len(enough) else top[right].max()
    model.threshold = float(min(lowest, np.quantile(top[right & long_], 0.005)) if (right & long_).any() else lowest)
    return model


def _counts(batches):
    for batch in batches:
        langs, at, n = batch.column("lang").to_pylist(), [], []
        for i in range(batch.num_rows):
            found, _ = windows(batch.column("text").slice(i, 1))
            bucket, count = np.unique(found, return_counts=True)
            at.append(bucket.astype(np.int32))
            n.append(count.astype(np.int32))
        yield pa.RecordBatch.from_pydict({"turn": batch.column("turn"), "lang": pa.array(langs, pa.string()), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.int32()))})


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the documents with a lang: at most `sample` a language (a stated bound), first by md5 of id and text, whole texts.

    Digests are chosen without their texts; the chosen ones, bounded by the sample, go to the scan of the texts. Rows equal
    in id, text and lang count once, however many there are; other rows that repeat an id, null too, each on its own.
    Null texts have no windows. What comes to the driver is at most `sample` rows of counts a language.
    """
    lean(docs.sparkSession)
    turn = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).cast("binary"))
    keyed = docs.where("lang is not null").select("lang", turn.alias("turn"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("turn").alias("all"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    # Of a large language only the lowest md5s can be among the first: four times as many as wanted are ranked.
    low = F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") <= F.lit(4.0 * sample * 2**32) / F.col("all")
    order = Window.partitionBy("lang").orderBy("turn")
    chosen = keyed.join(sizes, "lang").where(low).select("lang", "turn").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("lang", "turn")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    texts = docs.where("lang is not null").select(turn.alias("turn"), "lang", "text").join(chosen, ["lang", "turn"], "left_semi").select("turn", "lang", "text").dropDuplicates(["lang", "turn"])
    rows = texts.mapInArrow(_counts, "turn string, lang string, at array<int>, n array<int>").toPandas().sort_values(["turn", "lang"], kind="stable")
    return fit([(r.lang, np.asarray(r.at, np.int32), np.asarray(r.n, float)) for r in rows.itertuples()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row; only text is an input.

    `und` with score 0 where the text is null or has no letter; these and scores under the threshold are not
    accepted. An empty table gives an empty table. Memory: one slice of texts and the folded model.
    """
    model = lean(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs, score = model.value.predict(part.column("text"))
                cells = [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array((score >= model.value.threshold) & (score > 0))]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is accepted, with the columns of docs; the texts pass through in batches, unshuffled.

    Rows without a letter (null, empty or other texts) are never accepted. Repeated rows and ids are judged each by their
    text; extra columns, whatever their names, come along; an empty table gives an empty table.
    """
    model = lean(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                _, score = model.value.predict(part.column(at))
                yield part.filter(pa.array((score >= model.value.threshold) & (score > 0)))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any names will do
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
