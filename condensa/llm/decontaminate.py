"""Benchmark decontamination: every passage of every document queries a BM25 index of the benchmark's items.

Items and passages are lower-cased and cut into runs of letters and digits. A term's impact in an item is its BM25
weight divided by the item's score against itself, so one threshold serves all items. Document frequencies, the mean
length and the longest item are the whole benchmark's, however many indexes hold its items. Retrieval is block-max WAND
over whole slices of passages at once: terms so common that all of them together can't lift any item over the
threshold by themselves are non-essential; essential terms gather, per block of items, the sum of the block's maxima;
a block whose sum and whose items' non-essential mass stay under the threshold is skipped; the items of the others
are scored in full. What is retrieved is verified by the overlap of five-word shingles with question and answer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, gram_hashes, lean, row_places, slices, staged, utf8, word_bounds, word_hashes

K1, B = 1.2, 0.75
#: Retrieved from this share of an item's own score.
LEAST_SCORE = 0.5
OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
WORDS = 5
#: Items in one index and items in one of its blocks; larger benchmarks are searched index by index, with the same results.
INDEX_ITEMS, BLOCK = 20_000, 8
#: Up to so many bytes of digests of texts that were hit are sent to the rows; with more, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, _, rows = word_bounds(data, offsets, ALNUM)
    return word_hashes(data, starts, ALNUM), rows


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last line, else the last sentence, else there is none.

    The default of the parameter `split`: a benchmark of another layout brings its own; an empty answer asks nothing.
    """
    body = text.strip()
    head, mark, tail = body.rpartition("\n")
    if not mark:
        head, mark, tail = body.rstrip(".!?").rpartition(". ")
    return (head, tail) if mark and head.strip() and tail.strip() else (body, "")


def _counted(batches):
    """Of each batch: (term, items that hold it), and under no term the items with words, their words and the most of one."""
    for batch in batches:
        words, rows = _words(batch.column("text"))
        n = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([rows.astype(U64), words]), axis=1)
        terms, df = np.unique(pairs[1], return_counts=True)
        cells = ([*terms.view(np.int64).tolist(), None], [*df.tolist(), int((n > 0).sum())], [*[0] * len(terms), int(n.sum())], [*[0] * len(terms), int(n.max(initial=0))])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["term", "items", "words", "longest"])


class Statistics:
    """What BM25 needs of a whole benchmark: its items with words, their words, the longest, and by lookup the items that hold a term."""

    def __init__(self, benchmark: DataFrame):
        self.spark = benchmark.sparkSession
        counted = benchmark.select("text").mapInArrow(_counted, "term long, items long, words long, longest long")
        self.counts = staged(counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "benchmark-terms")
        whole = self.counts.where("term is null").first()
        self.items, self.words, self.longest = (whole.items, whole.words, whole.longest) if whole else (0, 0, 0)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """Items of the whole benchmark that hold each of some sorted terms, those of one index."""
        if not len(terms):
            return np.zeros(0, np.int64)
        asked = self.spark.createDataFrame(pa.table({"term": terms.view(np.int64)}))
        found = self.counts.select("term", "items").join(F.broadcast(asked), "term").toArrow()
        out = np.zeros(len(terms), np.int64)
        out[np.searchsorted(terms, found.column("term").to_numpy().view(U64))] = found.column("items").to_numpy()
        return out


class Index:
    """Inverted index of (item_id, text) rows of a benchmark: impacts by term, block maxima, and the items' shingles."""

    def __init__(self, items: list[tuple[object, str]], whole: Statistics, split: Callable[[str], tuple[str, str]] = split_answer):
        texts = [t or "" for _, t in items]
        words, rows = _words(pa.array(texts, pa.string()))
        n = np.bincount(rows, minlength=len(items))
        keep = np.flatnonzero(n)  # items without words match nothing
        self.ids = [items[i][0] for i in keep]
        rows = np.searchsorted(keep, rows)
        n = n[keep]
        self.longest = whole.longest
        self.terms, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(rows * max(1, len(self.terms)) + term, return_counts=True)
        item, term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        df = np.bincount(term, minlength=len(self.terms))
        everywhere = whole.frequencies(self.terms)
        idf = np.log(1 + (whole.items - everywhere + 0.5) / (everywhere + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(1.0, whole.words / max(1, whole.items))))
        own = np.bincount(item, impact, minlength=len(n))
        impact = impact / own[item]
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], impact[order], term[order]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # Non-essential: from the most frequent term on, while no item has more than half the threshold of them.
        mass, self.essential = np.zeros(len(n)), np.ones(len(self.terms), bool)
        for t in np.argsort(-df, kind="stable"):
            at, w = self.item[self.first[t] : self.first[t + 1]], self.impact[self.first[t] : self.first[t + 1]]
            if df[t] < 2 or (mass[at] + w > LEAST_SCORE / 2).any():
                break
            mass[at] += w
            self.essential[t] = False
        block = self.item // BLOCK
        self.blocks = int(-(-len(n) // BLOCK))
        key = term * max(1, self.blocks) + block
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        self.block_max = np.maximum.reduceat(self.impact, starts) if len(key) else np.zeros(0)
        self.block_of = block[starts]
        self.block_first = np.searchsorted(key[starts] // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.rest = np.zeros(max(1, self.blocks))
        np.maximum.at(self.rest, np.arange(len(n)) // BLOCK, mass)
        self.present = np.zeros(1 << 16, bool)
        self.present[(self.terms & U64(0xFFFF)).astype(int)] = True
        self.grams, self.parts = [], []
        for i in keep:
            w, _ = _words(pa.array([texts[i]]))
            k = min(WORDS, len(w))
            self.grams.append((k, np.unique(gram_hashes(w, k)[: len(w) - k + 1])))
            parts = []
            for part in split(texts[i]):
                w, _ = _words(pa.array([part]))
                parts.append((min(WORDS, len(w)), np.unique(gram_hashes(w, min(WORDS, len(w)))[: len(w) - min(WORDS, len(w)) + 1])) if len(w) else None)
            self.parts.append(parts)

    @staticmethod
    def _spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all entries of `terms` in a list cut by `first`, and which term each is of."""
        size = first[terms + 1] - first[terms]
        of = np.repeat(np.arange(len(terms)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[terms][of], of

    def retrieve(self, passages: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) with score >= LEAST_SCORE, from distinct (passage, term) pairs sorted by passage."""
        sure = self.essential[terms]
        at, of = self._spread(self.block_first, terms[sure])
        cell, where = np.unique(passages[sure][of] * self.blocks + self.block_of[at], return_inverse=True)
        bound = np.bincount(where, self.block_max[at], minlength=len(cell)) + self.rest[cell % self.blocks]
        cell = cell[bound >= LEAST_SCORE - 1e-9]
        if not len(cell):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        live = np.isin(passages, cell // self.blocks)
        at, of = self._spread(self.first, terms[live])
        p, item = passages[live][of], self.item[at]
        near = np.isin(p * self.blocks + item // BLOCK, cell)
        pair, where = np.unique(p[near] * len(self.ids) + item[near], return_inverse=True)
        score = np.bincount(where, self.impact[at][near], minlength=len(pair))
        good = score >= LEAST_SCORE - 1e-9
        return pair[good] // len(self.ids), pair[good] % len(self.ids), score[good]

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item, score, overlap, question_overlap, answer_overlap) of verified matches, the best passage each.

        Passages are windows of twice the longest item's words, each half over the next, over the whole text: every
        occurrence of an item lies whole in one of them.
        """
        if not self.ids:
            return []
        words, rows = _words(texts)
        place, _ = row_places(rows)
        stride = self.longest
        known = np.flatnonzero(self.present[(words & U64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[known])
        hit = self.terms[np.minimum(term, len(self.terms) - 1)] == words[known]
        known, term = known[hit], term[hit]
        if not len(known):
            return []
        last = np.zeros(len(texts), np.int64)
        np.maximum.at(last, rows, place // stride)
        base = np.r_[0, np.cumsum(last + 1)]
        here = base[rows[known]] + place[known] // stride
        keys = np.r_[here * len(self.terms) + term, (here - 1)[place[known] >= stride] * len(self.terms) + term[place[known] >= stride]]
        keys = np.unique(keys)
        passage, item, score = self.retrieve(keys // len(self.terms), keys % len(self.terms))
        if not len(passage):
            return []
        row = np.searchsorted(base, passage, "right") - 1
        begin = np.searchsorted(rows, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple] = {}
        for r, p, i, s in zip(row.tolist(), passage.tolist(), item.tolist(), score.tolist()):
            a = begin[r] + (p - base[r]) * stride
            body = words[a : min(begin[r + 1], a + 2 * stride)]
            overlap = self._share(body, self.grams[i])
            question, answer = (self._share(body, x) if x else 1.0 for x in self.parts[i])
            if overlap >= OVERLAP or (question >= OVERLAP and answer >= ANSWER_OVERLAP):
                best[r, i] = max(best.get((r, i), (0.0,)), (s, overlap, question, answer))
        return [(r, i, *x) for (r, i), x in sorted(best.items())]

    @staticmethod
    def _share(words: np.ndarray, grams: tuple[int, np.ndarray]) -> float:
        k, wanted = grams
        return float(np.isin(wanted, gram_hashes(words, k)[: max(0, len(words) - k + 1)]).mean())


def contaminated(docs: DataFrame, benchmark: DataFrame, split: Callable[[str], tuple[str, str]] = split_answer) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of every document and item that overlap.

    An item overlaps where five-word shingles of one passage hold 0.8 of the item's, or 0.8 of the question's and
    half of the answer's, which `split` tells apart (items of fewer words: all of them in a row). Items and texts that are null, empty or
    without letters and digits match nothing. Rows that repeat an item or a document are each searched. The
    benchmark is read INDEX_ITEMS items at a time, in item order, and each index is broadcast: its size is bounded
    whatever the benchmark's. The cut changes no result: statistics and windows are those of the whole benchmark.
    """
    return _matches(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, split)


def _matches(rows: DataFrame, benchmark: DataFrame, split: Callable[[str], tuple[str, str]] = split_answer) -> DataFrame:
    """What `contaminated` gives, for rows of (any key, text)."""
    spark = lean(rows.sparkSession)
    name, key = rows.schema[0].name, rows.schema[0].dataType
    whole = Statistics(benchmark)
    kind = benchmark.schema["item_id"].dataType
    schema = f"{name} {key.simpleString()}, item_id {kind.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double"

    def found(items):
        index = spark.sparkContext.broadcast(Index(items, whole, split))

        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    hits, own = index.value.search(part.column("text")), part.column(name).to_pylist()
                    cells = [[own[h[0]] for h in hits], [index.value.ids[h[1]] for h in hits], *([h[j] for h in hits] for j in range(2, 6))]
                    names = [name, "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

        return rows.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(key), to_arrow_type(kind), *[pa.float64()] * 4]
    out, held = None, []
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append((row.item_id, row.text))
        if len(held) == INDEX_ITEMS:
            out, held = found(held) if out is None else out.union(found(held)), []
    if held or out is None:
        out = found(held) if out is None else out.union(found(held))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, split: Callable[[str], tuple[str, str]] = split_answer) -> DataFrame:
    """The rows whose text overlaps no item, with the columns of docs; ids, repeated or null, play no part.

    Null and empty texts overlap nothing and stay. Repeated rows go or stay together. Empty tables on either side take
    nothing away.
    """
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    gone = _matches(docs.select(digest("text").alias("digest"), "text"), benchmark, split).select(F.col("digest").alias("gone")).distinct()
    gone = staged(gone, "decontaminate-texts")
    few = gone.count() * 64 <= BROADCAST_BYTES
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any names will do
    rows = rows.withColumn("digest", digest(f"c{docs.columns.index('text')}"))
    return rows.join(F.broadcast(gone) if few else gone, F.col("digest") == F.col("gone"), "left_anti").drop("digest").toDF(*docs.columns)
