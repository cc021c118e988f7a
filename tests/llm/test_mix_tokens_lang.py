import json
import random
import zlib

import numpy as np
import pytest
from llm.helpers import DOCS, docs

from condensa.llm import language_id, mixing, token_codes


def filled(sizes, budget=1.5, most=2, cycle=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_are_the_reshared_fixed_point(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {s: rng.choice([0, 5, 50, 400, 3000]) for s in ["a", "b", "c", "d", None, "ä"]}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = filled(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in got) and len(got) == 6


def test_mix_nears_targets_and_reruns_agree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(900)] + [(7, None), (7, ""), (8, " \t\n", None, None)]
    mixed = mixing.mix(docs(spark, rows)).toPandas()
    assert len(mixed) == len(rows) and (mixed.taken <= 2 * mixed["size"]).all() and (mixed.taken % mixed["size"].clip(lower=1) == 0).all()
    for source, part in mixed.groupby(mixed.source.fillna("null")):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 2 * 60, source
    assert mixed.taken.sum() <= 1.5 * mixed["size"].sum()
    again = mixing.mix(docs(spark, rows[::-1])).toPandas()
    key = ["doc_id", "size", "taken"]
    assert mixed[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, "")])).toPandas().taken.sum() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70000, 13))])
def test_codes_round_trip_and_random_access(ids):
    codes = token_codes.Codes(token_codes.encode_ids(np.array(ids, np.uint32)))
    assert codes.slice(0, len(ids)).tolist() == ids and len(codes) == len(ids)
    for i in list(range(0, len(ids), 97)) + [max(0, len(ids) - 1)] * bool(ids):
        assert codes[i] == ids[i]
        assert codes.slice(i, min(len(ids), i + 700)).tolist() == ids[i : i + 700]


def test_rows_of_one_id_have_places_that_their_texts_settle(spark, monkeypatch):
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "SHARD_IDS", 50)
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(9)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(0, 9)))) for i in range(150)] + [(None, None), (7, None)]
    model, want, at = Tokenizer.from_file(path), [], 0
    placed = docs(spark, rows).select("doc_id", F.xxhash64("text").alias("tie"), "text").collect()
    for r in sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)):
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for given in (rows, rows[::-1]):
        assert sorted(map(tuple, token_codes.encode_table(docs(spark, given), path).collect()), key=lambda r: r[1]) == want


TEXTS = ["The then, it's WE'LL 2024!", None, "", " \n ", "a<|endoftext|>b <|startoftext|>", "É́tion dans ñ\x1cx Σας ΟΔΟΣ İ y", "word " * 3000, "re've 're  ''s\t\tx\r\ny", "日本語 テキスト 🙂🙂", "x" * 5000]


@pytest.mark.parametrize("shard", [1 << 18, 40])
def test_token_table_equals_whole_text_encoding(spark, monkeypatch, shard):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "SHARD_IDS", shard)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)]
    random.Random(1).shuffle(rows)
    got = token_codes.encode_table(docs(spark, rows), path).orderBy("doc_id").collect()
    model, at = Tokenizer.from_file(path), 0
    for row, (doc, text) in zip(got, sorted(rows), strict=True):
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_equal_whole_texts_on_any_characters():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    model, pieces = Tokenizer.from_file(path), token_codes.WordTokens(path)
    some = list("aAbzZ  \n\t.,;:!?'-_<|>09éÉÈñÑüÜßÿ×÷ØøÞþ") + ["\u0301", "\u0327", "\u0308", "\u00a0", "\u2003", "İ", "ı", "ς", "Σ", "K", "Å", "\x1c", "'re", "'S", "<|endoftext|>", "ﬁ", "Ǆ", "日", "🙂", "²", "½", "ª", "\u00ad", "ẞ"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(4000)]
    ids, ends = pieces(pa.array(texts))
    starts = [0, *ends[:-1]]
    for text, a, b in zip(texts, starts, ends):
        assert ids[a:b].tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
    for text in texts[:1500]:  # one by one too: special strings change how the rest of a slice is read
        assert pieces(pa.array([text]))[0].tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_table_keeps_repeats_and_nulls(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_codes.encode_table(docs(spark, [(4, "a b"), (4, "a b"), (None, "c")]), path).collect()
    assert sorted((r.doc_id or -1, r.start, r.n_tokens) for r in got) == [(-1, 0, 2), (4, 2, 3), (4, 5, 3)]
    assert token_codes.encode_table(spark.createDataFrame([], DOCS), path).count() == 0


def test_language_is_learned_and_unknown_stays_unknown(spark):
    rng = random.Random(2)
    words = {"xx": "the of and thing ation ing er".split(), "yy": "der die und keit schaft ung zu".split(), "zz": "ción mente los las ñez que".split()}
    rows = [(i, " ".join(rng.choices(words[lang := rng.choice(list(words))], k=rng.randint(3, 80))), lang) for i in range(400)]
    model = language_id.train(docs(spark, rows[:300]), sample=60)
    assert model.langs == ["xx", "yy", "zz"]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 + 3 = __ !", "xx"), (1003, "a", "xx"), (1004, "der die " * 50000, None)]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, rows[300:] + odd), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[300:]]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and not any(got[i].accepted for i in (1000, 1001, 1002))
    assert got[1003].lang_pred in model.langs and got[1004].lang_pred == "yy" and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels_or_rows(spark):
    none = language_id.train(docs(spark, [(1, "abc", None)]))
    assert none.langs == ["und"]
    assert language_id.identify(spark.createDataFrame([], DOCS), none).count() == 0


def test_language_windows_stop_at_rows():
    import pyarrow as pa

    joined = language_id.windows(pa.array(["abc", "def"]))
    alone = [language_id.windows(pa.array([x]))[0] for x in ("abc", "def")]
    assert np.array_equal(joined[0], np.concatenate(alone)) and joined[1].tolist() == [0, 0, 0, 1, 1, 1]


def test_only_files_with_the_needed_properties_are_read_by_pieces(tmp_path, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_codes.by_pieces(path) and not token_codes.WordTokens(path).whole
    told = json.load(open(path, encoding="utf-8"))
    told["normalizer"]["normalizers"].pop()  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told), encoding="utf-8")
    tokens = token_codes.WordTokens(str(other))
    texts = ["The THE then", None, "a  B"]
    ids, ends = tokens(pa.array(texts))
    assert tokens.whole and [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [Tokenizer.from_file(str(other)).encode(t or "", add_special_tokens=False).ids for t in texts]
    # A worker that forgets all pieces between slices gives the same ids.
    monkeypatch.setattr(token_codes, "CACHE_BYTES", 0)
    small, model = token_codes.WordTokens(path), Tokenizer.from_file(path)
    for text in ("the then the", "then other 12", "", "the ."):
        assert small(pa.array([text]))[0].tolist() == model.encode(text, add_special_tokens=False).ids


def test_mix_of_rows_that_repeat_an_id_is_settled_by_their_texts(spark):
    rng = random.Random(6)
    rows = [(i % 7, " ".join(["w"] * rng.randint(1, 40)) + f" {i}", "en", "a" if i % 3 else "b") for i in range(120)] + [(None, f"x {i} " * 9, "en", "a") for i in range(20)]
    key = ["doc_id", "size", "taken"]
    first = sorted(map(str, mixing.mix(docs(spark, rows), whole=True).select("row.text", *key).collect()))
    for order in (rows[::-1], sorted(rows, key=lambda r: r[1])):
        assert sorted(map(str, mixing.mix(docs(spark, order).repartition(5), whole=True).select("row.text", *key).collect())) == first
    assert mixing.mixed(docs(spark, rows)).count() > len(rows)


def samples(rng, words, n, lengths):
    return [(i, " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(rng.choice(lengths))), lang) for i in range(n) for lang in [rng.choice(list(words))]]


SYLLABLES = {"xx": "the of and thing ation ing er wh sh ou".split(), "yy": "der die und keit schaft ung zu ich ein".split(), "zz": "ción mente los las ñez que ar o".split()}


def test_language_scores_are_calibrated_and_unseen_languages_rejected(spark):
    rng = random.Random(9)
    model = language_id.train(docs(spark, samples(rng, SYLLABLES, 900, [1, 2, 5, 30, 100])), sample=200)
    assert 0.005 < model.temperature < 5 and model.threshold > 1 / 3
    test = samples(rng, SYLLABLES, 1500, [1, 1, 2, 3])
    got = {r.doc_id: r for r in language_id.identify(docs(spark, test), model).collect()}
    right, score = np.array([got[i].lang_pred == lang for i, _, lang in test]), np.array([got[i].score for i, _, _ in test])
    bins = np.minimum((score * 5).astype(int), 4)
    gap = sum(abs(score[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))
    assert gap < 0.08, gap
    kept = np.array([got[i].accepted for i, _, _ in test])
    assert right[kept].mean() >= 0.97 and kept[right].mean() > 0.95
    unseen = {"pl": "wą szcz ję rzy dź łó ży mu tu".split(), "fi": "kää yö uu tta ssa lli äi jo ki".split(), "ru": "при ств ова ный ще ро ла".split()}
    odd = samples(rng, unseen, 300, [20, 60])
    refused = [not r.accepted for r in language_id.identify(docs(spark, odd), model).collect()]
    assert np.mean(refused) > 0.9, np.mean(refused)


def test_the_training_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rng, sizes = random.Random(10), []
    monkeypatch.setattr(language_id, "fit", lambda rows: sizes.append([x[0] for x in rows]) or language_id.Model(["xx"], np.zeros((language_id.BUCKETS, 1), np.float32), np.zeros(1)))
    rows = [(7, f"the thing {i}", "xx") for i in range(500)] + [(None, f"of and {i}", "xx") for i in range(50)] + [(9, "die und", "yy")] * 400 + [(i, t, lang) for i, t, lang in samples(rng, SYLLABLES, 200, [3])]
    language_id.train(docs(spark, rows + [(1, None, "xx"), (2, "", "yy")]), sample=40)
    assert max(sizes[0].count(x) for x in ("xx", "yy", "zz")) <= 40 and sizes[0].count("yy") > 1


def test_held_out_documents_are_told_right(spark):
    """The query on the synthetic documents: all held-out documents with letters and a label, by the label they have."""
    from condensa.llm import queries

    got = {r.doc_id: r for r in queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {d for d, r in got.items() if r.held_out}
    told = [r for r in held if r.lang and any(c.isalpha() for c in r.text or "")]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in told]) > 0.98
    assert all(got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert np.mean([got[r.doc_id].accepted for r in told]) > 0.98
