"""Every operator over tables with extra columns whose names clash with its own, and with nulls everywhere."""

import random

import pytest
from llm.helpers import DOCS, docs
from pyspark.sql import functions as F

from condensa.llm import chat_format, decontaminate, embedding_dedup, html_extract, importance, language_id, minhash_dedup, mixing, secrets, substring_dedup, suffix_dedup, token_codes, whitening

CLASH = ("n", "u", "v", "of", "row", "rep", "key", "band", "bands", "size", "turn", "part", "place", "places", "start", "end", "digest", "first", "slice", "target", "taken", "run", "node", "component", "gone", "score", "host", "wrapper", "template", "turns", "path", "block", "blob", "dim", "c0", "keys", "copies", "row number", "a.b")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(7))
    return df


def rows(df):
    return sorted((str(sorted(r.asDict(recursive=True).items())) for r in df.collect()))


def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 120))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(60)]
    made += [(70, made[5][1]), (71, made[5][1] + " more"), (None, "null id text of some words here"), (72, None, None, None), (73, "", None, None), (5, made[5][1]), (74, "long " * 60_000)]
    return docs(spark, made)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bench(spark):
    return clashing(spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (None, "w7 w8 w9 w10 w11 w12"), (2, None)], "item_id long, text string"))


OVER_DOCS = {
    "lines": lambda s, d: substring_dedup.repeated_units(d),
    "runs": lambda s, d: substring_dedup.repeated_runs(d, least_run=1),
    "left": lambda s, d: substring_dedup.without_repeats(d, least_run=1),
    "secrets": lambda s, d: secrets.secrets(d),
    "draw": lambda s, d: importance.resample(d, bench(s)),
    "cut": lambda s, d: substring_dedup.removed(d, substring_dedup.repeated_units(d)),
    "tokens": lambda s, d: token_codes.encode_table(d, vocabulary()).select("doc_id", "n_tokens", "ids_crc32"),
    "language": lambda s, d: language_id.identify(d, language_id.train(d)),
    "suffixes": lambda s, d: suffix_dedup.repeated_passages(d),
    "mix": lambda s, d: mixing.mix(d),
    "near": lambda s, d: minhash_dedup.near_duplicates(d),
    "leaks": lambda s, d: decontaminate.contaminated(d, bench(s)),
}
STAGES = {
    "language": lambda s, d: language_id.accepted(d, language_id.train(d)),
    "near": lambda s, d: minhash_dedup.deduplicated(d),
    "leaks": lambda s, d: decontaminate.decontaminated(d, bench(s)),
    "mix": lambda s, d: mixing.mixed(d),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_extra_columns_change_nothing(spark, name):
    run = OVER_DOCS[name]
    assert rows(run(spark, clashing(corpus(spark)))) == rows(run(spark, corpus(spark)))
    assert run(spark, clashing(spark.createDataFrame([], DOCS))).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(spark, name):
    given = clashing(corpus(spark))
    out = STAGES[name](spark, given)
    assert out.columns == given.columns and set(rows(out)) <= set(rows(given))
    assert STAGES[name](spark, clashing(spark.createDataFrame([], DOCS))).count() == 0


def test_other_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], None), (None, None, None), (3, [0.0, None], 1)], "vec_id long, embedding array<float>, label int")
    assert rows(embedding_dedup.near_duplicates(clashing(vectors))) == rows(embedding_dedup.near_duplicates(vectors))
    assert rows(whitening.whiten(clashing(vectors))) == rows(whitening.whiten(vectors))
    pages = spark.createDataFrame([(1, "http://a.b/c", "<article><p>x</p></article>"), (None, None, None), (2, "http://a.b/d", "")], "page_id long, url string, html string")
    assert rows(html_extract.extract(clashing(pages))) == rows(html_extract.extract(pages))
    talks = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, None, None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    plain, odd = (chat_format.digests(spark, chat_format.formatted(t)) for t in (talks, clashing(talks)))
    assert rows(plain) == rows(odd) and plain.count() == 2
