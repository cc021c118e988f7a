import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm.helpers import docs
from llm.test_decontaminate import brute as leaks
from llm.test_minhash import brute as classes
from tokenizers import Tokenizer

from condensa.llm import decontaminate, minhash_dedup

WORDS = {"en": "the of and thing ation ing er with that".split(), "de": "der die und keit schaft ung zu ein ist".split()}


def corpus(rng):
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de"])
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 120)))
        rows.append((len(rows), text, lang, rng.choice(["a", "a", "b", None])))
        if i % 9 == 0:
            rows.append((len(rows), text, lang, "b"))
        if i % 13 == 0:
            rows.append((len(rows), "12345 !!! 678", lang, "a"))
    return rows + [(len(rows), None, "en", "a"), (len(rows) + 1, "", None, "a")]


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus(rng)
    items = [(i, " ".join(rows[i * 7][1].split()[:18])) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs(spark, rows).selectExpr("*", "source as score", "doc_id as c0", "text as twin_a", "1 as size", "'x' as row")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == table.columns, name
        at[name] = kept.toPandas()
    texts = {r[0]: r[1] for r in rows}
    letters = {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert set(at["language_id"].doc_id) == letters
    root = classes([(d, texts[d]) for d in letters])
    assert sorted(at["minhash_dedup"].doc_id) == sorted(set(root.values()))
    gone = {d for d, _ in leaks([(d, texts[d]) for d in set(root.values())], items)}
    assert set(at["decontamination"].doc_id) == set(root.values()) - gone and gone
    words, mixed = at["decontamination"].text.str.split().str.len().sum(), at["mixing"]
    taken = mixed.text.str.split().str.len().sum()
    assert 1.5 * words - 500 <= taken <= 1.5 * words and mixed.doc_id.value_counts().max() == 2
    assert (mixed.twin_a == mixed.text).all() and set(mixed.doc_id) <= set(at["decontamination"].doc_id)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d in mixed.doc_id for ids in [model.encode(texts[d], add_special_tokens=False).ids + [2]])
    assert sorted(zip(out.doc_id, out.n_tokens, out.ids_crc32)) == want
    assert decontaminate.split_answer("a. b") == ("a", "b")


def test_stages_drop_rows_and_not_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    items = spark.createDataFrame([(1, text["a"])], "item_id long, text string")
    rows = [(None, text["a"]), (None, text["b"]), (None, None), (2, text["a"]), (2, text["c"]), (3, text["d"])]
    clean = decontaminate.decontaminated(docs(spark, rows), items).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted([(None, text["b"]), (None, None), (2, text["c"]), (3, text["d"])], key=str)
    rows = [(1, text["a"]), (5, text["b"]), (5, text["c"]), (5, text["c"]), (5, text["c"] + " more"), (6, text["b"]), (6, text["d"]), (7, text["a"]), (7, text["e"]), (8, None)]
    kept = sorted(((r.doc_id, r.text) for r in minhash_dedup.deduplicated(docs(spark, rows)).collect()), key=str)
    near = [r for r in kept if r in ((5, text["c"]), (5, text["c"] + " more"))]
    assert len(near) == 1 and [r for r in kept if r not in near] == sorted([(1, text["a"]), (5, text["b"]), (6, text["d"]), (7, text["e"]), (8, None)], key=str)
