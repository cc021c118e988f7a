import random

import numpy as np
import pytest
from llm.helpers import DOCS, docs

from condensa.llm import substring_dedup as L
from condensa.llm import suffix_dedup as S
from condensa.llm.common import word_hashes


def brute_lines(rows, least):
    seen, out = set(), []
    for d, t in sorted(rows):
        at = 0
        for no, line in enumerate((t or "").split("\n")):
            key = " ".join(line.lower().split())
            if len(key.split()) >= least:
                if key in seen:
                    out.append((d, no, at, at + len(line)))
                seen.add(key)
            at += len(line) + 1
    return sorted(out)


def test_lines_equal_brute_force_and_offsets_hold(spark):
    rng = random.Random(0)
    lines = [" ".join(rng.choices("Alpha beta é🙂 gamma DELTA".split(), k=rng.randint(0, 9))) for _ in range(60)]
    rows = [(d, "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 12)))) for d in range(80)] + [(100, None), (101, ""), (102, "\n\n")]
    got = L.repeated_units(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.unit, r.start, r.end) for r in got) == brute_lines([r for r in rows if r[1]], 5) and got
    texts = dict(rows)
    assert all(len(texts[r.doc_id][r.start : r.end].split()) == r.n_words and (r.first_doc_id, r.first_unit) < (r.doc_id, r.unit) for r in got)
    gone = {(r.doc_id, r.start) for r in got}
    for r in L.removed(docs(spark, rows), L.repeated_units(docs(spark, rows))).collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "".join(t[k.start : k.end] for k in r.kept))
        assert not any(k.start <= s < k.end for k in r.kept for d, s in gone if d == r.doc_id)


def test_paragraphs(spark):
    p, q = "one two three\nfour five six", "seven eight nine ten eleven"
    got = L.repeated_units(docs(spark, [(1, f"{p}\n\n{q}"), (2, f"{q}\n \n{p}\n")]), kind="paragraph").collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(2, 0, len(q)), (2, len(q) + 3, len(q) + 3 + len(p))]


def test_lines_of_a_hot_unit_and_of_nothing(spark):
    rows = [(d, f"the same five words here\nown line of document {d}") for d in range(500)]
    assert sorted(r.doc_id for r in L.repeated_units(docs(spark, rows)).collect()) == list(range(1, 500))
    assert L.repeated_units(spark.createDataFrame([], DOCS)).count() == 0


def brute_passages(rows, least=S.LEAST):
    seen, out = {}, []
    for d, t in sorted(rows):
        words = (t or "").lower().split()
        again = []
        for i in range(len(words) - least + 1):
            key = tuple(words[i : i + least])
            if key in seen:
                again.append(i)
            else:
                seen[key] = d
        for i in again:
            if out and out[-1][0] == d and i <= out[-1][2]:
                out[-1] = (d, out[-1][1], i + least)
            else:
                out.append((d, i, i + least))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"p{k}w{i}é" for i in range(n)] for k, n in enumerate((50, 51, 49, 60, 130, 75, 52, 400))]
    rows = []
    for d in range(250):
        body = [f"W{rng.randrange(10**6)}" for _ in range(rng.choice([0, 10, 80, 300]))]
        for p in rng.sample(shared, rng.choice([0, 1, 1, 2])):
            a = rng.randint(0, 5) if len(p) > 100 else 0
            at = rng.randint(0, len(body))
            body[at:at] = p[a:]
        text = "".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in body)
        rows.append((d, text.upper() if rng.random() < 0.1 and "é" not in text else text))
    rows += [(400 + k, rows[k * 3][1]) for k in range(30)]
    return rows + [(300, None), (301, ""), (302, "of " * 200), (303, "of " * 120), (304, " ".join(f"x{i % 60}" for i in range(200)))]


@pytest.mark.parametrize("few", [0, 1 << 25])
def test_passages_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(S, "BROADCAST_BYTES", few)
    rows = passages(7)
    got, texts = S.repeated_passages(docs(spark, rows)).collect(), dict(rows)

    def words_before(t, at):
        return len(t[:at].split())

    assert sorted((r.doc_id, words_before(texts[r.doc_id], r.start), words_before(texts[r.doc_id], r.end)) for r in got) == brute_passages(rows)
    for r in got:
        span, there = texts[r.doc_id][r.start : r.end].split(), texts[r.first_doc_id][r.first_start :].split()
        assert len(span) == r.n_words and [w.lower() for w in span[: S.LEAST]] == [w.lower() for w in there[: S.LEAST]]


def test_a_passage_in_every_document(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(d, f"a{d} b{d} {shared} c{d}") for d in range(700)]
    got = S.repeated_passages(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 700)) and {(r.n_words, r.first_doc_id) for r in got} == {(60, 0)}


def test_null_ids_repeated_rows_and_nothing(spark):
    text = " ".join(f"s{i}" for i in range(60))
    assert S.repeated_passages(docs(spark, [(None, text), (1, text), (1, text)])).count() == 0
    assert S.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_hashes_of_runs_do_not_depend_on_place():
    words = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for k in (3, 26, 50):
        whole = S._long_hash(words, k, 1)
        assert len(set(whole.tolist())) == len(words) - k + 1
        assert all(S._long_hash(words[i : i + k + j], k, 1)[0] == whole[i] for i, j in ((0, 0), (7, 3), (440, 9)))
    assert len(word_hashes(np.frombuffer(b"ab cd", np.uint8), np.array([0, 3]))) == 2


def brute_runs(rows, least):
    import re

    seen, out = set(), []
    for d, t in sorted(rows):
        run, body, at = [], t or "", 0
        flush = lambda: out.extend((d, a, b) for a, b, _ in run) if sum(w for _, _, w in run) >= least else None
        for piece in re.findall(r".*?(?:[.!?,;:]+(?=\s|$)|\n|$)", body, re.S):
            a = at + len(piece) - len(piece.lstrip())
            b, key = a + len(piece.strip()), " ".join(piece.lower().split())
            at += len(piece)
            if key and key in seen:
                run.append((a, b, max(len(key.split()), (b - a) // 8)))
            elif key:
                seen.add(key)
                flush()
                run = []
        flush()
    return sorted(out)


def test_runs_equal_brute_force_short_units_go_with_their_run(spark):
    rng = random.Random(4)
    pieces = ["".join(rng.choices(["Alpha ", "béta ", "gamma🙂 ", "DELTA\t"], k=rng.randint(1, 6))).strip() + rng.choice([".", ",", "?!", "\n", ": ", " 3.14;"]) for _ in range(40)]
    rows = [(d, "".join(rng.choice(pieces) + rng.choice([" ", "\n", " \n\n"]) for _ in range(rng.randint(0, 14)))) for d in range(90)]
    rows += [(100, None), (101, ""), (102, " \n.\n"), (103, "漢字" * 200), (104, "漢字" * 200), (105, "of.\n" * 40), (106, "x " * 20000)]
    for least in (1, 8, 30):
        got = L.repeated_runs(docs(spark, rows), least_run=least).collect()
        assert sorted((r.doc_id, r.start, r.end) for r in got) == brute_runs(rows, least) and got
        assert all(r.run_weight >= least and (r.first_doc_id, r.first_unit) < (r.doc_id, r.unit) for r in got)
    assert {104, 105} <= {r.doc_id for r in got}
    assert L.repeated_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_of_one_row_whatever_its_id(spark):
    text = "One two three four five six, seven eight nine ten eleven twelve. " * 4
    got = L.repeated_runs(docs(spark, [(1, "own words"), (5, text), (5, "other " + text), (None, "alone"), (None, text + "more")])).collect()
    assert {r.doc_id for r in got} == {None, 5} and all(r.run_weight >= 30 for r in got)


def test_rows_equal_in_all_are_repeats_of_each_other(spark):
    w, own = " ".join(f"w{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60)) + "."
    for id_ in (1, None):
        rows = [(id_, w), (id_, w), (id_, own), (9, own + " " + w)]
        got = L.repeated_runs(docs(spark, rows)).collect()
        assert sorted((r.doc_id is None or r.doc_id, r.n_words) for r in got) == sorted([(id_ is None or id_, 60), (9, 60), (9, 60)])
        left = L.without_repeats(docs(spark, rows)).collect()
        assert sorted(r.text for r in left) == sorted(["", w, own, ""]) and sum(r.doc_id == id_ for r in left) == 3
    cut = L.removed(docs(spark, [(1, "a"), (5, w), (5, own)]), L.repeated_runs(docs(spark, [(1, w), (5, w), (5, own)]))).collect()
    assert sorted(r.text for r in cut) == sorted(["a", "", own])  # the other text of the same id stays


@pytest.mark.parametrize("kind", ["line", "paragraph", "segment"])
def test_every_repeat_comes_with_its_weight(spark, kind):
    line = "ten words that are all there is of these documents"
    got = L.repeated_runs(docs(spark, [(1, line), (2, line), (3, None), (4, "")]), kind, 1).collect()
    assert [(r.doc_id, r.n_words, r.run_weight) for r in got] == [(2, 10, 10)]


def test_texts_that_share_an_id_are_searched_each_by_itself(spark):
    shared, own = " ".join(f"s{i}" for i in range(60)), " ".join(f"o{i}" for i in range(80))
    rows = [(1, shared), (5, shared), (5, own), (5, ""), (5, own + " x y " + shared), (6, own), (7, None), (7, own)]
    got = sorted((r.doc_id, r.start, r.n_words, r.first_doc_id) for r in S.repeated_passages(docs(spark, rows)).collect())
    assert [(d, n) for d, _, n, _ in got].count((5, 60)) == 2 and (6, 0, 80, 5) in got and (7, 0, 80, 5) in got
    # own stands twice under id 5, in texts of their own: the later of the two in the order of their digests is told.
    assert sum(n for d, _, n, f in got if d == 5 and f == 5) in (80, 82) and all(f <= d for d, _, _, f in got)


def test_neighbours_share_words_in_the_order_of_suffixes():
    codes = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [1, 9, 9], [7, 9, 9]], np.uint8)
    assert S.common(codes).tolist() == [3, 2, 1, 0]
