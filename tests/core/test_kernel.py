"""The kernel's invariants on every projection, and plans worked out by hand."""

import random

import pytest

from condensa.operators import kernel as K


def logs(rng, n):
    kinds = [lambda: f"2024-01-{rng.randint(10, 28)} INFO request {rng.randrange(999)} took {rng.randrange(99)} ms", lambda: f"ERROR code {rng.randrange(9)}", lambda: "", lambda: f"warn: {rng.choice('abc')} é🙂", lambda: "plain words here " * rng.randint(1, 6), lambda: f"Compiling crate v{rng.randrange(9)}", lambda: "error: mismatched types" if rng.random() < 0.02 else "note", lambda: f"@@ -{rng.randrange(9)} +1 @@", lambda: f"+added {rng.randrange(9)}", lambda: f'"key{rng.randrange(9)}": 1,']
    some = rng.sample(kinds, rng.randint(1, 5))
    return "\n".join(rng.choice(some)() for _ in range(n)) + rng.choice(["", "\n"])


def check(source, out, total, reserved, selected=False):
    size, limit = len(source), total - reserved
    spans = sorted([tuple(x) for x in out["retained"]] + [tuple(x) for x in out["omitted"]])
    if size and out["fidelity"] != "metadata_only" and out["fidelity"] != "encoded":
        assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert out["visible_count"] == len(out["visible"].encode()) <= limit and len(out["retained"]) <= 257 and len(out["omitted"]) <= 257
    if out["fidelity"] in ("exact", "extractive") and not selected:
        notes, parts, ends = {a: n for a, _, n in out["aggregates"]}, [], [b for _, b in out["retained"]]
        for k, (a, b) in enumerate(out["retained"]):
            if k and ends[k - 1] in notes:
                parts.append(K.annotation(notes[ends[k - 1]]).encode())
            parts.append(source[a:b])
        assert b"".join(parts).decode() == out["visible"]


@pytest.mark.parametrize("seed", range(6))
def test_every_projection_keeps_the_rules(seed):
    rng = random.Random(seed)
    for _ in range(60):
        source = logs(rng, rng.randint(0, 300)).encode()
        total, reserved = rng.choice([1, 5, 64, 300, 1000, 5000, 100_000]), rng.choice([0, 0, 1])
        profile = rng.choice(["auto/v1", "terminal-log/v1", "unified-diff/v1", "build-output/v1", "json/v1", "test-log/v1", "source-code/v1", "stack-trace/v1"])
        focus = rng.choice([None, "request code", "zzz", "error 7"])
        try:
            out = K.project(source, profile, total, reserved, focus)
        except K.Refused as e:
            assert str(e) in ("budget_unsatisfiable", "resource_exhausted"), e
            continue
        check(source, out, total, reserved)
        assert out == K.project(source, profile, total, reserved, focus)
        assert all(any(a <= x and y <= b for a, b in out["retained"]) for x, y in out["facts"])


def test_selections_come_back_in_source_offsets():
    rng = random.Random(3)
    for _ in range(80):
        source = logs(rng, rng.randint(1, 120)).encode()
        regions = K.select_pattern(source, b"re", rng.randint(0, 3), rng.randint(0, 3), rng.randint(1, 9)) if rng.random() < 0.7 else K.select_lines(source, rng.randint(1, 150), rng.randint(1, 40))
        try:
            out = K.project_selection(source, regions, total=rng.choice([50, 400, 9999]))
        except K.Refused:
            continue
        check(source, out, 9999, 0, True)
        assert b"".join(source[a:b] for a, b in out["retained"]).decode() == out["visible"]
        assert all(any(a <= x and y <= b for a, b in regions) or any(r[1] == s[0] for r, s in zip(regions, regions[1:])) for x, y in out["retained"])


def test_exact_binary_empty_and_zero():
    assert K.project(b"", total=0)["retained"] == [(0, 0)]
    assert K.project(b"abc", total=3)["fidelity"] == "exact"
    for bad in ((b"x", 0, 0), (b"x", 4, 4)):
        with pytest.raises(K.Refused, match="budget_unsatisfiable"):
            K.project(bad[0], total=bad[1], reserved=bad[2])
    with pytest.raises(K.Refused, match="invalid_request"):
        K.project(b"x", total=1, reserved=2)
    with pytest.raises(K.Refused, match="invalid_request"):
        K.project(b"x", profile="none")
    assert K.project(b"\xffA\n\x00", total=100)["visible"] == "\\xffA\n\\x00"
    assert K.project(b"\xff" * 100, total=30)["fidelity"] == "metadata_only"
    with pytest.raises(K.Refused, match="budget_unsatisfiable"):
        K.project(b"\xff\nerror: x\n" * 9, profile="build-log/v1", total=40)


def test_repeats_collapse_into_one_note():
    tail = b"".join(b"%c%c distinct words %s\n" % (97 + i, 97 + i, b"x" * i) for i in range(26))
    source = b"start\n" + b"".join(b"item %d of 9 done\n" % i for i in range(40)) + b"ERROR end here\n" + tail
    out = K.project(source, "terminal-log/v1", total=200)  # distinct lines use the budget up
    assert out["aggregates"] == [(source.index(b"item 1 "), source.index(b"ERROR"), 39)]
    assert out["visible"].startswith("start\nitem 0 of 9 done\n[excerpt: 39 repeated lines omitted]\nERROR end here\naa distinct")
    assert "[excerpt" not in K.project(source[: source.index(b"aa ")], "terminal-log/v1", total=200)["visible"]  # nothing distinct is left


def test_a_focus_moves_the_budget():
    source = b"".join(b"line %d of the text\n" % i for i in range(300)).replace(b"line 200 of", b"line 200 zebra")
    plain, focused = (K.project(source, "api-json/v1", total=200, focus=f)["visible"] for f in (None, "where is the zebra"))
    assert "zebra" not in plain and "zebra" in focused
    assert K.project(source, "api-json/v1", total=200, focus="of the line")["visible"] == plain


def test_mandatory_lines_or_nothing():
    source = b"noise\n" * 200 + b"error: first\n" + b"noise\n" * 200 + b"error: second\n"
    out = K.project(source, "build-output/v1", total=200)
    assert "error: first" in out["visible"] and "error: second" in out["visible"] and out["fact_ids"] == [f"build-output/v1:{a}-{b}" for a, b in out["facts"]] and len(out["facts"]) == 2
    with pytest.raises(K.Refused, match="budget_unsatisfiable"):
        K.project(source, "build-output/v1", total=20)
    with pytest.raises(K.Refused, match="resource_exhausted"):
        K.project(b"error: x\n" * 257, "build-output/v1", total=99999)


def test_one_long_line_gives_its_prefix():
    text = "aé🙂" * 400
    for n in (1, 2, 3, 6, 7, 8, 100):
        assert K.project(text.encode(), "plain-text/v1", total=n)["visible"] == text.encode()[:n].decode("utf-8", "ignore")


def test_span_ceiling_bridges():
    source = b"".join(b"@@ -%d +1 @@\n context %s\n" % (i, b"x" * 40) for i in range(400))
    out = K.project(source, "unified-diff/v1", total=4200)
    check(source, out, 4200, 0)
    assert len(out["retained"]) > 200


@pytest.mark.parametrize("text,shape", [
    ('{\n  "a": 1\n}', "api-json"), ("diff --git a b\n@@ -1 +1 @@\n-x\n+y", "unified-diff"), ("Traceback (most recent call last):\n  File \"a.py\", line 1\n  File \"b.py\", line 2\nValueError: x", "stack-trace"),
    ("ok 1 a\nok 2 b\n", "test-output"), ("Compiling x\nerror: bad\n", "build-output"), ("src/a.ts:1:2\n  bad thing", "typecheck-lint"), ("+a\n-b\n c", "typecheck-lint"), ("Compiling a\nCompiling b\nx", "build-output"),
    ("#!/bin/sh\nx", "source-file"), ("fn a() {\nlet b;\n}", "source-file"), ("hello world\n", "terminal-log"), ("", "terminal-log"), ("\u00a0\n[1]\n", "api-json"),
])
def test_shapes(text, shape):
    assert K.detect_shape(text) == shape


def test_token_budgets_count_by_the_callable():
    words = lambda b: len(b.split())
    source = b"".join(b"word %d here\n\n" % i for i in range(200))
    out = K.project(source, "terminal-log/v1", total=60, count=words)
    assert out["visible_count"] == words(out["visible"].encode()) <= 60 and out["original_count"] == 600


def test_translate_and_complement():
    assert K.translate([(10, 20), (20, 25), (40, 50)], [(5, 17)]) == [(15, 25), (40, 42)]
    assert K.complement(10, [(2, 4), (6, 10)]) == [(0, 2), (4, 6)] and K.complement(0, []) == [] and K.complement(3, []) == [(0, 3)]


def test_patterns_across_lines_and_at_line_ends():
    s = b"a\nbb\nc\nbb\nd\n"
    assert K.select_pattern(s, b"bb\nc", 0, 0) == [(2, 7)] and K.select_pattern(s, b"bb\n", 0, 0) == [(2, 5), (7, 10)]
    assert K.select_pattern(s, b"c", 1, 1) == [(2, 10)] and K.select_pattern(s, b"zz") == [] and K.select_pattern(s, b"b", 0, 0, 1) == [(2, 5)]
    assert K.select_lines(s, 2, 2) == [(2, 7)] and K.select_lines(s, 9, 2) == [] and K.select_lines(b"", 1, 1) == []


# ---------------------------------------------------------------- worked examples

@pytest.mark.parametrize("source,total,reserved,profile,want", [
    (b"exact-fit", 12, 3, "plain-text/v1", ("exact", "exact-fit", 9)), (b"exact-fit", 11, 3, "plain-text/v1", ("extractive", "exact-fi", 8)),
    (b"\xffA", 5, 0, "none/v1", ("encoded", "\\xffA", 5)), (b"\xff" * 64, 64, 0, "none/v1", ("metadata_only", "[binary source: 64 bytes]", 25)), (b"", 0, 0, "plain-text/v1", ("exact", "", 0)),
])
def test_fidelities(source, total, reserved, profile, want):
    out = K.project(source, profile, total, reserved)
    assert (out["fidelity"], out["visible"], out["visible_count"]) == want


def test_fact_ids_name_the_lines_of_the_applied_profile():
    out = K.project(b"head\nnoise noise noise\nerror[E1]: critical\nwarning: W1 is useful\ntail\n", "build-log/v1", 48)
    assert out["fact_ids"] == ["build-output/v1:23-43"]


@pytest.mark.parametrize("profile,lines", [
    ("build-output/v1", ["error[X7]: no such item", "warning: never read"]), ("typecheck-lint/v1", ["lib/a.rs:40:2: error: bad type", "--> lib/a.rs"]),
    ("test-output/v1", ["not ok 3 - sums", "ran 9 tests in 2 s"]), ("stack-trace/v1", ["ValueError: too small", "at parse (/srv/app/read.js:10:4)"]),
    ("unified-diff/v1", ["@@ -7 +7,2 @@", "-    total = 0"]), ("api-json/v1", ['"state": "done",', "}"]), ("source-file/v1", ["def total(rows):", "import math"]),
])
def test_every_shape_keeps_its_telling_lines(profile, lines):
    source = "top\n" + "a line like the others\n" * 70 + "\n".join(lines) + "\nbottom\n"
    out = K.project(source.encode(), profile, 200)
    assert all(f"{x}\n" in out["visible"] for x in lines) and out["visible_count"] <= 200 and f"{out['shape']}/v1" == profile


def test_bridges_go_to_the_nearest_neighbour():
    plan = K.Plan(b"alpha\nbravo\ncharlie\ndelta\necho\nfoxtrot\n", [], None, 257, K.LABEL)
    assert plan.bridge(0, 6) is None
    for span in ((6, 12), (20, 26)):
        plan.apply(plan.propose(*span)[2])
    assert (plan.bridge(31, 39), plan.bridge(0, 6), plan.bridge(13, 19)) == ((26, 39), (0, 6), (12, 19))
    plan.apply(plan.propose(26, 39)[2])
    assert list(zip(plan.starts, plan.ends)) == [(6, 12), (20, 39)]


def test_repeats_pay_for_distinct_lines():
    names = [f"{a}{b}{c}" for a in "mnp" for b in "aeiou" for c in "lrst"][:40]
    source = "begin\n" + "".join(f"Downloading part {i} of 70\n" for i in range(70)) + "".join(f"{n}: says something new\n" for n in names) + "end\n"
    folded, plain = (K.project(source.encode(), "build-output/v1", 600, aggregate=on) for on in (True, False))
    assert "Downloading part 0 of 70\n" in folded["visible"] and len(folded["aggregates"]) == 1 and folded["aggregates"][0][2] == 69
    kept = lambda out: sum(f"{n}: says" in out["visible"] for n in names)
    assert kept(folded) > kept(plain)


def test_candidates_are_offered_by_focus_then_structure_then_place():
    lines = ["error: stop\n", "warning: disk quota near\n", "the disk quota is a number\n", "warning: other\n"] + [f"filler {i:02}\n" for i in range(20)]
    source = "".join(lines).encode()
    spans = K.line_spans(source)
    mandatory, offered, _ = K._ranked(source, "build-output", True, K.focus_terms("disk quota"))
    assert mandatory == [spans[0]] and offered == [spans[1], spans[2], spans[3], spans[0], spans[-1]]
    assert K._ranked(source, "build-output", True, None)[1] == [spans[1], spans[3], spans[0], spans[-1]]


def test_selected_regions():
    source = b"alpha\nbravo\ncharlie\ndelta\necho\n"
    assert [K.select_lines(source, *x) for x in ((2, 2), (1, 99), (5, 1), (6, 1))] == [[(6, 20)], [(0, 31)], [(26, 31)], []]
    assert K.select_lines(b"one\ntwo", 2, 1) == [(4, 7)]
    pattern = lambda p, *x: K.select_pattern(source, p, *x)
    assert [pattern(b"charlie", k, k) for k in (0, 1, 9)] == [[(12, 20)], [(6, 26)], [(0, 31)]]
    assert [pattern(b"a\n", 0, 0), pattern(b"a\n", 2, 2), pattern(b"a\n", 0, 0, 1), pattern(b"bravo\ncharlie", 0, 0)] == [[(0, 6), (20, 26)], [(0, 31)], [(0, 6)], [(6, 20)]]


def slow_runs(lines, ordinary):
    """The rule for repeated lines spelled out: for each line all templates there are, oldest first."""
    import re

    templates, flags = [], []
    for line in lines:
        words = ["*" if re.search("[0-9]", w) else f"={w}" for w in re.split("[ \t\n\f\r]+", line) if w][:32]
        match = None
        for t in templates:
            if words and len(t[0]) == len(words) and t[1] == words[0] and 2 * sum(a == b for a, b in zip(t[0], words)) >= len(words):
                match = t
                break
        if match:
            match[0] = [a if a == b else "*" for a, b in zip(match[0], words)]
        elif words and sum(t[1] == words[0] and len(t[0]) == len(words) for t in templates) < 64 and len(templates) < 4096:
            templates.append([words, words[0]])
        flags.append(match is not None)
    quiet = [f and o and 0 < i < len(lines) - 1 for i, (f, o) in enumerate(zip(flags, ordinary))]
    runs, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and quiet[j]:
            j += 1
        if j - i >= 3:
            runs.append((i, j))
        i = max(j, i + 1)
    return runs


@pytest.mark.parametrize("seed", range(8))
def test_repeated_lines_equal_the_rule_spelled_out(seed):
    rng = random.Random(seed)
    text = logs(rng, rng.randint(0, 400))
    spans = K.line_spans(text.encode())
    lines = [text.encode()[a:b].decode() for a, b in spans]
    ordinary = [rng.random() < 0.9 for _ in lines]
    assert K.collapsed_runs(spans, lines, ordinary) == [(spans[i][0], spans[j - 1][1], j - i) for i, j in slow_runs(lines, ordinary)]
    assert K.collapsed_runs([(i, i + 1) for i in range(50_001)], ["a 1\n"] * 50_001, [True] * 50_001) == []


def test_shapes_give_up_what_says_least():
    trace = "KeyError: quota\n    at readQuota (/srv/app/quota.js:3:15)\n" + "".join(f"    at tick (node:internal/timers:5{i}:7)\n" for i in range(14)) + "    at main (/srv/app/main.js:8:3)\n"
    out = K.project(trace.encode(), "stack-trace/v1", 131)
    assert "KeyError" in out["visible"] and "readQuota" in out["visible"] and "at tick" not in out["visible"] and "[excerpt: 14 repeated lines omitted]" in out["visible"]
    diff = "diff --git a/m b/m\n--- a/m\n+++ b/m\n@@ -1,50 +1,50 @@\n" + "".join(f" same line {i:02}\n" for i in range(50)) + "+    total = limit()\n-    total = 0\n"
    out = K.project(diff.encode(), "unified-diff/v1", 200)
    assert all(x in out["visible"] for x in ("@@ -1,50", "+    total", "-    total")) and "same line 25" not in out["visible"] and not out["aggregates"]
    whole = '{\n  "version": 2,\n  "note": "' + "very long " * 30 + '",\n  "rows": [\n' + "".join(f'    {{ "id": "r{i:02}" }},\n' for i in range(40)) + '  ],\n  "state": "broken"\n}\n'
    out = K.project(whole.encode(), "api-json/v1", 160)
    assert '"version"' in out["visible"] and '"state"' in out["visible"] and "very long" not in out["visible"]


def test_a_focus_finds_a_buried_line_by_detection_too():
    body = lambda a, b: "".join(f"    let item_{i:03} = step(item_{i:03});\n" for i in range(a, b))
    source = ("use crate::store::Ledger;\n\npub fn settle(tries: u64) -> u64 {\n" + body(0, 180) + "    let QUOTA_LIMIT = tries.min(3);\n" + body(180, 360) + "}\n").encode()
    plain, focused = K.project(source, total=240), K.project(source, total=240, focus="where is the quota limit set")
    assert "QUOTA_LIMIT" not in plain["visible"] and "QUOTA_LIMIT = tries.min(3)" in focused["visible"] and focused["visible_count"] <= 240
    assert K.project(source, total=240, focus="zebra crossing")["visible"] == plain["visible"]
