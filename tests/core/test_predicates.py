"""Columns and Python twins agree on every line, and both with the cases they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from condensa.functions import patterns as P
from condensa.functions import text as T
from condensa.functions.predicates import Line, PyLine, ascii_lower, trim
from condensa.operators import kernel

NBSP, VT, FS = "\u00a0", "\v", "\x1c"
LINES = """error: boom|error[E0308]: mismatched|error|errors: 3|warning: unused|warning[x]: y|src/a.rs:12:5: error[E1]: bad|src/a.rs:x: error: bad|a: error: 1:2:
src/a.rs:9: warning: meh|--> src/a.rs|= help: try|= note: n|Compiling x|compiling|Finished |@@ -1,2 +1,2 @@|@@ -1|@@ |diff --git a b|--- |--- a|+++ b|index 1|+x|+|-  |- y
{|}|},|]|[1|"a": 1|"a" : 1|    "b": 2|"x|at foo (x.js:1)|at |at|File "a.py", line 3|file "a"|12: frame|12:frame|at node_modules/x|Traceback (most recent call last):|ValueError: x|a.b.Exception|error: x|Uncaught E|thread 'm' panicked at x
not ok 1|(fail) a|failures:|FAILED (1)|a ... failed|a ... ok|a ...  ok|test x failed|test failed|AssertionError: x|test result: ok|TAP version 13|running 3 tests|running test|ran 2 tests|# tests 3|1..4|1..x|ok 1 a|ok x|name: test|b ... ignored
src/main.rs:10|src/main.rs:10:5:|src/ma in.rs:1|main:1|a.b:|a.b:1:2:3|fn main() {|    pub x|     pub x|  DEF f|def f():|#!/bin/sh|async fn x|x = 1|x == 1|a b = 1|x() = 2|x+= 1|"k"=v|return|else|finish|// c|* x|@a|plain text|let x|[ERROR] a|2024 WARN: x|a b error|a b c error|(failed) x|warning error|err|panic: x
É error|ＥＲＲＯＲ|İx error|ſ error""".replace("\n", "|").split("|")
LINES += [f"{NBSP}error: x{NBSP}", f"{VT}warn x", f"{FS}error x", f"a{FS}error", f"error{NBSP}x", "", " ", "\r", "x\r", "error: x\r", f"{NBSP}{NBSP}{NBSP}fn x", "  fn x\t", "\u2028fatal x", "--- \u3000", "@@ x\n y @@", "at \n", "é" * 130, '{"' + "a" * 130]
LINES += [x + "\n" for x in LINES[:40]] + [x + "\r\n" for x in LINES[40:80]]


def columns(x: Line):
    shapes = [f"class {s}" for s in dict.fromkeys(v for v in P.PROFILES.values() if v)]
    out = {n: x.lowered(n) for n in P.LOWERED}
    out |= {"error_diagnostic": x.error_diagnostic, "warning_diagnostic": x.warning_diagnostic, "severity": x.severity, "path": x.path_header, "code": x.code, "skeleton": x.json_skeleton, "declaration": x.declaration, "opens": x.opens_section, "hunk": x.hunk_header, "header": x.diff_header, "change": x.diff_change}
    return out | {s: x.classify(F.lit(s[6:])) for s in shapes}


def values(x: PyLine):
    shapes = [f"class {s}" for s in dict.fromkeys(v for v in P.PROFILES.values() if v)]
    out = {n: x.lowered(n) for n in P.LOWERED}
    out |= {"error_diagnostic": x.diagnostic("error"), "warning_diagnostic": x.diagnostic("warning"), "severity": x.severity, "path": x.path_header, "code": x.code, "skeleton": x.json_skeleton, "declaration": x.declaration, "opens": x.opens_section, "hunk": x.rawly("hunk_header"), "header": x.rawly("diff_header"), "change": x.rawly("diff_change")}
    return out | {s: x.classify(s[6:]) for s in shapes}


def test_columns_equal_python(spark):
    rng = random.Random(0)
    made = ["".join(rng.choices(["error", "warning", ":", " ", "at ", "1", "[", "]", "=", "+", "-", "@@", "test", " ... ", "ok", "fail", "fn ", "{", '"', ".", NBSP, "\r", "x", "É"], k=rng.randint(0, 9))) for _ in range(3000)]
    rows = list(enumerate(LINES + made))
    frame = spark.createDataFrame(rows, "i long, line string")
    got = {r["i"]: r.asDict() for r in frame.select("i", *(c.alias(n) for n, c in columns(Line(F.col("line"))).items())).collect()}
    for i, line in rows:
        want = values(PyLine(line))
        assert {n: got[i][n] for n in want} == want, repr(line)


@pytest.mark.parametrize("line,name,hit", [
    ("error: x", "error_prefixed", 1), ("error[E1]: x", "error_prefixed", 1), ("errors: x", "error_prefixed", 0), ("a.b.exception", "exception_header", 1), ("some error", "exception_header", 0),
    ("a ... failed", "test_failure", 1), ("a ... ok", "test_failure", 0), ("1..12", "test_summary", 1), ("ok 1", "test_case", 1), ("compiling x", "progress", 1), ("compiling ", "progress", 0), ("x==1", "assignment", 0), ("x=", "assignment", 1),
])
def test_named_cases(line, name, hit):
    assert bool(P.python(P.LOWERED[name]).search(line)) == bool(hit)


@pytest.mark.parametrize("line,level", [("warning error", "warning"), ("[ERROR] a", "error"), ("a b c error", None), ("(failed): x", "error"), ("a warn", "warning")])
def test_severity_is_the_first_level_of_three_words(line, level):
    assert PyLine(line).severity == level


def test_folding_is_ascii_and_trimming_unicode(spark):
    r = spark.createDataFrame([("ÉAİ", "\u00a0\u2003x\t\u3000")], "a string, b string").select(ascii_lower(F.col("a")), trim(F.col("b"))).first()
    assert tuple(r) == ("ÉaİÉ"[:3], "x")


def test_text_helpers(spark):
    raw = bytes(range(256)) + b"A\n\r\t\xff"
    r = spark.createDataFrame([(bytearray(raw), bytearray(b""), "aé🙂z")], "b binary, e binary, t string").select(
        T.escape_binary(F.col("b")), T.escape_binary(F.col("e")), *(T.byte_prefix(F.col("t"), n) for n in range(9)), T.focus_terms(F.lit("Ab ab a c_d É9 x"))
    ).first()
    assert r[0] == kernel.escape_binary(raw) and r[1] == ""
    assert [r[2 + n] for n in range(9)] == ["aé🙂z".encode()[:n].decode("utf-8", "ignore") for n in range(9)]
    assert r[11] == kernel.focus_terms("Ab ab a c_d É9 x") == ["ab", "c_d", "É9"]


def test_canonical_base64(spark):
    r = spark.createDataFrame([("YQ==", "YR==", "!")], "a string, b string, c string").select(*(T.base64_canonical(F.col(c)) for c in "abc")).first()
    assert [None if x is None else bytes(x) for x in r] == [b"a", None, None]


def test_lossy_text_equals_python(spark):
    rng = random.Random(7)
    raws = [bytes(rng.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x80, 0xFF, 0xED, 0xA0, 0x0A], k=rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raws)], "i int, b binary").select("i", F.make_valid_utf8(F.col("b").cast("string")).alias("x"), T.valid_utf8(F.col("b")).alias("ok")).collect()
    for r in got:
        assert r.x == raws[r.i].decode("utf-8", "replace"), raws[r.i]
        assert r.ok == (raws[r.i].decode("utf-8", "ignore").encode() == raws[r.i])
