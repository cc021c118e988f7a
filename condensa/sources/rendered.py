"""Tool output rendered from the rows of `lineitem`: build, test, lint, trace, diff, JSON, source and log lines.

The lines are those that tools write, with numbers of the row filled in, and beside each kind the near misses that a
rule must leave alone. They exist so that every line rule meets lines that it holds for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By kind of document. {a} is the order, {b} the line number, {c} the supplier.
TEMPLATES = {
    "build-output": (
        "   Compiling c{a} v0.{b}.0", "Downloading x{a}", "Finished", "Fresh p{a}", "Generated  g{a}", "compiled{a} x", "Bundling b{a}", "   Compiling c{c} v0.{b}.0", "Building step {b}", "    Checking k{a}",
        "Installing package p{a}", "Removing old {c}", "error[E0{a}]: mismatched types", "error: bad {a}", "warning: unused w{a}", "  = note: n{a}", "plain words {a} about nothing", "Updating index {c}",
    ),
    "test-output": (
        "not ok {a} - x", "(fail) suite {a}", "failures:", "FAILED (errors={b})", "test case{a} ... FAILED", "test suite{a} failed", "AssertionError: {a}", "case {a} ... error", "case {a} ... failed now",
        "test_{a} failed", "test result: ok. {a} passed", "TAP version 13", "running {a} tests", "Ran {a} tests in {b}s", "# tests {a}", "# pass {a}", "# fail {a}", "# Subtest: {a}", "1..{a}", "1..x{a}",
        "running {a} jobs", "(pass) a{a}", "ok {a} - b", "ok then {a}", "module::t{a}: test", "test t{a} ... ok", "t{a} ... ignored", "t{a} ... skipped", "t{a} ... okay",
    ),
    "typecheck-lint": (
        "errors: {a}", "error[E{a} x", "warning[W{a}]: y", "src/f{a}.rs:{b}:5: error: z", "src/f{a}.rs:{b}: warning: y", "src/f{a}: error: n", "  --> src/f{a}.rs:{b}:1", "  = help: try {a}", "-->x{a}",
        "src/f{a}.rs:{b}", "src/f{a}.rs:{b}:{c}", "src/f{a}.rs:{b}:{c}:", "src/f {a}.rs:{b}", "src/f{a}:{b}", "a.b{a}:{b}:{c}:{b}", "a.b{a}:", "a.ts:{b}: warning: w: {c}: error", "plain words {a}",
    ),
    "stack-trace": (
        "Traceback (most recent call last):", "stack backtrace:", "Uncaught TypeError{a}: x", "thread 'main{a}' panicked at src/x.rs", "ValueError: bad {a}", "pkg.mod{a}.CustomException", "Some Error: {a}", "KeyError",
        "threads panicked at {a}", "    at load (/srv/node_modules/pkg{a}/index.js:{b}:1)", '  File "/usr/lib/python3/x{a}.py", line {b}, in f', "  {b}: core::ops at /rustc/abc{a}/library/core/src/ops.rs",
        "at <frozen importlib{a}>", "at node:internal/process:{a}", "   at app (/srv/app{a}.js:{b}:2)", "cargo at .cargo/registry/src/x{a}", "in site-packages/x{a}.py", "dist-packages{a}", "internal/x{a}", "internals {a}",
        "12: frame{a}", "{b}:nospace{a}", "at ", 'File "app{a}.py", line {b}', 'File "app{a}.py" line {b}',
    ),
    "unified-diff": (
        "diff --git a/f{a} b/f{a}", "--- a/f{a}", "+++ b/f{a}", "index {a}..{b}", "@@ -{a},1 +{b},1 @@", "@@ -{a}", "+added {a}", "-removed {b}", "+", "- ", "--- ", " context {a}", "+    more {c}", "-    less {c}", " same {b}",
    ),
    "api-json": ("{", '  "k{a}": {b},', '   "k{a}": {b}', "},", "[{a}", '"k{a}" : 1', "}x", '  "name{c}": "v{a}",', "  {", "  },", "]", '    "deep{a}": [{b}],'),
    "source-file": (
        "fn f{a}() {", "    pub fn g{a}()", "     pub fn g{a}()", "DEF h{a}():", "async fn i{a}", "#!/bin/sh {a}", "import x{a}", "\tclass C{a}:", "fnord {a}", "use u{a};", "x{a} = {b}", "x{a}={b}", "x{a} == {b}",
        "a b{a} = 1", "f{a}() = {b}", "f{a}+= {b}", 'cfg.k{a}[{b}] = "v"', '"k{a}"={b}', "f{a}()={b}", "= {a}", "k{a}: = {b}", "foo{a}(", "return x{a}", "else", "* item {a}", "@dec{a}", "    value_{c} = {b};", "    }",
    ),
    "terminal-log": (
        "[ERROR] a{a}", "2024-01-01 10:00 WARN d{a}", "a b c error {a}", "(failed) x{a}", "warning error {a}", "panic: x{a}", "errored {a}", "2024 [fatal]: {a}", "", "   ", "plain words {a} about nothing", " error: x{a} ",
        "2024-01-01 10:00:0{b} INFO request {a} took {b} ms", "2024-01-01 10:00:0{b} INFO request {c} took {b} ms", "Érror {a}",
    ),
}
KINDS = tuple(TEMPLATES)
OPENERS = {"stack-trace": "Traceback (most recent call last):\n", "unified-diff": "diff --git a/x b/x\n@@ -1 +1 @@\n", "api-json": "[\n", "source-file": "#!/bin/sh\n"}
#: Ends of single lines, in turn.
ENDS = ("", "\n", "\r\n", "")
ALL = tuple(t for kind in KINDS for t in TEMPLATES[kind])


def _filled(template: Column) -> Column:
    for mark, column in (("{a}", "l_orderkey"), ("{b}", "l_linenumber"), ("{c}", "l_suppkey")):
        template = F.replace(template, F.lit(mark), F.col(column).cast("string"))
    return template


def _pick(items: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))


def lines(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber, line): one line a row, all templates in turn."""
    at = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")
    return lineitem.select("l_orderkey", "l_linenumber", F.concat(_filled(_pick(ALL, at)), _pick(ENDS, F.col("l_suppkey"))).alias("line"))


def documents(lineitem: DataFrame) -> DataFrame:
    """(doc_id, text): a document a supplier and kind, of the lines of its kind in order of order and line number."""
    kind, at = F.col("l_orderkey") % len(KINDS), F.col("l_partkey") + F.col("l_linenumber")
    line = F.lit(None).cast("string")
    for k, name in enumerate(KINDS):
        line = F.when(kind == k, _pick(TEMPLATES[name], at)).otherwise(line)
    rows = lineitem.select((F.col("l_suppkey") * len(KINDS) + kind).alias("doc_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", _filled(line).alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(r["line"], F.lit("\n"))), "")
    opener = F.lit("")
    for k, name in enumerate(KINDS):
        if name in OPENERS:
            opener = F.when(F.col("doc_id") % len(KINDS) == k, OPENERS[name]).otherwise(opener)
    return rows.groupBy("doc_id").agg(body.alias("text")).select("doc_id", F.concat(opener, "text").alias("text"))


# ---------------------------------------------------------------- the same in SQL

def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_lit, items)) + "]"


_FILL = "replace(replace(replace({0}, '{{a}}', l_orderkey::varchar), '{{b}}', l_linenumber::varchar), '{{c}}', l_suppkey::varchar)"
LINES_SQL = f"""(select l_orderkey, l_linenumber, {_FILL.format(f"{_list(ALL)}[((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(ALL)} + 1)::bigint]")}
    || ['', chr(10), chr(13) || chr(10), ''][(l_suppkey % 4 + 1)::bigint] line from lineitem)"""
_CASES = " ".join(f"when {k} then {_list(TEMPLATES[name])}[((l_partkey + l_linenumber) % {len(TEMPLATES[name])} + 1)::bigint]" for k, name in enumerate(KINDS))
_OPEN = " ".join(f"when {k} then {' || chr(10) || '.join(map(_lit, OPENERS[name].split(chr(10))))}" for k, name in enumerate(KINDS) if name in OPENERS)
DOCUMENTS_SQL = f"""(select l_suppkey * 8 + l_orderkey % 8 doc_id, case l_suppkey * 0 + any_value(l_orderkey % 8) {_OPEN} else '' end
    || string_agg({_FILL.format(f"(case l_orderkey % 8 {_CASES} end)")} || chr(10), '' order by l_orderkey, l_linenumber, l_partkey) as text from lineitem group by l_suppkey, l_orderkey % 8)"""
