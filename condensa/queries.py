"""Registered queries over the synthetic tables, one or more per operator, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as T
from .functions.predicates import Line, PyLine  # noqa: F401
from .operators import evaluation, focus, kernel, lines, projection, retrieval, scans, shape, spans, store
from .plans import acquisition, requests
from .sources import files, rendered
from .registry import ORACLES, QUERIES, query, table  # noqa: F401
from .streaming import intent

NOW = 1_000_000
LIMIT = 1024
FOCUS = "Which license and contact does the theanha of inerthe ourethe mention in the erthe"
PATTERN = "the"


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def logs(spark, sf_dir) -> DataFrame:
    return files.event_logs(table(spark, sf_dir, "events")).withColumnRenamed("user_id", "doc_id")


def diffs(spark, sf_dir) -> DataFrame:
    return files.event_diffs(table(spark, sf_dir, "events")).withColumnRenamed("user_id", "doc_id")


# ---------------------------------------------------------------- SQL pieces

def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


TRIMMED = f"regexp_replace(line, {lit(P.TRIM)}, '', 'g')"
TEXT = f"translate({TRIMMED}, '{P.UPPER}', '{P.LOWER}')"
RAW = r"regexp_replace(line, '[\r\n]+\z', '')"
LOGS = """(select user_id doc_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end
           || '] ' || event_type || ' event ' || event_id || chr(10), '' order by ts, event_id) as text from events group by user_id)"""
DIFFS = """(select user_id doc_id, string_agg(case event_type when 'error' then 'diff --git a/' || event_id || ' b/' || event_id when 'view' then '@@ -' || event_id || ',1 +' || event_id || ',1 @@'
            when 'click' then '+event ' || event_id when 'signup' then '-event ' || event_id else ' event ' || event_id end || chr(10), '' order by ts, event_id) as text from events group by user_id)"""


def lines_of(source: str) -> str:
    return rf"""cut as (select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') l from {source}),
        flat as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 line_no from cut),
        lines as (select *, (sum(strlen(line)) over (partition by doc_id order by line_no))::bigint "end", ((sum(strlen(line)) over (partition by doc_id order by line_no)) - strlen(line))::bigint start from flat)"""


def formed(source: str) -> str:
    return f"{lines_of(source)}, formed as (select *, {TRIMMED} trimmed, {TEXT} t, {RAW} raw from lines)"


def low(name: str) -> str:
    return has("t", P.LOWERED[name])


def raw(name: str) -> str:
    return has("raw", P.RAW[name])


def diagnostic(word: str) -> str:
    return f"({low(word + '_prefixed')} or (contains(t, ': {word}') and {has(f'''split_part(t, ': {word}', 1) || ':' ''', P.PLACED)}))"


def in_list(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


SEVERITY = f"""list_filter(list_transform(regexp_split_to_array(t, {lit(f'[{P.WS}]+')})[1:3], lambda w: case when regexp_replace(w, '^[\\[\\]:()]+|[\\[\\]:()]+\\z', '', 'g') in {in_list(P.SEVERITY_ERROR)} then 'error'
    when regexp_replace(w, '^[\\[\\]:()]+|[\\[\\]:()]+\\z', '', 'g') in {in_list(P.SEVERITY_WARNING)} then 'warning' end), lambda x: x is not null)[1]"""
INDENTED = f"regexp_replace(raw, {lit(P.TRIM_START)}, '')"
SKELETON = f"(strlen(raw) - strlen({INDENTED}) <= 2 and strlen({INDENTED}) <= 120 and {low('json_structural')})"
DECLARED = f"(strlen(raw) - strlen({INDENTED}) <= 4 and {has(f'translate({INDENTED}, {lit(P.UPPER)}, {lit(P.LOWER)})', P.DECLARATION)})"
CODE = f"({has('trimmed', P.TRIMMED['code_end'])} or {low('assignment')} or {low('code_keyword')})"
PATH = has("trimmed", P.TRIMMED["path_header"])
OPENS = f"({raw('hunk_header')} or starts_with(raw, 'diff --git '))"


def class_sql(kind: str) -> str:
    lint = f"case when {diagnostic('error')} or {SEVERITY} = 'error' then 2 when {diagnostic('warning')} or {low('diagnostic_detail')} or {SEVERITY} = 'warning' then 1 else 0 end"
    return {
        "build-output": lint, "typecheck-lint": lint,
        "test-output": f"case when {low('test_failure')} then 2 when {low('test_summary')} then 1 else 0 end",
        "stack-trace": f"case when {low('exception_header')} then 2 when {low('frame')} and not {low('library_path')} then 1 else 0 end",
        "unified-diff": f"case when {raw('diff_header')} or {raw('hunk_header')} or {raw('diff_change')} then 1 else 0 end",
        "api-json": f"case when {SKELETON} then 1 else 0 end", "source-file": f"case when {DECLARED} then 1 else 0 end",
        "terminal-log": f"case when {SEVERITY} is not null then 1 else 0 end",
    }[kind]


SHAPES = ("build-output", "test-output", "typecheck-lint", "stack-trace", "unified-diff", "api-json", "source-file", "terminal-log")


# ---------------------------------------------------------------- lines

@query(f'with {lines_of("documents")} select doc_id, line_no::int line_no, start, "end" from lines')
def line_spans(spark, sf_dir):
    return lines.lines(documents(spark, sf_dir)).select("doc_id", "line_no", "start", "end")


@query(f'with {lines_of("documents")} select doc_id, count(*) n_lines, max("end") n_bytes from lines group by doc_id')
def line_count(spark, sf_dir):
    return lines.lines(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("end").alias("n_bytes"))


@query(f'with {lines_of("documents")} select doc_id, arg_min(start, line_no) first_start, arg_min("end", line_no) first_end, arg_max(start, line_no) last_start, arg_max("end", line_no) last_end from lines group by doc_id')
def last_first_lines(spark, sf_dir):
    return lines.first_last(lines.lines(documents(spark, sf_dir)))


@query(f"with {formed(LOGS)}, told as (select doc_id, line_no::int line_no, {SEVERITY} severity from formed) select * from told where severity is not null")
def severity_lines(spark, sf_dir):
    x = Line(F.col("line"))
    return lines.lines(logs(spark, sf_dir)).select("doc_id", "line_no", x.severity.alias("severity")).where("severity is not null")


@query(f"with formed as (select event_id, props line, {TRIMMED.replace('line', 'props')} trimmed, {TEXT.replace('line', 'props')} t, {RAW.replace('line', 'props')} raw from events) select event_id from formed where {SKELETON}")
def json_skeleton_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").where(Line(F.col("props")).json_skeleton).select("event_id")


def _flagged(flag: str, expression: str) -> str:
    pages = "(select page_id doc_id, html as text from pages)"
    return f"""with a as (with {formed('documents')} select 'document' kind, doc_id, line_no, {expression} f from formed), b as (with {formed(pages)} select 'page' kind, doc_id, line_no, {expression} f from formed)
        , c as (with {formed(rendered.DOCUMENTS_SQL)} select 'tool' kind, doc_id, line_no, {expression} f from formed)
        select kind, doc_id, line_no::int line_no from (select * from a union all select * from b union all select * from c) where f"""


def _both(spark, sf_dir, flag) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    tools = rendered.documents(table(spark, sf_dir, "lineitem"))
    every = documents(spark, sf_dir).withColumn("kind", F.lit("document")).union(pages.withColumn("kind", F.lit("page"))).union(tools.withColumn("kind", F.lit("tool")))
    rows = every.select("kind", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(P.LINE), F.lit(0))).alias("line_no", "line"))  # no offsets, no shuffle
    return rows.where(flag(Line(F.col("line")))).select("kind", "doc_id", "line_no")


@query(_flagged("code", CODE))
def code_lines(spark, sf_dir):
    return _both(spark, sf_dir, lambda x: x.code)


@query(_flagged("declaration", DECLARED))
def declaration_lines(spark, sf_dir):
    return _both(spark, sf_dir, lambda x: x.declaration)


@query(_flagged("path", PATH))
def path_header_lines(spark, sf_dir):
    return _both(spark, sf_dir, lambda x: x.path_header)


_KINDS = f"(select doc_id * 10 doc_id, text from documents union all select doc_id * 10 + 1, text from {LOGS} union all select doc_id * 10 + 2, text from {DIFFS})"


def _kinds(spark, sf_dir) -> DataFrame:
    out = documents(spark, sf_dir).select((F.col("doc_id") * 10).alias("doc_id"), "text")
    for k, more in enumerate((logs, diffs), 1):
        out = out.union(more(spark, sf_dir).select((F.col("doc_id") * 10 + k).alias("doc_id"), "text"))
    return out


@query(f"with {formed(_KINDS)}, told as (" + " union all ".join(f"select doc_id, '{s}' shape, {class_sql(s)} class from formed" for s in SHAPES) + ") select doc_id, shape, class::int class, count(*) n from told group by 1, 2, 3")
def line_classes(spark, sf_dir):
    """Every rule once a line; a row a document and its counters meet in the shuffle, not lines."""
    each = scans.spread(_kinds(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.LINE), F.lit(0))).alias("line"))
    x = Line(F.col("line"))
    each = each.select("doc_id", "line", x.raw.alias("raw"), x.trimmed.alias("trimmed"), x.text.alias("text"))
    x.raw, x.trimmed, x.text = F.col("raw"), F.col("trimmed"), F.col("text")
    each = each.select("*", x.loud.alias("loud"), x.severity.alias("severe"))
    classes = x.classes(F.col("loud"), F.col("severe"))
    each = each.select("doc_id", *(classes[k].alias(k) for k in SHAPES if k != "typecheck-lint"))
    kinds = [(k, c) for k in SHAPES for c in (0, 1, 2)]
    of = lambda k: "build-output" if k == "typecheck-lint" else k
    counted = each.groupBy("doc_id").agg(*(F.count_if(F.col(f"`{of(k)}`") == c).alias(f"n{i}") for i, (k, c) in enumerate(kinds)))
    told = F.array(*(F.struct(F.lit(k).alias("shape"), F.lit(c).alias("class"), F.col(f"n{i}").alias("n")) for i, (k, c) in enumerate(kinds)))
    return counted.select("doc_id", F.explode(F.filter(told, lambda t: t["n"] > 0)).alias("t")).select("doc_id", "t.*")


# ---------------------------------------------------------------- shape

_COUNTS = {
    "lines": "true", "json_structural": low("json_structural"), "hunk_headers": raw("hunk_header"), "diff_headers": raw("diff_header"), "diff_changes": f"{raw('diff_change')} and not {raw('diff_header')}",
    "frames": low("frame"), "project_frames": f"{low('frame')} and not {low('library_path')}", "exceptions": low("exception_header"), "tests": f"({low('test_failure')} or {low('test_summary')} or {low('test_case')})",
    "diagnostics": f"({diagnostic('error')} or {diagnostic('warning')} or {low('diagnostic_detail')})", "errors": diagnostic("error"), "path_headers": PATH, "progress": low("progress"), "code": CODE,
}
_FEATURES = rf"""cut as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+')[1:512] l from {_KINDS} where text is not null),
    flat as (select doc_id, regexp_replace(unnest(l), '\r?\n\z', '') line from cut), formed as (select *, {TRIMMED} trimmed, {TEXT} t, line raw from flat),
    counts as (select doc_id, {", ".join(f"count(*) filter (where trimmed <> '' and {e}) {n}" for n, e in _COUNTS.items())} from formed group by doc_id),
    features as (select doc_id, {has(f"regexp_replace(text, {lit(P.TRIM_START)}, '')", r'^[{\[]')} opens_json, starts_with(text, '#!') shebang, {", ".join(f"coalesce({n}, 0) {n}" for n in _COUNTS)} from cut left join counts using (doc_id))"""


@query(f"with {_FEATURES} select * from features")
def shape_features(spark, sf_dir):
    return shape.features(_kinds(spark, sf_dir))


@query(f"""with {_FEATURES} select doc_id, case when opens_json and json_structural * 5 >= n * 3 then 'api-json' when hunk_headers >= 1 and diff_headers >= 1 then 'unified-diff'
    when frames >= 2 and exceptions >= 1 and tests < 2 and (frames >= 3 or project_frames >= 1) then 'stack-trace' when tests >= 2 or (tests >= 1 and tests * 4 >= n) then 'test-output'
    when (diagnostics >= 1 or path_headers >= 1) and progress >= 1 and errors >= 1 then 'build-output' when diagnostics >= 1 or path_headers >= 1 then 'typecheck-lint'
    when hunk_headers = 0 and diff_changes * 2 >= n then 'typecheck-lint' when progress * 3 >= n then 'build-output' when shebang or code * 5 >= n * 2 then 'source-file' else 'terminal-log' end shape
    from (select *, greatest(lines, 1) n from features)""")
def detect_shape(spark, sf_dir):
    return shape.detect(_kinds(spark, sf_dir))


_PROFILES_SQL = "(values " + ", ".join(f"({i}, {lit(k)}, {lit(v) if v else 'null'}, {lit(v + '/v1') if v else 'null'})" for i, (k, v) in enumerate(P.PROFILES.items())) + ") t(i, profile, shape, applied_profile)"


@query(f"select profile, shape, applied_profile, count(o_orderkey) requests from {_PROFILES_SQL} left join orders on o_custkey % {len(P.PROFILES)} = i group by 1, 2, 3")
def policies(spark, sf_dir):
    """The policy table with what orders ask of each profile, in turn of their customers."""
    known = F.array(*map(F.lit, P.PROFILES))
    asked = _orders(spark, sf_dir).select(F.element_at(known, (F.col("o_custkey") % len(P.PROFILES) + 1).cast("int")).alias("profile")).groupBy("profile").agg(F.count("*").alias("requests"))
    return projection.policies(spark).join(asked, "profile", "left").fillna(0, ["requests"])


# ---------------------------------------------------------------- focus, candidates

_TERMS = kernel.focus_terms(FOCUS)
_TERM_ROWS = ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(_TERMS))
_HITS = f"""{lines_of('documents')}, terms(i, term) as (values {_TERM_ROWS}),
    low as (select doc_id, line_no, translate(line, '{P.UPPER}', '{P.LOWER}') t from lines),
    hits as (select doc_id, i, term, count(*) filter (where contains(t, term)) hits, count(*) lines from low, terms group by 1, 2, 3)"""


@query(f"with {_HITS} select doc_id, term, hits, lines from hits")
def focus_term_hits(spark, sf_dir):
    return focus.term_hits(documents(spark, sf_dir), FOCUS)


@query(f"with {_HITS} select doc_id, sum(case when hits > 0 and hits * 4 <= lines then 1 << i else 0 end)::bigint telling from hits group by doc_id")
def focus_discriminating(spark, sf_dir):
    return focus.telling(documents(spark, sf_dir), FOCUS)


@query(f"""with {_HITS}, told as (select doc_id, term from hits where hits > 0 and hits * 4 <= lines)
    select doc_id, line_no::int line_no, count(*) score from low join told using (doc_id) where contains(t, term) group by 1, 2""")
def focus_rank(spark, sf_dir):
    return focus.scored(documents(spark, sf_dir), FOCUS).where("score > 0").select("doc_id", "line_no", "score")


@query(f"""with {formed(LOGS)}, told as (select doc_id, line_no, {SEVERITY} is not null p, contains(t, 'click') m from formed),
    capped as (select *, sum(p::int) over w np, sum(m::int) over w nm from told window w as (partition by doc_id order by line_no))
    select doc_id, line_no::int line_no, (p and np <= 8) by_kind, (m and nm <= 8) by_focus from capped where (p and np <= 8) or (m and nm <= 8)""")
def candidate_caps(spark, sf_dir):
    x = Line(F.col("line"))
    return lines.admitted(lines.lines(logs(spark, sf_dir)), x.severity.isNotNull(), x.text.contains("click"), most=8).select("doc_id", "line_no", "by_kind", "by_focus")


@query(f"""with {formed(DIFFS)}, told as (select doc_id, line_no, {OPENS} opens from formed), ranked as (select *, sum(opens::int) over (partition by doc_id order by line_no) section from told)
    select doc_id, line_no::int line_no, section::bigint section, row_number() over (partition by doc_id, section order by line_no) - (section > 0)::int rank from ranked""")
def section_rank(spark, sf_dir):
    return lines.section_ranks(lines.lines(diffs(spark, sf_dir))).select("doc_id", "line_no", "section", "rank")


@query(f"""with {formed(DIFFS)}, n as (select doc_id, count(*) filter (where {OPENS}) sections from formed group by doc_id)
    select doc_id, sections, greatest(256 // greatest(sections, 1), 1)::bigint depth from n""")
def section_counts(spark, sf_dir):
    counted = lines.lines(diffs(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(Line(F.col("line")).opens_section).alias("sections"))
    return counted.select("doc_id", "sections", T.section_depth(F.col("sections")).alias("depth"))


@query(f"""with {lines_of(LOGS)}, keyed as (select array_to_string(list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\n\\f\\r]+'), lambda w: w <> '')[1:32], lambda w: case when regexp_matches(w, '[0-9]') then '*' else w end), ' ') template from lines)
    select template, count(*) n from keyed group by 1""")
def template_keys(spark, sf_dir):
    return lines.lines(logs(spark, sf_dir)).select(F.array_join(T.template_key(F.col("line")), " ").alias("template")).groupBy("template").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- retrieval and spans

@query(f'with {lines_of("documents")} select doc_id, min(start) start, max("end") "end" from lines where line_no between 2 and 5 group by doc_id')
def select_lines(spark, sf_dir):
    return retrieval.by_lines(lines.lines(documents(spark, sf_dir)), 3, 4)


_ISLANDS = """fresh as (select *, coalesce((start > max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding))::int, 0) f from {0}),
    islands as (select *, sum(f) over (partition by doc_id order by start, "end" rows unbounded preceding) k from fresh),
    merged as (select doc_id, min(start) start, max("end") "end" from islands group by doc_id, k)"""


@query(f"""with {lines_of('documents')}, seen as (select *, (len(line) - len(replace(line, '{PATTERN}', ''))) // {len(PATTERN)} hits from lines),
    capped as (select *, hits > 0 and sum(hits) over (partition by doc_id order by line_no) - hits < 8 hit from seen),
    near as (select distinct a.doc_id, a.line_no, a.start, a."end" from capped a join capped b on a.doc_id = b.doc_id and a.line_no between b.line_no - 1 and b.line_no + 2 where b.hit),
    {_ISLANDS.format('near')} select * from merged""")
def select_pattern(spark, sf_dir):
    return retrieval.by_text(documents(spark, sf_dir), PATTERN, 1, 2, 8)


ACROSS = ".\nT"


@query(f"""with {lines_of('documents')}, pieces_ as (select doc_id, list_transform(string_split(text, '.' || chr(10) || 'T'), lambda x: strlen(x)) z, strlen(text) size from documents),
    hits as (select doc_id, size, k, list_sum(z[1:k]) + (k - 1) * 3 place from pieces_, range(1, 9) t(k) where k < len(z)),
    numbered as (select doc_id, list(start order by line_no) starts from lines group by doc_id),
    placed as (select doc_id, size, starts, len(list_filter(starts, lambda x: x <= place)) - 1 low, len(list_filter(starts, lambda x: x < place + 3)) high from hits join numbered using (doc_id)),
    near as (select doc_id, starts[greatest(low - 1, 0)::bigint + 1] start, coalesce(starts[high + 2 + 1], size) "end" from placed),
    {_ISLANDS.format('near')} select doc_id, start::bigint start, "end"::bigint "end" from merged""")
def select_across_lines(spark, sf_dir):
    """A literal that ends one line and begins the next, with a line before and two after."""
    return retrieval.by_text(documents(spark, sf_dir), ACROSS, 1, 2, 8)


@query(ORACLES["select_pattern"])
def select_pattern_lines(spark, sf_dir):
    """The same rule over a table of lines, by windows."""
    return retrieval.by_pattern(lines.lines(documents(spark, sf_dir)), PATTERN, 1, 2, 8)


def _some(spark, sf_dir) -> DataFrame:
    return lines.lines(documents(spark, sf_dir)).where("line_no % 3 <> 2").select("doc_id", "start", "end")


_SOME = f'{lines_of("documents")}, picks as (select doc_id, start, "end" from lines where line_no % 3 <> 2), sizes as (select doc_id, strlen(text) size from documents where text is not null)'


def _sizes(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("size"))


@query(f"with {_SOME}, {_ISLANDS.format('picks')} select * from merged")
def merge_spans(spark, sf_dir):
    return spans.merge(_some(spark, sf_dir))


@query(f"""with {_SOME}, every as (select * from picks union all select doc_id, size, size from sizes),
    gaps as (select doc_id, coalesce(lag("end") over (partition by doc_id order by start, "end"), 0) s, start e from every) select doc_id, s::bigint start, e::bigint "end" from gaps where s < e""")
def complement_spans(spark, sf_dir):
    return spans.complement(spans.merge(_some(spark, sf_dir)), _sizes(spark, sf_dir))


@query(f"with {lines_of('documents')}, n as (select doc_id, count(*) n from lines group by 1) select doc_id, doc_id % 2 = 0 or coalesce(n, 0) < 3 gapless from documents left join n using (doc_id) where text is not null")
def partition_check(spark, sf_dir):
    """Spans and their complement cover each even document; odd ones lack the complement, which documents of three lines have."""
    kept = spans.merge(_some(spark, sf_dir))
    left = spans.complement(kept, _sizes(spark, sf_dir)).where("doc_id % 2 = 0")
    return spans.is_partition(kept.union(left.select(*kept.columns)), _sizes(spark, sf_dir))


@query(f"""with {_SOME}, {_ISLANDS.format('picks')}, laid as (select *, coalesce(sum("end" - start) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) "at" from merged),
    pieces as (select doc_id, start + greatest(100 - "at", 0) start, start + least(900 - "at", "end" - start) "end" from laid where "at" < 900 and "at" + "end" - start > 100),
    {_ISLANDS.format('pieces').replace('fresh', 'fresh2').replace('islands', 'islands2').replace('merged', 'merged2')} select doc_id, start::bigint start, "end"::bigint "end" from merged2""")
def translate_spans(spark, sf_dir):
    regions = spans.merge(_some(spark, sf_dir))
    wanted = _sizes(spark, sf_dir).select("doc_id", F.lit(100).cast("long").alias("start"), F.lit(900).cast("long").alias("end"))
    return spans.translate(regions, wanted)


# ---------------------------------------------------------------- projection

@query(f"select doc_id, 'exact' fidelity, strlen(text) original_count, strlen(text) visible_count, text visible from documents where strlen(text) <= {LIMIT}")
def exact_projection(spark, sf_dir):
    return projection.exact(documents(spark, sf_dir), LIMIT)


_FITS = "(select max(k) from range(0, {0} + 1) t(k) where strlen(left(text, k)) <= {0})"


@query(f"""with over as (select doc_id, text, left(text, {_FITS.format(256)}) visible from documents where strlen(text) > 256 and (not contains(text, chr(10)) or instr(text, chr(10)) = len(text)))
    select doc_id, 'extractive' fidelity, strlen(text) original_count, strlen(visible) visible_count, visible from over""")
def prefix_projection(spark, sf_dir):
    return projection.prefix(documents(spark, sf_dir), 256)


@query("select doc_id, case when strlen(text) <= 512 then 'exact' when strlen(text) <= 10485760 then 'over' else 'input_too_large' end status, least(10000, floor(strlen(text) * 10000 / 512))::bigint used from documents where text is not null")
def budget_status(spark, sf_dir):
    size = F.octet_length("text")
    status = F.when(size <= 512, "exact").when(size <= 10 * 1024 * 1024, "over").otherwise("input_too_large")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", status.alias("status"), F.least(T.basis_points(size, F.lit(512)), F.lit(10000)).cast("long").alias("used"))


def _projected(name, **options):
    def run(spark, sf_dir):
        return projection.project(_kinds(spark, sf_dir), **options)

    run.__name__ = name
    return query()(run)


project_bytes = _projected("project_bytes", profile="terminal-log/v1", total=LIMIT)
project_auto = _projected("project_auto", total=4096, reserved=400)
project_focus = _projected("project_focus", total=2048, focus=FOCUS)
project_selection = _projected("project_selection", total=2048, selector={"pattern": (PATTERN, 1, 2, 8)})


@query(f"""with {formed(LOGS)}, told as (select doc_id, line_no, start, "end", {SEVERITY} is null and line_no > 0 and line_no < max(line_no) over (partition by doc_id) quiet from formed),
    islands as (select *, line_no - row_number() over (partition by doc_id order by line_no) k from told where quiet)
    select doc_id, min(start) start, max("end") "end", count(*) lines from islands group by doc_id, k having count(*) >= 3""")
def repeated_runs(spark, sf_dir):
    """All log lines are of one template (date, time and number are masked), so ordinary ones between others are runs."""
    return projection.repeated_runs(logs(spark, sf_dir), "terminal-log")


@query()
def template_runs(spark, sf_dir):
    out = projection.project(logs(spark, sf_dir), profile="terminal-log/v1", total=2048)
    return out.select("doc_id", F.explode("aggregates").alias("r")).select("doc_id", "r.*")


@query(r"""with d as (select doc_id, encode(text) b from documents where text is not null),
    h as (select doc_id, list_transform(range(0, octet_length(b)), lambda i: hex(b)[2 * i + 1 : 2 * i + 2]) x from d)
    select doc_id, array_to_string(list_transform(x, lambda y: case when y = '0A' then chr(10) when y = '0D' then '\r' when y = '09' then '\t' when y >= '20' and y <= '7E' then chr(('0x' || y)::int) else '\x' || lower(y) end), '') escaped from h""")
def binary_escape(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.escape_binary(F.col("text").cast("binary")).alias("escaped"))


@query(f"select doc_id, true whole, coalesce(strlen(left(text, {_FITS.format(100)})) = least(100, strlen(text)), false) cut, false odd from documents where text is not null")
def utf8_validity(spark, sf_dir):
    raw = F.col("text").cast("binary")
    odd = F.concat(raw, F.unhex(F.element_at(F.array(*map(F.lit, ("FF", "C328", "E28241", "F0908041", "EDA080", "C0AF", "F8888080", "80"))), (F.col("doc_id") % 8 + 1).cast("int"))))
    return documents(spark, sf_dir).where("text is not null").select("doc_id", T.valid_utf8(raw).alias("whole"), T.valid_utf8(F.substring(raw, 1, 100)).alias("cut"), T.valid_utf8(odd).alias("odd"))


# ---------------------------------------------------------------- store

def _artifacts(spark, sf_dir) -> DataFrame:
    return store.digested(documents(spark, sf_dir)).select("doc_id", "id", "source_sha256", "source_bytes", (F.lit(NOW) - 400_000 + F.col("doc_id") * 777 % 800_000).cast("long").alias("expires_at"))


_ARTIFACTS = f"""artifacts as (select doc_id, substr(sha256(doc_id::varchar || ':' || sha256(text)), 1, 32) id, sha256(text) source_sha256, strlen(text) source_bytes,
    ({NOW} - 400000 + doc_id * 777 % 800000)::bigint expires_at from documents where text is not null)"""


def _receipts(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("artifact_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id"), "event_id", F.col("props").alias("receipt")).withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))


_RECEIPTS = "receipts as (select user_id artifact_id, event_id, props receipt, row_number() over (partition by user_id order by event_id) - 1 sequence from events)"


@query(f"with {_ARTIFACTS} select doc_id, id, source_sha256, source_bytes from artifacts")
def artifact_commit_digest(spark, sf_dir):
    return store.digested(documents(spark, sf_dir))


@query(f"""with {_ARTIFACTS} select count(*) artifacts, coalesce(sum(source_bytes), 0)::bigint source_bytes, count(*) filter (where expires_at <= {NOW}) expired,
    coalesce(sum(source_bytes) filter (where expires_at <= {NOW}), 0)::bigint expired_bytes from artifacts""")
def store_status(spark, sf_dir):
    return store.status(_artifacts(spark, sf_dir), NOW)


@query(f"with {_ARTIFACTS} select id, expires_at <= {NOW} expired, case when expires_at <= {NOW} then {NOW + store.TOMBSTONE_SECONDS} else 0 end::bigint purge_at from artifacts")
def gc_split(spark, sf_dir):
    return store.split_expired(_artifacts(spark, sf_dir), NOW).select("id", "expired", F.coalesce("purge_at", F.lit(0)).alias("purge_at"))


@query(f"""with {_ARTIFACTS}, old as (select id, expires_at expired_at, expires_at + 90000 purge_at from artifacts where doc_id % 2 = 0), fresh as (select id, expires_at expired_at, {NOW + store.TOMBSTONE_SECONDS}::bigint purge_at from artifacts where expires_at <= {NOW})
    select * from fresh union all select * from old where purge_at > {NOW} and id not in (select id from fresh)""")
def tombstone_upsert(spark, sf_dir):
    artifacts = _artifacts(spark, sf_dir)
    old = artifacts.where("doc_id % 2 = 0").select("id", F.col("expires_at").alias("expired_at"), (F.col("expires_at") + 90000).alias("purge_at"))
    return store.upsert_tombstones(old, artifacts, NOW)


@query(f"""with {_ARTIFACTS} select id, case when doc_id % 3 = 1 then case when expires_at > {NOW} then 'live' else 'expired' end when doc_id % 3 = 2 then case when expires_at + 90000 > {NOW} then 'expired' else 'unknown' end else 'unknown' end found from artifacts""")
def artifact_lookup(spark, sf_dir):
    artifacts = _artifacts(spark, sf_dir)
    dead = artifacts.where("doc_id % 3 = 2").select("id", (F.col("expires_at") + 90000).alias("purge_at"))
    return store.lookup(artifacts.select("id"), artifacts.where("doc_id % 3 = 1"), dead, NOW)


@query(f"""with {_RECEIPTS} select artifact_id, count(*) receipts, sum(strlen(receipt))::bigint bytes, min(sequence) low, max(sequence) high, count(distinct sequence) "distinct",
    min(sequence) = 0 and max(sequence) = count(*) - 1 and count(distinct sequence) = count(*) dense from receipts group by 1""")
def lineage_shape(spark, sf_dir):
    return store.lineage_shape(_receipts(spark, sf_dir))


@query(f"with {_RECEIPTS} select artifact_id, sum(strlen(receipt))::bigint bytes from receipts group by 1 having sum(strlen(receipt)) > 600")
def oversized_lineage(spark, sf_dir):
    return store.oversized(_receipts(spark, sf_dir), 600)


_LIVES = f"lives as (select distinct user_id id, ({NOW} - 100 + user_id)::bigint expires_at from events)"


def _lives(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.lit(NOW) - 100 + F.col("user_id")).cast("long").alias("expires_at")).distinct()


@query(f"with {_RECEIPTS}, {_LIVES} select count(*) receipts, coalesce(sum(strlen(receipt)), 0)::bigint bytes from receipts where artifact_id in (select id from lives where expires_at <= {NOW})")
def expired_lineage_bytes(spark, sf_dir):
    return store.expired_lineage(_receipts(spark, sf_dir), _lives(spark, sf_dir), NOW)


@query(f"with {_RECEIPTS}, {_LIVES} select artifact_id, event_id, receipt, sequence from receipts where artifact_id in (select id from lives where expires_at > {NOW})")
def receipt_cascade(spark, sf_dir):
    return store.survivors(_receipts(spark, sf_dir), _lives(spark, sf_dir), NOW).select("artifact_id", "event_id", "receipt", "sequence")


@query(f"with {_RECEIPTS} select artifact_id, max(sequence) sequence, arg_max(receipt, sequence) receipt from receipts group by 1")
def latest_receipt(spark, sf_dir):
    return store.latest(_receipts(spark, sf_dir))


# ---------------------------------------------------------------- requests

def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(f"""select o_orderkey, coalesce(e2, -1) expires_at from (select o_orderkey, case when e is not null and t is not null then null when e is not null then case when e > {NOW} then e end when t is not null then case when t > 0 then {NOW} + t end else {NOW} + 604800 end::bigint e2
    from (select o_orderkey, case when o_orderkey % 3 = 0 then {NOW} - 50 + o_custkey end e, case when o_orderkey % 5 = 0 then o_custkey - 20 end t from orders))""")
def retention_resolve(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _orders(spark, sf_dir).select("o_orderkey", F.coalesce(store.expiry(F.lit(NOW), F.when(k % 3 == 0, F.lit(NOW) - 50 + c), F.when(k % 5 == 0, c - 20)), F.lit(-1)).alias("expires_at"))


@query("""with told as (select conv_id, turn, role, turn * 10000 + conv_id % 7 ts, case when role = 'user' then text end prompt from conversations)
    select a.conv_id, a.turn, (select left(trim(b.prompt, ' ' || chr(10)), (select max(k) from range(0, 257) t(k) where strlen(left(trim(b.prompt, ' ' || chr(10)), k)) <= 256)) from told b
        where b.conv_id = a.conv_id and b.prompt is not null and trim(b.prompt, ' ' || chr(10)) <> '' and b.ts between a.ts - 43200 and a.ts order by b.ts desc limit 1) intent from told a""")
def session_intent_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("ts", (F.col("turn") * 10000 + F.col("conv_id") % 7).cast("long"))
    return intent.as_of(rows, "conv_id", "ts", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "intent")


@query(ORACLES["session_intent_asof"])
def session_intent_sliced(spark, sf_dir):
    """The same lookup with each session split by time."""
    rows = table(spark, sf_dir, "conversations").withColumn("ts", (F.col("turn") * 10000 + F.col("conv_id") % 7).cast("long"))
    return intent.as_of_sliced(rows, "conv_id", "ts", F.when(F.col("role") == "user", F.col("text"))).select("conv_id", "turn", "intent")


@query("""select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then concat_ws(' ', event_type, user_id::varchar) end focus from events""")
def derived_focus(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3
    payload = (
        F.when(third == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(third == 1, F.to_json(F.struct(F.col("event_type").alias("command"), F.col("user_id").cast("string").alias("query"), F.col("props").alias("noise"))))
        .otherwise(F.to_json(F.struct(F.col("props").alias("noise"))))
    )
    return e.select("event_id", requests.derived_focus(payload).alias("focus"))


@query("select doc_id, doc_id % 4 <> 3 or strlen(text) = 0 covered from documents where text is not null")
def stream_event_check(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    chunks = F.filter(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / 512)), lambda k: k >= 0)
    wrong = F.when(F.col("doc_id") % 4 == 3, 1).otherwise(0)  # every fourth claims a gap
    events = F.transform(chunks, lambda k: F.struct(k.alias("order"), F.when(k % 2 == 0, "stdout").otherwise("stderr").alias("stream"), (k * 512 + wrong).alias("start"), F.least(k * 512 + 512, size).alias("end")))
    return documents(spark, sf_dir).where("text is not null").select("doc_id", acquisition.events_cover(events, size).alias("covered"))


# ---------------------------------------------------------------- evaluation

@query(f"""with shown as (select doc_id, left(text, {_FITS.format(512)}) visible from documents where text is not null), facts as (select doc_id, unnest([text[1:20], text[400:420], text[-20:]]) fact from documents where len(text) >= 200),
    met as (select doc_id, visible, fact from shown left join facts using (doc_id)) select doc_id, count(fact) facts, count(*) filter (where contains(visible, fact)) kept,
    case when count(fact) = 0 then 1.0 else (count(*) filter (where contains(visible, fact)))::double / count(fact) end::double recall from met group by doc_id""")
def fact_recall(spark, sf_dir):
    docs = documents(spark, sf_dir).where("text is not null")
    shown = docs.select("doc_id", T.byte_prefix(F.col("text"), 512).alias("visible"))
    cut = F.array(F.substring("text", 1, 20), F.substring("text", 400, 21), F.substr("text", F.greatest(F.length("text") - 19, F.lit(1))))
    facts = docs.where(F.length("text") >= 200).select("doc_id", F.explode(cut).alias("fact"))  # shorter ones have none: recall 1
    return evaluation.fact_recall(shown, facts, "doc_id")


@query("""with used as (select case when strlen(text) <= 2048 then 'exact' else 'extractive' end fidelity, floor(least(strlen(text), 2048) * 10000 / 2048)::bigint used from documents where text is not null)
    select fidelity, count(*) n, min(used) low, quantile_disc(used, 0.5) median, quantile_disc(used, 0.95) p95, max(used) high from used group by 1""")
def utilization_stats(spark, sf_dir):
    size = F.octet_length("text")
    rows = documents(spark, sf_dir).where("text is not null").select(F.when(size <= 2048, "exact").otherwise("extractive").alias("fidelity"), F.least(size, F.lit(2048)).alias("visible_count"))
    return evaluation.utilization(rows, 2048)


@query("select doc_id, unnest(list_filter([" + ", ".join(f"case when {has('text', p)} then {lit(n)} end" for n, p in evaluation.SECRETS.items()) + "], lambda x: x is not null)) rule from documents where text is not null")
def secret_scan(spark, sf_dir):
    return evaluation.secret_scan(documents(spark, sf_dir))


_CAPTURED = "select doc_id, replace(replace(text, ' the ', case when doc_id % 2 = 0 then ' /home/dev/a ' else ' /Users/ann.b/a ' end), ' and ', ' dev@example.invalid ') t from documents where text is not null"


@query(f"""with c as ({_CAPTURED}), found as (
    select doc_id, 'home-path' rule, unnest(regexp_extract_all(t, '/(?:home|Users)/([A-Za-z0-9._-]+)', 1)) x from c
    union all select doc_id, 'email', unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')) from c)
    select distinct doc_id, rule from found where x not in ('dev', 'dev@example.invalid')""")
def identity_scan(spark, sf_dir):
    """Who captured a text: home folders and addresses but the neutral ones, which half of the texts are given."""
    home = F.when(F.col("doc_id") % 2 == 0, " /home/dev/a ").otherwise(" /Users/ann.b/a ")
    text = F.replace(F.replace("text", F.lit(" the "), home), F.lit(" and "), F.lit(" dev@example.invalid "))
    return evaluation.secret_scan(documents(spark, sf_dir).where("text is not null").select("doc_id", text.alias("text")), rules=evaluation.IDENTITIES)


@query(f"""with c as (select quality, count(*) n, count(*) filter (where toxic = 1) s from labels group by 1), p as (select quality, n, s, s::double / n p, {evaluation.Z * evaluation.Z!r}::double zz from c)
    select quality, n, s, greatest((p + zz / (n * 2) - {evaluation.Z!r} * sqrt((p * (1.0 - p) + zz / (n * 4)) / n)) / (1.0 + zz / n), 0)::double low,
    least((p + zz / (n * 2) + {evaluation.Z!r} * sqrt((p * (1.0 - p) + zz / (n * 4)) / n)) / (1.0 + zz / n), 1)::double high from p""")
def wilson_interval(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("s"))
    low_, high_ = evaluation.wilson(F.col("s"), F.col("n"))
    return counts.select("quality", "n", "s", low_.alias("low"), high_.alias("high"))


from . import line_queries, plan_queries  # noqa: E402, F401  (they register their own)
