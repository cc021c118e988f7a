"""Queries of requests, hooks, acquisitions, envelopes, receipts, lineage and evaluation.

Where an operator judges one row by rules, the query gives it variants of a row, in turn along a table, and the SQL
states what each variant must come to.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import line_queries as lines_
from .operators import evaluation, kernel, projection, scans, store
from .plans import acquisition, codes, config, envelope, handling, hooks, requests, rpc, sql
from .registry import query, table
from .sources import corpus, rendered

NOW = 1_000_000
LIMIT = 1024


def _text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _in_turn(items: list, at: str) -> str:
    """SQL: the item of a list whose turn it is."""
    return f"[{', '.join(map(_text, items))}][({at} % {len(items)} + 1)::bigint]"


def _turn(items: list, at) -> F.Column:
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in items)), (at % len(items) + 1).cast("int"))


# ---------------------------------------------------------------- requests

_BUDGET = '"budget":{"unit":"bytes","total_visible_limit":1000,"reserved_envelope":100}'
_INLINE = '"source":{"kind":"inline","bytes":"aGk="}'
_ID, _SHA = "0123456789abcdef" * 2, "ab" * 32
_REF = f'"artifact":{{"schema_version":"a/v3","id":"{_ID}","source_sha256":"{_SHA}","source_bytes":3,"created_at":1,"expires_at":2}}'
_PROCESS = '"kind":"process","executable":"L2Jpbi9zaA==","argv":["LWM="],"cwd_root_id":"repo","cwd_relative_path":""'


def _request(source: str = _INLINE, version: str = '"v3"', id_: str = '"r~"', budget: str = _BUDGET, profile: str = '"auto/v1"', more: str = "") -> str:
    return f'{{"contract_version":{version},"request_id":{id_},{source},{budget},"preservation_profile":{profile}{more}}}'


def _selector(body: str, version: str = '"v3"') -> str:
    return _request(f'"source":{{"kind":"artifact",{_REF},"selector":{{{body}}}}}', version)


#: Request (~ is the row's key), id that is kept, failure of decoding, failure of validation of what decodes.
REQUESTS = [
    (_request(), "r~", None, None),
    (_request(version='"v2"'), "r~", None, None),
    (_request(version='"v1"'), "r~", "schema_unsupported", None),
    (_request('"source":{"kind":"socket"}'), "r~", "source_unsupported", None),
    (_request('"source":{"kind":"socket"}', '"v1"'), "r~", "schema_unsupported", None),
    (_request(more=',"surprise":1'), "r~", "invalid_request", None),
    (_request(budget='"other":1'), "r~", "invalid_request", None),
    ("nope ~", None, "invalid_request", None),
    ("[1, ~]", None, "invalid_request", None),
    (_request(id_="5"), None, "invalid_request", None),
    (_request(id_='""'), None, None, "invalid_request"),
    (_request(id_='"' + "x" * 129 + '"'), None, None, "invalid_request"),
    (_request('"source":{"kind":"inline","bytes":"YR=="}'), "r~", "invalid_request", None),
    (_request('"source":{"kind":"inline","bytes":"aGk=","media_type":null}'), "r~", None, None),
    (_request('"source":{"kind":"file","root_id":"repo","relative_path":"YQ==","binary_policy":"accept"}'), "r~", None, None),
    (_request('"source":{"kind":"file","root_id":"other","relative_path":"YQ==","binary_policy":"reject"}'), "r~", None, "unsafe_root"),
    (_request('"source":{"kind":"file","root_id":"a b","relative_path":"YQ==","binary_policy":"accept"}'), "r~", None, "invalid_request"),
    (_request('"source":{"kind":"file","root_id":"repo","relative_path":"YQBi","binary_policy":"accept"}'), "r~", None, "invalid_request"),
    (_request('"source":{"kind":"file","root_id":"repo","relative_path":"YQ==","binary_policy":"maybe"}'), "r~", "invalid_request", None),
    (_request(f'"source":{{{_PROCESS}}}'), "r~", None, None),
    (_request(f'"source":{{{_PROCESS},"timeout_ms":99}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{{_PROCESS},"timeout_ms":300000,"environment_profile":"ci"}}'), "r~", None, None),
    (_request(f'"source":{{{_PROCESS},"environment_profile":"x"}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{{_PROCESS.replace("L2Jpbi9zaA==", "")}}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{{_PROCESS.replace("LWM=", "YQBi")}}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{{_PROCESS.replace("repo", "other")}}}'), "r~", None, "unsafe_root"),
    (_request(f'"source":{{{_PROCESS.replace("[", "[5,")}}}'), "r~", "invalid_request", None),
    (_request(f'"source":{{"kind":"artifact",{_REF}}}'), "r~", None, None),
    (_request(f'"source":{{"kind":"artifact",{_REF.replace(_ID, "short")}}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{"kind":"artifact",{_REF.replace(_SHA, _SHA.upper())}}}'), "r~", None, "invalid_request"),
    (_request(f'"source":{{"kind":"artifact",{_REF.replace(chr(34) + "created_at" + chr(34) + ":1,", "")}}}'), "r~", "invalid_request", None),
    (_selector('"kind":"lines","start_line":1,"line_count":2'), "r~", None, None),
    (_selector('"kind":"lines","start_line":0,"line_count":2'), "r~", None, "invalid_request"),
    (_selector('"kind":"lines","start_line":1,"line_count":0'), "r~", None, "invalid_request"),
    (_selector('"kind":"lines","start_line":1,"line_count":2,"pattern":"YQ=="'), "r~", "invalid_request", None),
    (_selector('"kind":"pattern","pattern":"YQ=="'), "r~", None, None),
    (_selector('"kind":"pattern","pattern":""'), "r~", None, "invalid_request"),
    (_selector('"kind":"pattern","pattern":"/w=="'), "r~", None, "invalid_request"),
    (_selector('"kind":"pattern","pattern":"YQ==","before_lines":16,"after_lines":17'), "r~", None, "invalid_request"),
    (_selector('"kind":"pattern","pattern":"YQ==","before_lines":16,"max_matches":32'), "r~", None, None),
    (_selector('"kind":"pattern","pattern":"YQ==","max_matches":0'), "r~", None, "invalid_request"),
    (_selector('"kind":"pattern","pattern":"YQ==","max_matches":33'), "r~", None, "invalid_request"),
    (_selector('"kind":"lines","start_line":1,"line_count":2', '"v2"'), "r~", None, "schema_unsupported"),
    (_request(more=',"retention":{"expires_at":2000000,"ttl_seconds":5}'), "r~", None, "invalid_request"),
    (_request(more=',"retention":{"ttl_seconds":0}'), "r~", None, "invalid_request"),
    (_request(more=',"retention":{"expires_at":1000000}'), "r~", None, "invalid_request"),
    (_request(more=',"retention":{"expires_at":1000001}'), "r~", None, None),
    (_request(more=',"retention":{"ttl_seconds":-1}'), "r~", "invalid_request", None),
    (_request(more=',"focus":"why"'), "r~", None, None),
    (_request(version='"v2"', more=',"focus":"why"'), "r~", None, "schema_unsupported"),
    (_request(more=',"focus":""'), "r~", None, "invalid_request"),
    (_request(more=',"focus":"' + "é" * 128 + '"'), "r~", None, None),
    (_request(more=',"focus":"' + "é" * 128 + 'x"'), "r~", None, "invalid_request"),
    (_request(profile='"nope/v1"'), "r~", None, "invalid_request"),
    (_request(profile="5"), "r~", "invalid_request", None),
    (_request(budget=_BUDGET.replace("100}", "1001}")), "r~", None, "invalid_request"),
    (_request(budget=_BUDGET.replace("}", ',"token_profile":"cl100k_base@js-tiktoken-1.0.15"}')), "r~", None, "invalid_request"),
    (_request(budget=_BUDGET.replace("bytes", "tokens")), "r~", None, "token_profile_unsupported"),
    (_request(budget=_BUDGET.replace("bytes", "tokens").replace("}", ',"token_profile":"cl100k_base@js-tiktoken-1.0.15"}')), "r~", None, None),
    (_request(budget=_BUDGET.replace("bytes", "chars")), "r~", "invalid_request", None),
    (_request(budget=_BUDGET.replace(":1000", ":-1")), "r~", "invalid_request", None),
    (_request(budget=_BUDGET.replace(":1000", ":12.5")), "r~", "invalid_request", None),
    (_request(version='"v2"', profile='"nope/v1"', more=',"focus":"why"'), "r~", None, "schema_unsupported"),
    (_request(f'"source":{{{_PROCESS.replace("repo", "other")}}}', more=',"retention":{"ttl_seconds":0}'), "r~", None, "unsafe_root"),
]


def _decoded(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(_turn([r[0] for r in REQUESTS], k), F.lit("~"), k.cast("string")).alias("value"))
    return requests.decoded(rows, keep=("o_orderkey",))


def _expected(column: int) -> str:
    return _in_turn([r[column] for r in REQUESTS], "o_orderkey")


@query(f"select o_orderkey, replace({_expected(1)}, '~', o_orderkey::varchar) request_id, {_expected(2)} failure from orders")
def request_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("o_orderkey", "request_id", "failure")


@query(f"select o_orderkey, {_expected(3)} failure from orders where {_expected(2)} is null")
def request_validation(spark, sf_dir):
    sound = _decoded(spark, sf_dir).where("failure is null")
    return sound.select("o_orderkey", requests.failure(F.col("request"), NOW, ("repo",), ("ci",)).alias("failure"))


#: Executable and arguments (as lengths in bytes and their number), timeout, failure.
PROCESSES = [(7, 1, 1, None, None), (0, 1, 1, None, "invalid_request"), (4097, 1, 1, None, "invalid_request"), (7, 4096, 1, 100, None), (7, 4097, 1, 100, "resource_exhausted"), (7, 2, 524285, 5000, "resource_exhausted"), (6, 2, 524285, 5000, None), (7, 1, 1, 99, "invalid_request"), (7, 1, 1, 300001, "invalid_request")]


@query(f"select s_suppkey, {_in_turn([p[4] for p in PROCESSES], 's_suppkey')} failure from supplier")
def process_validation(spark, sf_dir):
    """Suppliers take processes of every size in turn."""
    variants = F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(("e", "n", "size", "timeout"), p))) for p in PROCESSES))
    suppliers = scans.spread(table(spark, sf_dir, "supplier").select("s_suppkey"))  # small rows that become large ones
    rows = suppliers.select("s_suppkey", F.element_at(variants, (F.col("s_suppkey") % len(PROCESSES) + 1).cast("int")).alias("p")).select("s_suppkey", "p.*")
    executable, one = F.repeat(F.lit("x"), F.col("e").cast("int")).cast("binary"), F.repeat(F.lit("é"), F.col("size").cast("int")).cast("binary")
    argv = F.array_repeat(F.substring(F.col("one"), 1, 1 << 30), F.col("n").cast("int"))
    return rows.withColumn("one", F.substr(one, F.lit(1), F.col("size").cast("int"))).select("s_suppkey", requests.process_failure(executable, argv, F.col("timeout")).alias("failure"))


#: What a request ends with, by hand: code (empty: none) and the command's exit code.
ENDS = [
    ("invalid_request", 2), ("schema_unsupported", 2), ("source_unsupported", 2), ("token_profile_unsupported", 2), ("input_too_large", 2), ("resource_exhausted", 2), ("unsafe_root", 2), ("budget_unsatisfiable", 3),
    ("artifact_unknown", 4), ("artifact_expired", 4), ("artifact_corrupt", 4), ("artifact_schema_unsupported", 4), ("permission_denied", 5), ("store_full", 5), ("store_busy", 5), ("commit_failed", 5),
    ("acquisition_failed", 6), ("invariant_breach", 70), ("", 0)
]


@query(f"select o_orderkey, {_in_turn([e[0] for e in ENDS], 'o_orderkey')} code, {_in_turn([str(e[1]) for e in ENDS], 'o_orderkey')}::int exit_code from orders")
def failure_exit_codes(spark, sf_dir):
    """Orders end in every way in turn."""
    told = table(spark, sf_dir, "orders").select("o_orderkey", _turn([e[0] for e in ENDS], F.col("o_orderkey")).alias("code"))
    return told.select("o_orderkey", "code", codes.exit_code(F.when(F.col("code") != "", F.col("code"))).alias("exit_code"))


CONFIGS = [
    ({}, None), ({"store_path": "store/db"}, "unsafe_root"), ({"store_path": "/srv/../db"}, "unsafe_root"), ({"roots": {"a": "/srv/other"}}, None), ({"roots": {"a": "/srv/store/in"}}, "unsafe_root"), ({"roots": {"a": "/srv"}}, "unsafe_root"),
    ({"roots": {"a": "rel"}}, "unsafe_root"), ({"roots": {"a": "/srv/storex"}}, None), ({"store_bytes": 0}, "invalid_request"), ({"lineage_bytes": 0}, "invalid_request"), ({"lineage_bytes": (64 << 20) + 1}, "invalid_request"), ({"lineage_bytes": 64 << 20}, None),
    ({"busy_ms": 0}, "invalid_request"), ({"busy_ms": 5001}, "invalid_request"), ({"ttl_seconds": 0}, "invalid_request"), ({"store_bytes": 0, "roots": {"a": "/srv"}}, "unsafe_root"),
]


@query(f"select c_custkey, {_in_turn([c[1] for c in CONFIGS], 'c_custkey')} failure from customer")
def config_validation(spark, sf_dir):
    """Customers bring every configuration in turn, as JSON."""
    told = _turn([json.dumps({"store_path": "/srv/store/db"} | c) for c, _ in CONFIGS], F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", config.failure(F.from_json(told, config.CONFIG)).alias("failure"))


# ---------------------------------------------------------------- hooks

def _event(more: str = "", name: str = "PostToolUse", tool: str = "Bash", session: str = "s@", response: str = '"out @"', inputs: str = '{"command":"ls @"}') -> str:
    return f'{{"session_id":"{session}","cwd":"/w","hook_event_name":"{name}","tool_name":"{tool}","tool_use_id":"u@","tool_input":{inputs},"tool_response":{response}{more}}}'


#: Event, kind, request id, focus, prompt, source, failure.
EVENTS = [
    (_event(), "tool", "s@:u@", "ls @", None, "out @", None),
    (_event(response='{"b":[1,@],"a":"x"}', inputs='{"path":"/p","query":5,"file_path":"f","body":"long"}'), "tool", "s@:u@", "f /p", None, None, None),
    (_event(tool="mcp__x__y", inputs='"plain text"'), "tool", "s@:u@", "plain text", None, "out @", None),
    (_event(tool="WebFetch"), "unsupported", None, None, None, None, None),
    (_event(tool="Edit", inputs='{"note":"x"}'), "tool", "s@:u@", None, None, "out @", None),
    (_event(more=',"schema_version":"v9"'), None, None, None, None, None, "schema_unsupported"),
    (_event(more=',"hook_schema_version":"v1"'), "tool", "s@:u@", "ls @", None, "out @", None),
    (_event(name="Stop"), None, None, None, None, None, "schema_unsupported"),
    (_event(session=""), None, None, None, None, None, "invalid_request"),
    (_event(session="é" * 129), None, None, None, None, None, "invalid_request"),
    (_event(inputs="null"), None, None, None, None, None, "invalid_request"),
    (_event().replace('"tool_response"', '"other"'), None, None, None, None, None, "invalid_request"),
    (_event(more=',"turn_id":"' + "t" * 257 + '"'), None, None, None, None, None, "invalid_request"),
    ("{broken @", None, None, None, None, None, "invalid_request"),
    ('{"hook_event_name":"UserPromptSubmit","session_id":"s@","prompt":"find @"}', "prompt", None, None, "find @", None, None),
    ('{"hook_event_name":"UserPromptSubmit","session_id":"","prompt":"find @"}', None, None, None, None, None, "schema_unsupported"),
    ('{"hook_event_name":"UserPromptSubmit","session_id":"s@"}', None, None, None, None, None, "invalid_request"),
    (_event(session="s" * 200), "tool", "s" * 128, "ls @", None, "out @", None),
]
_ANSWERED = 1  # the variant whose answer is an object: compact JSON, keys in the order of the variant encoding


def _events(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(_turn([e[0] for e in EVENTS], k), F.lit("@"), k.cast("string")).alias("value"))
    return hooks.events(rows, keep=("event_id",))


def _event_sql(column: int) -> str:
    return f"replace({_in_turn([e[column] for e in EVENTS], 'event_id')}, '@', event_id::varchar)"


@query(f"""select event_id, {_event_sql(1)} kind, {_event_sql(2)} request_id, {_event_sql(3)} focus, {_event_sql(4)} prompt,
    case when event_id % {len(EVENTS)} = {_ANSWERED} then '{{"a":"x","b":[1,' || event_id || ']}}' else {_event_sql(5)} end "source", {_event_sql(6)} failure from events""")
def hook_events(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "kind", "request_id", "focus", "prompt", "source", "failure")


@query(f"""with e as (select event_id, {_event_sql(1)} kind from events), told as (select event_id, unnest(['off', 'observe', 'active']) as mode, kind, event_id % 3 as outcome from e)
    select event_id, "mode", case when "mode" = 'off' or kind = 'prompt' then null when kind is null then '{{"decision":"block","reason":"body"}}' when kind = 'unsupported' then '{{"systemMessage":"unsupported_surface: not a supported local tool"}}'
    when outcome = 0 then case "mode" when 'active' then '{{"decision":"block","reason":"body"}}' else '{{"systemMessage":"observe diagnostic [store_full]: ' || repeat('m', 256) || '"}}' end
    when outcome = 1 and "mode" = 'active' then '{{"decision":"block","reason":"body"}}' end told from told""")
def hook_feedback(spark, sf_dir):
    outcome = F.col("event_id") % 3
    fidelity, code = F.when(outcome == 1, "extractive").when(outcome == 2, "exact"), F.when(outcome == 0, "store_full")
    events, out = _events(spark, sf_dir), None
    for mode in hooks.MODES:
        told = hooks.told(mode, F.col("kind"), fidelity, code, F.lit("body"), F.lit("m" * 300))
        rows = events.select("event_id", F.lit(mode).alias("mode"), told.alias("told"))
        out = rows if out is None else out.union(rows)
    return out


#: Message, kind, id, method, params, error code.
MESSAGES = [
    ('{"jsonrpc":"2.0","id":@,"method":"tools/call","params":{"name":"read"}}', "request", "@", "tools/call", '{"name":"read"}', None),
    ('{"jsonrpc":"2.0","id":"a@","method":"tools/list"}', "request", '"a@"', "tools/list", None, None),
    ('{"jsonrpc":"2.0","method":"tools/list"}', "silent", None, None, None, None), ('{"jsonrpc":"2.0","id":null,"method":"tools/list"}', "silent", None, None, None, None),
    ('{"jsonrpc":"2.0","id":7,"method":"notifications/initialized"}', "silent", None, None, None, None), ('{"jsonrpc":"2.0","method":"notifications/cancelled","params":{}}', "silent", None, None, None, None),
    ("{broken @", "error", "null", None, None, "-32700"), ("[1]", "error", "null", None, None, "-32700"), ('{"id":1,"method":"x"}', "error", "null", None, None, "-32700"), ('{"jsonrpc":"2.0","id":1}', "error", "null", None, None, "-32700"),
    ('{"jsonrpc":"1.0","id":@,"method":"x"}', "error", "@", None, None, "-32600"), ('{"jsonrpc":"2.0","id":@,"method":""}', "error", "@", None, None, "-32600"), ('{"jsonrpc":"2.0","id":[1],"method":"x"}', "error", "null", None, None, "-32600"),
    ('{"jsonrpc":"2.0","id":true,"method":"x"}', "error", "null", None, None, "-32600"),
]


def _message_sql(column: int) -> str:
    return f"replace({_in_turn([m[column] for m in MESSAGES], 'event_id')}, '@', event_id::varchar)"


@query(f"select event_id, {_message_sql(1)} kind, {_message_sql(2)} id, {_message_sql(3)} as method, {_message_sql(4)} params, {_message_sql(5)}::int error_code from events")
def rpc_messages(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(_turn([m[0] for m in MESSAGES], k), F.lit("@"), k.cast("string")).alias("value"))
    return rpc.messages(rows, keep=("event_id",)).select("event_id", "kind", "id", "method", "params", "error_code")


#: Command line (@ is the row's key) and its words, by line ends; null for one that isn't in the strict form.
COMMANDS = [
    ("'a@'", "a@"), ("'a' 'b @'", "a\nb @"), ("''", ""), ("'it'\"'\"'s @'", "it's @"), ("''\"'\"'' 'x'", "'\nx"), ("a@", None), ("'a'  'b'", None), ("'a' ", None), ("'a''b'", None), ("'a", None), ('"a"', None), (" 'a'", None), ("'a b' '\"'", 'a b\n"'),
]


@query(f"select event_id, replace({_in_turn([c[1] for c in COMMANDS], 'event_id')}, '@', event_id::varchar) words from events")
def shell_commands(spark, sf_dir):
    from .functions.text import shell_words

    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(_turn([c[0] for c in COMMANDS], k), F.lit("@"), k.cast("string")).alias("line"))
    return rows.select("event_id", F.array_join(shell_words(F.col("line")), "\n").alias("words"))


@query("select doc_id, text is not null round_trip from documents")
def shell_quoting(spark, sf_dir):
    from .functions.text import shell_quote, shell_words

    line = F.concat(shell_quote(F.col("text")), F.lit(" "), shell_quote(F.lit("it's")))
    words = shell_words(line)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce((F.size(words) == 2) & (words[0] == F.col("text")) & (words[1] == "it's"), F.lit(False)).alias("round_trip"))


# ---------------------------------------------------------------- acquisitions

def _claims(variant, complete=True, partial=False, truncated=False, root=None, path=None, process=None) -> str:
    f = lambda x: "null" if x is None else f'"{x}"'
    b = lambda x: str(x).lower()
    return f'{{"variant":"{variant}","complete":{b(complete)},"partial":{b(partial)},"truncated":{b(truncated)},"root_id":{f(root)},"relative_path":{f(path)},"process":{process or "null"}}}'


def _ran(code="0", signal="null", timed_out="false", where="repo:<1 path bytes>", events='[{"order":0,"stream":"stdout","start":0,"end":4},{"order":1,"stream":"stderr","start":4,"end":9}]') -> str:
    return f'{{"events":{events},"exit_code":{code},"signal":{signal},"timed_out":{timed_out},"working_directory":"{where}"}}'


_PART = dict(complete=False, partial=True, root="repo")
#: Claims about nine bytes (or none, where that is said), state.
CLAIMS = [
    (_claims("inline"), 9, "inline"), (_claims("artifact"), 9, "artifact"), (_claims("inline", root="repo"), 9, None), (_claims("inline", complete=False), 9, None), (_claims("inline", complete=False), 0, "acquisition_failed"),
    (_claims("inline", partial=True), 9, None), (_claims("inline", complete=False, partial=True), 9, None), (_claims("inline", truncated=True), 9, None), (_claims("file", root="repo", path="<3 path bytes>"), 9, "file"),
    (_claims("file", root="repo", path="a/b"), 9, None), (_claims("file", root="repo", path="<4097 path bytes>"), 9, None), (_claims("file", path="<3 path bytes>"), 9, None), (_claims("file", root="a b", path="<3 path bytes>"), 9, None),
    (_claims("file", root="repo", path="<3 path bytes>", process=_ran()), 9, None), (_claims("file", complete=False, root="repo", path="<3 path bytes>"), 0, "acquisition_failed"), (_claims("process", root="repo", process=_ran()), 9, "process_complete"),
    (_claims("process", root="repo", process=_ran("7")), 9, "process_complete"), (_claims("process", root="repo", process=_ran("null", "9")), 9, None), (_claims("process", root="repo", process=_ran(timed_out="true")), 9, None),
    (_claims("process", root="repo", process=_ran("0", "9")), 9, None), (_claims("process", root="repo", process=_ran(where="other:<1 path bytes>")), 9, None), (_claims("process", root="repo", process=_ran(where="repo:/w")), 9, None),
    (_claims("process", root="repo", process=_ran()), 8, None), (_claims("process", root="repo", path="<1 path bytes>", process=_ran()), 9, None), (_claims("process", root="repo"), 9, None),
    (_claims("process", **_PART, process=_ran("null", "9")), 9, "process_partial"), (_claims("process", **_PART, truncated=True, process=_ran("null", "9", "true")), 9, "process_partial"), (_claims("process", **_PART, process=_ran("null")), 9, None),
    (_claims("process", complete=False, root="repo", process=_ran("null", events="[]")), 0, "process_failed"), (_claims("process", complete=False, root="repo", process=_ran("0", events="[]")), 0, None),
    (_claims("process", root="repo", process=_ran(events='[{"order":1,"stream":"stdout","start":0,"end":9}]')), 9, None), (_claims("process", root="repo", process=_ran(events='[{"order":0,"stream":"stdout","start":0,"end":9}]')), 9, "process_complete"),
    (_claims("other"), 9, None),
]


@query(f"select o_orderkey, {_in_turn([c[2] for c in CLAIMS], 'o_orderkey')} state from orders")
def acquisition_state(spark, sf_dir):
    k = F.col("o_orderkey")
    claims = F.from_json(_turn([c[0] for c in CLAIMS], k), acquisition.RECEIPT)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", claims.alias("c"), _turn([str(c[1]) for c in CLAIMS], k).cast("long").alias("size"))
    return rows.select("o_orderkey", acquisition.state(F.col("c"), F.col("size")).alias("state"))


@query("select doc_id, '<' || strlen(source) || ' path bytes>' summary from documents where source is not null")
def path_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", acquisition.path_summary(F.col("source")).alias("summary"))


# ---------------------------------------------------------------- projection

def _head_tail(lines: str, limit: int) -> str:
    """SQL for what is kept of texts whose shape prefers none of their lines: the first and the last where they fit, then one
    line after the first, one before the last, in turn, until neither fits; where neither end fits, the longest prefix.

    `lines` is SQL of (doc_id, text, l), l the lines with their ends; kept(doc_id, w, kept) follows.
    """
    prefix = f"(select left(text, (select max(k) from range(0, {limit} + 1) t(k) where strlen(left(text, k)) <= {limit})))"
    return f"""sized as materialized (select doc_id, text, l, list_transform(l, lambda x: strlen(x)) z, len(l) n, strlen(text) w from ({lines})),
    grown as (
    select doc_id, case when z[1] <= {limit} then 1 else 0 end i, case when n > 1 and (case when z[1] <= {limit} then z[1] else 0 end) + z[n] <= {limit} then n - 1 else n end j,
        (case when z[1] <= {limit} then z[1] else 0 end + case when n > 1 and (case when z[1] <= {limit} then z[1] else 0 end) + z[n] <= {limit} then z[n] else 0 end)::bigint total,
        z[1] <= {limit} f, n > 1 and (case when z[1] <= {limit} then z[1] else 0 end) + z[n] <= {limit} b, 0 turn from sized where w > {limit}
    union all
    select doc_id, case when turn = 0 and f and total + z[i + 1] <= {limit} then i + 1 else i end, case when turn = 1 and b and total + z[j] <= {limit} then j - 1 else j end,
        total + case when turn = 0 and f and total + z[i + 1] <= {limit} then z[i + 1] when turn = 1 and b and total + z[j] <= {limit} then z[j] else 0 end,
        case when turn = 0 then f and total + z[i + 1] <= {limit} else f end, case when turn = 1 then b and total + z[j] <= {limit} else b end, 1 - turn
    from grown join sized using (doc_id) where f or b),
    ended as (select doc_id, i, j from grown where not f and not b qualify row_number() over (partition by doc_id order by i - j desc) = 1),
    told as (select s.doc_id, w, text, coalesce(array_to_string(l[1:i], '') || array_to_string(l[j + 1:n], ''), '') part from sized s left join ended using (doc_id)),
    kept as (select doc_id, w, case when w <= {limit} then text when part <> '' then part else {prefix} end kept from told)"""


_WHOLE = r"select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') l from documents where text is not null"
_TOLD = f"case when w <= {LIMIT} then 'exact' else 'extractive' end fidelity"


@query(f"with recursive {_head_tail(_WHOLE, LIMIT)} select doc_id, {_TOLD}, w::bigint original_count, strlen(kept) visible_count, kept visible from kept")
def project_head_tail(spark, sf_dir):
    """Documents hold no line that the shape prefers, so first and last line and what grows from them are the whole projection."""
    out = projection.project(table(spark, sf_dir, "documents").where("text is not null"), profile="api-json/v1", total=LIMIT)
    return out.select("doc_id", "fidelity", "original_count", "visible_count", "visible")


_PART = r"""select doc_id, array_to_string(regexp_extract_all(text, '[^\n]*\n|[^\n]+')[2:9], '') as text, regexp_extract_all(text, '[^\n]*\n|[^\n]+')[2:9] l from documents where len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) > 1"""


@query(f"with recursive {_head_tail(_PART, 600)} select d.doc_id, 'extractive' fidelity, strlen(d.text) original_count, strlen(coalesce(kept, '')) visible_count, coalesce(kept, '') visible from documents d left join kept using (doc_id) where d.text is not null")
def project_lines_checked(spark, sf_dir):
    """A selection of lines 2 to 9, projected: the same rule over the selected region, in a budget of the selection's own."""
    out = projection.project(table(spark, sf_dir, "documents").where("text is not null"), profile="json/v1", total=700, reserved=100, selector={"lines": (2, 8)})
    return out.select("doc_id", "fidelity", "original_count", "visible_count", "visible")


def _source_slices(text, spans, runs, label: str = kernel.LABEL):
    """A projection's text put together from its source: slices, and the note of each gap that is one collapsed run."""
    raw = text.cast("binary")
    cut = lambda s: F.substr(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    at = F.map_from_entries(F.transform(runs, lambda r: F.struct(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")), r["lines"])))
    held = lambda a, b: F.try_element_at(at, F.concat_ws("-", a.cast("string"), b.cast("string")))
    note = lambda a, b: F.when(held(a, b).isNotNull(), F.format_string(f"[{label}: %d repeated lines omitted]\n", held(a, b))).otherwise("")
    parts = F.transform(spans, lambda s, i: F.concat(F.when(i > 0, note(F.try_element_at(spans, i)["end"], s["start"])).otherwise(""), cut(s).cast("string")))
    return F.array_join(parts, "")


def _invariants(docs: DataFrame, limit: int, **options) -> DataFrame:
    """What every projection must satisfy, checked from its source: one row a document."""
    met = projection.project(docs, total=limit, keep=("text",), **options)  # the source comes along, so it is rendered once and meets nothing
    size = F.octet_length("text").cast("long")
    facts = F.transform("fact_ids", lambda x: F.transform(F.split(F.substring_index(x, ":", -1), "-"), lambda y: y.cast("long")))
    kept = F.forall(facts, lambda f: F.exists("retained", lambda s: (s["start"] <= f[0]) & (f[1] <= s["end"])))
    return met.select(
        "doc_id", "applied_profile", "fidelity", "original_count", F.size("fact_ids").alias("facts"), kept.alias("facts_kept"), (F.col("visible_count") <= limit).alias("fits"),
        (F.col("visible_count") == F.octet_length("visible")).alias("counted"), store._follow(F.array_sort(F.concat("retained", "omitted")), size, True).alias("partitions"),
        (_source_slices(F.col("text"), F.col("retained"), F.col("aggregates")) == F.col("visible")).alias("verbatim"), "error_code",
    )


def _invariants_sql(limit: int, shape: str | None) -> str:
    classes = " ".join(f"when '{k}' then {lines_._class(k)}" for k in rendered.KINDS)
    chosen = "shape" if shape is None else f"'{shape}'"
    return f"""with {lines_._DOC_LINES}, {lines_._SHAPED},
        classed as (select doc_id, strlen(line) + 1 z, case {chosen} {classes} end as class from told join shaped using (doc_id)),
        facts as (select doc_id, count(*) filter (where class = 2) n, coalesce(sum(z) filter (where class = 2), 0) z from classed group by doc_id)
        select doc_id, {chosen} || '/v1' applied_profile, case when strlen(text) <= {limit} then 'exact' else 'extractive' end fidelity, strlen(text)::bigint original_count, n::int facts, true facts_kept, true fits, true counted,
        true partitions, true verbatim, null::varchar error_code from docs join shaped using (doc_id) join facts using (doc_id) where n <= 256 and (strlen(text) <= {limit} or z <= {limit})
        union all select doc_id, null, null, null, null, null, null, null, null, null, case when n > 256 then 'resource_exhausted' else 'budget_unsatisfiable' end from docs join facts using (doc_id)
        where not (n <= 256 and (strlen(text) <= {limit} or z <= {limit}))"""


def _checked(name: str, limit: int, shape: str | None = None, **options) -> None:
    def run(spark, sf_dir):
        docs = rendered.documents(table(spark, sf_dir, "lineitem"))
        out = _invariants(docs, limit, **({"profile": f"{shape}/v1"} if shape else {}), **options)
        ok = F.col("error_code").isNull()
        return out.select("doc_id", *(F.when(ok, F.col(c)).alias(c) for c in out.columns[1:-1]), "error_code")

    run.__name__ = name
    query(_invariants_sql(limit, shape))(run)


_checked("project_auto_checked", 1400)
_checked("project_focus_checked", 1400, focus="why did request part 7 fail with an error")
_checked("project_test_checked", 1400, "test-output")
_checked("project_log_checked", 700, "terminal-log")
_checked("project_lint_checked", 1400, "typecheck-lint")


@query(f"with recursive {_head_tail(_WHOLE, LIMIT)} select doc_id, {_TOLD}, 'api-json/v1' applied_profile, w::bigint original_count, strlen(kept) visible_count, kept visible, null::varchar error_code from kept union all select doc_id, null, null, null, null, null, 'invalid_request' from documents where text is null")
def project_text_lateral(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("_condensa_documents")
    return spark.sql(f"select d.doc_id, p.fidelity, p.applied_profile, p.original_count, p.visible_count, p.visible, p.error_code from _condensa_documents d, lateral project_text(d.text, 'json/v1', {LIMIT}, 0, null) p")


# Twenty profiles and what they apply, as they are documented; the last is none.
_PROFILES = [(f"{x}/v1", x) for x in rendered.KINDS] + [
    ("auto/v1", ""), ("plain-text/v1", "terminal-log"), ("build-log/v1", "build-output"), ("test-log/v1", "test-output"), ("diagnostic/v1", "typecheck-lint"), ("diff/v1", "unified-diff"), ("json/v1", "api-json"),
    ("source-code/v1", "source-file"), ("unicode/v1", "terminal-log"), ("binary/v1", "terminal-log"), ("untrusted-text/v1", "terminal-log"), ("none/v1", "terminal-log"), ("nope/v1", None),
]


@query(f"select o_orderkey, nullif({_in_turn([p[1] for p in _PROFILES], 'o_orderkey')}, '') shape, case when {_in_turn([p[1] for p in _PROFILES], 'o_orderkey')} is null then 'invalid_request' end error_code from orders")
def policy_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", _turn([p[0] for p in _PROFILES], F.col("o_orderkey")).alias("profile"))
    return projection.with_policy(spark, asked).select("o_orderkey", "shape", "error_code")


# ---------------------------------------------------------------- envelopes

def _artifact():
    digest = F.sha2(F.col("text").cast("binary"), 256)
    fields = {"schema_version": F.lit("artifact/v3"), "id": F.substring(digest, 1, 32), "source_sha256": digest, "source_bytes": F.octet_length("text").cast("long"), "created_at": F.lit(NOW).cast("long"), "expires_at": F.lit(NOW + 604800).cast("long")}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


_ARTIFACT_SQL = f"""'{{"schema_version":"artifact/v3","id":"' || sha256(text)[1:32] || '","source_sha256":"' || sha256(text) || '","source_bytes":' || strlen(text) || ',"created_at":{NOW},"expires_at":{NOW + 604800}}}'"""


def _enveloped(spark, sf_dir, total: int, reserved: int = 0, profile: str = "api-json/v1") -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    out = projection.project(docs, profile=profile, total=total, reserved=reserved).withColumnRenamed("doc_id", "of")
    met = docs.join(out, F.col("doc_id") == F.col("of"))
    artifact = _artifact()
    body = envelope.outcome({c: F.col(c) for c in ("fidelity", "original_count", "visible_count", "visible")}, F.col("error_code"), F.lit("the budget can't hold what must be kept"), artifact, artifact["source_sha256"])
    return met.select("doc_id", body.alias("envelope"), codes.exit_code(F.col("error_code")).alias("exit_code"), "fidelity", "visible_count")


@query(f"""select doc_id, '{{"schema_version":"projection/v1","source_is_untrusted":true,"projection":' || to_json(text)::varchar || ',"artifact":' || {_ARTIFACT_SQL} || ',"fidelity":"exact","accounting":{{"original":' || strlen(text) || ',"visible":'
    || strlen(text) || ',"unit":"bytes","token_profile":null}},"receipt":{{"schema_version":"receipt/v2","source_sha256":"' || sha256(text) || '","projection_version":"extractive/v1","policy_version":"preservation/v2"}}}}' envelope, 0 exit_code
    from documents where strlen(text) <= 16777216""")
def exact_envelopes(spark, sf_dir):
    return _enveloped(spark, sf_dir, 16 << 20).select("doc_id", "envelope", "exit_code")


@query(f"""select doc_id, '{{"schema_version":"projection/v1","error":{{"code":"budget_unsatisfiable","message":"the budget can''t hold what must be kept","artifact":' || {_ARTIFACT_SQL} || '}},"raw_content_included":false,"recovery":"select lines or a pattern of artifact '
    || sha256(text)[1:32] || ' within a budget"}}' envelope, 3 exit_code from documents where strlen(text) > 0""")
def error_envelopes(spark, sf_dir):
    return _enveloped(spark, sf_dir, 100, 100).select("doc_id", "envelope", "exit_code").where("exit_code <> 0")


@query(f"""select doc_id, strlen(text) > {LIMIT} recovers, case when strlen(text) > {LIMIT} then 'select lines or a pattern of artifact ' || sha256(text)[1:32] || ' within a budget' end recovery, case when strlen(text) > {LIMIT} then 'extractive' else 'exact' end fidelity,
    true omitted_agrees, true is_text from documents where text is not null""")
def projection_envelopes(spark, sf_dir):
    out = _enveloped(spark, sf_dir, LIMIT)
    e = F.col("envelope")
    told = lambda path: F.get_json_object(e, path)
    omitted = F.coalesce(told("$.accounting.omitted").cast("long"), F.lit(0)) == told("$.accounting.original").cast("long") - told("$.accounting.visible").cast("long")
    shaped = omitted & ((F.col("fidelity") == "exact") == told("$.accounting.omitted").isNull())
    return out.select("doc_id", told("$.recovery").isNotNull().alias("recovers"), told("$.recovery").alias("recovery"), told("$.fidelity").alias("fidelity"), shaped.alias("omitted_agrees"), (F.octet_length(told("$.projection")) == F.col("visible_count")).alias("is_text"))


@query("""select doc_id, '{"schema_version":"result/v1","ok":true,"result":{"n":' || strlen(text) || '}}' line from documents where text is not null""")
def result_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", envelope.result_line(F.to_json(F.struct(F.octet_length("text").alias("n")))).alias("line"))


# ---------------------------------------------------------------- receipts and lineage

def _receipt(fidelity="exact", kept="[[0,9]]", left="[]", schema="receipt/v2", policy="preservation/v2", unit="bytes", tokens="null", id_="r1", applied="terminal-log/v1", facts="[]", runs="[]", sha=_SHA, artifact=_REF, claims=None, version="extractive/v1") -> str:
    spans = lambda x: x.replace("[[", '[{"start":').replace("],[", '},{"start":').replace("]]", "}]").replace(",", ',"end":').replace('},"end":{', "},{") if x != "[]" else x
    return (
        f'{{"schema_version":"{schema}","request_id":"{id_}","source_sha256":"{sha}",{artifact.replace(chr(34) + "source_bytes" + chr(34) + ":3", chr(34) + "source_bytes" + chr(34) + ":9")},"projection_version":"{version}","policy_version":"{policy}",'
        f'"token_profile":{tokens},"original_count":9,"visible_count":9,"count_unit":"{unit}","fidelity":"{fidelity}","retained_spans":{spans(kept)},"omitted_spans":{spans(left)},'
        f'"preservation":{{"profile":"auto/v1","applied_profile":"{applied}","mandatory_fact_ids":{facts},"aggregates":{runs},"focus_applied":false}},"acquisition":{claims or _claims("inline")}}}'
    )


_RUN = '[{"span":{"start":%s,"end":%s},"lines":%s}]'
_TOKENS = '"cl100k_base@js-tiktoken-1.0.15"'
#: Receipt, whether it is valid for its artifact of nine bytes.
RECEIPTS = [
    (_receipt(), True), (_receipt(schema="receipt/v1", policy="preservation/v1", applied=""), True), (_receipt(applied=""), False), (_receipt(schema="receipt/v9"), False), (_receipt(policy="x"), False), (_receipt(version="x"), False),
    (_receipt(id_=""), False), (_receipt(id_="x" * 128), True), (_receipt(id_="x" * 129), False), (_receipt(sha="cd" * 32), False), (_receipt(artifact=_REF.replace(":2}", ":3}")), False), (_receipt(tokens=_TOKENS), False),
    (_receipt(unit="tokens", tokens=_TOKENS), True), (_receipt(unit="tokens"), False), (_receipt(facts='["a"]'), True), (_receipt(facts='[""]'), False), (_receipt(kept="[[0,8]]"), False), (_receipt(kept="[[0,10]]"), False),
    (_receipt(left="[[0,9]]"), False), (_receipt("extractive", "[[0,3],[5,9]]", "[[3,5]]"), True), (_receipt("extractive", "[[0,3],[5,9]]", "[[3,6]]"), False), (_receipt("extractive", "[[5,9],[0,3]]", "[[3,5]]"), False),
    (_receipt("extractive", "[[0,3],[3,9]]"), True), (_receipt("exact", "[[0,3],[5,9]]", "[[3,5]]"), False), (_receipt("encoded", "[]", "[[0,9]]"), True), (_receipt("encoded"), False), (_receipt("metadata_only", "[]", "[[0,9]]"), True),
    (_receipt("odd"), False), (_receipt("extractive", "[[0,3],[5,9]]", "[[3,5]]", runs=_RUN % (3, 5, 3)), True), (_receipt("extractive", "[[0,3],[5,9]]", "[[3,5]]", runs=_RUN % (3, 5, 0)), False), (_receipt(runs=_RUN % (3, 10, 3)), False),
    (_receipt(kept="[[0,9],[9,9]]"), False), (_receipt(claims=_claims("inline", partial=True)), False), (_receipt(claims=_claims("file", root="repo", path="<3 path bytes>")), True), ("{}", False), ("broken", False),
]


@query(f"select o_orderkey, {_in_turn([str(r[1]).lower() for r in RECEIPTS], 'o_orderkey')} = 'true' sound from orders")
def receipt_validation(spark, sf_dir):
    artifact = F.struct(F.lit(_ID).alias("id"), F.lit(_SHA).alias("source_sha256"), F.lit(9).cast("long").alias("source_bytes"), F.lit(1).cast("long").alias("created_at"), F.lit(2).cast("long").alias("expires_at"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(_turn([r[0] for r in RECEIPTS], F.col("o_orderkey")), store.RECEIPT).alias("r"))
    return rows.select("o_orderkey", store.receipt_sound(F.col("r"), artifact).alias("sound"))


@query("select doc_id, true sound from documents where text is not null")
def projection_receipts(spark, sf_dir):
    """Receipts made of real projections are valid for the artifacts of their sources."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    out = projection.project(docs, total=LIMIT).withColumnRenamed("doc_id", "of")
    met = docs.join(out, F.col("doc_id") == F.col("of")).withColumn("artifact", _artifact())
    claims = F.from_json(F.lit(_claims("inline")), acquisition.RECEIPT)
    named = {c: F.col(c) for c in ("fidelity", "applied_profile", "original_count", "visible_count", "retained", "omitted", "fact_ids", "aggregates")}
    r = store.receipt(named, F.col("artifact"), F.concat(F.lit("r"), F.col("doc_id").cast("string")), F.lit("auto/v1"), claims)
    stored = met.select("doc_id", "artifact", F.from_json(F.to_json(r), store.RECEIPT).alias("r"))
    return stored.select("doc_id", store.receipt_sound(F.col("r"), F.col("artifact")).alias("sound"))


def _receipts(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("artifact_id").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("artifact_id"), "event_id", F.col("event_type").alias("request_id"), F.coalesce("props", F.lit("")).cast("binary").alias("receipt")).withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))


_CHAIN = r"""r as materialized (select user_id artifact_id, row_number() over (partition by user_id order by event_id) - 1 sequence, encode(coalesce(props, '')) receipt from events),
    chain as (select artifact_id, sequence, sha256('lineage/v1'::blob || '\x00'::blob || encode('e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') || unhex(lpad(to_hex(sequence), 16, '0')) || receipt) digest from r where sequence = 0
      union all select r.artifact_id, r.sequence, sha256('lineage/v1'::blob || '\x00'::blob || encode(digest) || unhex(lpad(to_hex(r.sequence), 16, '0')) || receipt) from chain c join r on r.artifact_id = c.artifact_id and r.sequence = c.sequence + 1)"""


@query(f"with recursive {_CHAIN} select artifact_id, sequence, sha256(receipt) receipt_sha256, digest chain_sha256 from chain join r using (artifact_id, sequence)")
def lineage_links(spark, sf_dir):
    return store.links(_receipts(spark, sf_dir)).select("artifact_id", "sequence", "receipt_sha256", "chain_sha256")


@query(f"with recursive {_CHAIN} select artifact_id, count(*) receipts, arg_max(digest, sequence) head from chain group by 1")
def lineage_chain(spark, sf_dir):
    return store.chained(_receipts(spark, sf_dir))


@query("""with n as (select user_id artifact_id, count(*) n from events group by 1)
    select artifact_id, case when artifact_id % 8 in (1, 2, 4, 5, 6) or (artifact_id % 8 = 3 and n > 1) or (artifact_id % 8 = 7) then 'artifact_corrupt' end failure from n""")
def lineage_verification(spark, sf_dir):
    """Lineages that were tampered with, by artifact: 1 another receipt, 2 another digest, 3 a receipt that is gone (the
    claim stays), 4 another link, 5 another head claimed, 6 other bytes claimed, 7 no claim; 0 untouched."""
    linked, a, zero = store.links(_receipts(spark, sf_dir)), F.col("artifact_id") % 8, F.lit("0" * 64)
    claims, first = store.heads(linked), F.col("sequence") == 0
    claims = claims.withColumn("head", F.when(a == 5, zero).otherwise(F.col("head"))).withColumn("bytes", F.when(a == 6, F.col("bytes") + 1).otherwise(F.col("bytes"))).where(a != 7)
    spoilt = (
        linked.where((a != 3) | ~first | (F.col("artifact_id").isNull()))
        .withColumn("receipt", F.when((a == 1) & first, F.lit("other").cast("binary")).otherwise(F.col("receipt")))
        .withColumn("receipt_sha256", F.when((a == 2) & first, zero).otherwise(F.col("receipt_sha256"))).withColumn("chain_sha256", F.when((a == 4) & first, zero).otherwise(F.col("chain_sha256")))
    )
    single = linked.groupBy("artifact_id").count().where("count = 1 and artifact_id % 8 = 3").select("artifact_id")  # nothing to lose there: they keep theirs
    kept = linked.join(single, "artifact_id", "left_semi")
    return store.verified_lineages(spoilt.union(kept.where(a == 3).select(*spoilt.columns)), claims)


# ---------------------------------------------------------------- evaluation

@query("""with x as (select o_orderkey, o_custkey c, case o_orderkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end budget from orders),
    r as (select budget, case when c % 4 = 0 then 'exact' when c % 4 < 3 then 'extractive' end fidelity, case when c % 4 = 3 then case when c % 8 = 3 then 'budget_unsatisfiable' else 'resource_exhausted' end end failure_code, c % 4 in (1, 2) over_budget, (c % 97)::double utilization, (c % 53)::double retention from x)
    select budget, count(*) fixtures, count(*) filter (where fidelity = 'exact') exact, count(*) filter (where fidelity = 'extractive') extractive, count(*) filter (where over_budget) over_budget, min(utilization) filter (where over_budget) min_utilization,
    quantile_disc(utilization, 0.5) filter (where over_budget) median_utilization, max(utilization) filter (where over_budget) max_utilization, quantile_disc(retention, 0.5) filter (where over_budget) median_retention,
    concat_ws(',', 'budget_unsatisfiable=' || nullif(count(*) filter (where failure_code = 'budget_unsatisfiable'), 0), 'resource_exhausted=' || nullif(count(*) filter (where failure_code = 'resource_exhausted'), 0)) failures from r group by budget""")
def budget_aggregate(spark, sf_dir):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("budget"), F.when(c % 4 == 0, "exact").when(c % 4 < 3, "extractive").alias("fidelity"),
        F.when(c % 4 == 3, F.when(c % 8 == 3, "budget_unsatisfiable").otherwise("resource_exhausted")).alias("failure_code"), (c % 4).isin(1, 2).alias("over_budget"), (c % 97).cast("double").alias("utilization"), (c % 53).cast("double").alias("retention"),
    )
    return evaluation.by_budget(rows)


@query("select o_orderpriority shape, count(*) total, count(*) filter (where o_custkey % 2 = 0) raw, count(*) filter (where o_custkey % 3 = 0) production from orders group by 1")
def shape_retention(spark, sf_dir):
    c = F.col("o_custkey")
    return evaluation.by_shape(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("shape"), (c % 2 == 0).alias("raw"), (c % 3 == 0).alias("production")))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by 1, 2")
def counts_by_pair(spark, sf_dir):
    return evaluation.count_by(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""with i as (select distinct o_orderkey // 3 as "case", case o_orderkey % 2 when 0 then 'raw' else 'production' end arm, o_orderpriority model from orders)
    select model, count(*) filter (where arm = 'raw') raw, count(*) filter (where arm = 'production') production, abs(count(*) filter (where arm = 'raw') - count(*) filter (where arm = 'production')) asymmetry from i group by 1""")
def model_balance(spark, sf_dir):
    k = F.col("o_orderkey")
    return evaluation.balance(table(spark, sf_dir, "orders").select(F.floor(k / 3).alias("case"), F.when(k % 2 == 0, "raw").otherwise("production").alias("arm"), F.col("o_orderpriority").alias("model")))


@query("""with r as (select case o_orderkey % 4 when 0 then 'unsupported' when 1 then 'invalid' else 'measured' end status, o_custkey % 5 <> 0 deterministic, o_custkey % 7 * 100 input_tokens, o_custkey % 7 visible_tokens, 2 p0d, o_custkey % 3 p0r, 0 p1d from orders),
    v as (select * from r where status = 'measured' and deterministic)
    select (select count(*) from r) total_cases, (select count(*) from r where status = 'measured') measured_cases, (select count(*) from r where status = 'unsupported') unsupported_cases, (select count(*) from r where status = 'invalid') invalid_cases,
    count(*) deterministic_cases, sum(p0d)::bigint p0_declared, sum(p0r)::bigint p0_recalled, sum(p1d)::bigint p1_declared, 0::bigint p1_recalled, quantile_disc(case when input_tokens > 0 then (input_tokens - visible_tokens)::double / input_tokens end, 0.5) median_reduction,
    sum(p0r)::double / sum(p0d) p0_recall, 1.0::double p1_recall from v""")
def case_aggregate(spark, sf_dir):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(k == 0, "unsupported").when(k == 1, "invalid").otherwise("measured").alias("status"), (c % 5 != 0).alias("deterministic"), (c % 7 * 100).alias("input_tokens"), (c % 7).alias("visible_tokens"),
        F.lit(2).alias("p0_declared"), (c % 3).alias("p0_recalled"), F.lit(0).alias("p1_declared"), F.lit(0).alias("p1_recalled"),
    )
    return evaluation.cases(rows)


@query(r"""with cut as (select doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') l from documents), flat as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 line_no from cut)
    select doc_id, sum(strlen(line))::bigint covered from flat where line_no % 2 = 0 group by 1""")
def covered_bytes(spark, sf_dir):
    from .operators import lines

    return evaluation.covered(lines.lines(table(spark, sf_dir, "documents")).where("line_no % 2 = 0"), "doc_id")


_BUDGETS = [("bytes-zero", 0, 0), ("bytes-2048", 2048, 128), ("tokens-512", 512, 64)]


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'bytes-zero' when 1 then 'bytes-2048' when 2 then 'tokens-512' else 'none' end budget, case o_orderkey % 4 when 0 then 0 when 1 then 1920 when 2 then 448 end::bigint payload, case when o_orderkey % 4 = 3 then 'invalid_request' end error_code from orders")
def fixture_budgets(spark, sf_dir):
    k = F.col("o_orderkey")
    budgets = spark.createDataFrame(_BUDGETS, "id string, total long, reserved long")
    out = corpus.with_budget(table(spark, sf_dir, "orders").select("o_orderkey", _turn([b[0] for b in _BUDGETS] + ["none"], k).alias("budget")), budgets)
    return out.select("o_orderkey", "budget", (F.col("total") - F.col("reserved")).alias("payload"), "error_code")


@query("select item_id id, doc_id fixture, contains(d.text, b.text) answerable from benchmark b join documents d on d.doc_id = b.item_id % 50")
def focus_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 50).alias("fixture"), F.lit("which").alias("focus"), F.col("text").alias("answer"))
    return corpus.with_fixture(asked, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"))).select("id", "fixture", "answerable")


@query(r"""select doc_id, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), 'the and', '<work>'), 'the ', '<home> '), '[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', 'dev@example.invalid', 'g'), '\bretion\b', 'user', 'g') text from documents
    where doc_id % 1 = 0 and not regexp_matches(coalesce(text, ''), '[A-Za-z0-9_-]*-retion|retion-|[^\x00-\x7F]retion|retion[^\x00-\x7F]')""")
def normalised_identities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~(F.col("text").contains("retion") & F.col("text").rlike(r"-retion|retion-|[^\x00-\x7F]retion|retion[^\x00-\x7F]")))
    return docs.select("doc_id", corpus.normalised(F.col("text"), {"the ": "<home> ", "the and": "<work>"}, user=("retion", "user")).alias("text"))


@query(f"""with b as (select doc_id, text, strlen(text) w, left(text, (select max(k) from range(0, 701) t(k) where strlen(left(text, k)) <= 700)) cut from documents where text is not null),
    e as (select *, case when contains(cut, chr(10)) then len(cut) - instr(reverse(cut), chr(10)) + 1 else 0 end line from b)
    select doc_id, w::bigint source_bytes, w > 700 truncated, case when w <= 700 then w when line > 1 then strlen(left(cut, line)) when strlen(cut) < 700 then strlen(cut) when ord(cut[-1]) < 128 then 699 else strlen(left(cut, len(cut) - 1)) end::bigint bytes from e""")
def bounded_fixtures(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", corpus.bounded(F.col("text").cast("binary"), 700).alias("b"))
    return rows.select("doc_id", "b.source_bytes", "b.truncated", F.octet_length("b.bytes").cast("long").alias("bytes"))


@query("select doc_id, left(text, 512) message from documents where text is not null")
def bounded_messages(spark, sf_dir):
    from .functions.text import bounded_chars

    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", bounded_chars(F.col("text"), envelope.MESSAGE_CHARS).alias("message"))


_LATEST = """with said as (select conv_id, turn * 10000 + conv_id % 7 ts, trim(text, ' ' || chr(10)) body from conversations where role = 'user'),
    last as (select conv_id, max(ts) ts, arg_max(left(body, (select max(k) from range(0, 257) t(k) where strlen(left(body, k)) <= 256)), ts) intent from said where body <> '' group by 1)
    select conv_id, intent, ts from last where 45000 - ts <= 43200"""


@query(_LATEST)
def session_intent_latest(spark, sf_dir):
    from .streaming import intent

    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("at", (F.col("turn") * 10000 + F.col("conv_id") % 7).cast("long"))
    return intent.latest(rows, "conv_id", "at", F.col("text"), 45000)


@query(f"select sha256(conv_id::varchar) digest, intent, ts from ({_LATEST})")
def session_records(spark, sf_dir):
    from .streaming import intent

    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("conv_id"), (F.col("turn") * 10000 + F.col("conv_id") % 7).cast("long").alias("at"), "text")
    return intent.records(rows, "conv_id", "at", F.col("text"), 45000)


@query("""select doc_id id, ['absent_fact', 'unknown_class', 'repeated_fact', 'unknown_budget'][(doc_id % 5)::bigint] problem from documents where doc_id % 5 <> 0 and text is not null""")
def fixture_validation(spark, sf_dir):
    """Fixtures of the documents, of each five one sound: its facts stand in its text, its budget is known."""
    k = F.col("doc_id") % 5
    fact = lambda i, c, n: F.struct(F.lit(i).alias("id"), F.lit(c).alias("class"), n.alias("needle"))
    head, none = F.substring("text", 1, 5), F.lit("\u0001 never there")
    facts = F.when(k == 1, F.array(fact("f", "P0", head), fact("g", "P1", none))).when(k == 2, F.array(fact("f", "P7", head))).when(k == 3, F.array(fact("f", "P0", head), fact("f", "P1", head))).otherwise(F.array(fact("f", "P0", head)))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), facts.alias("facts"), F.when(k == 4, "none").otherwise("bytes-2048").alias("budget"), F.array(F.lit("bytes-2048")).alias("budgets"))
    return corpus.invalid(rows)


@query("""select doc_id, case doc_id % 4 when 0 then sha256(text) when 1 then sha256(text) when 2 then sha256(left('ab' || repeat('xyz', 40), (2 + doc_id % 50)::int)) end sha from documents where text is not null""")
def payloads(spark, sf_dir):
    """Payloads as text, as base64, as padding, and base64 that isn't canonical (nothing)."""
    k, text, no = F.col("doc_id") % 4, F.col("text"), F.lit(None).cast("string")
    told = F.struct(
        F.when(k == 0, "utf8").when(k == 2, "padded").otherwise("base64").alias("kind"), F.when(k == 0, text).when(k == 2, "ab").alias("text"), F.when(k == 1, F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit(""))).when(k == 3, F.concat(F.base64(F.lit("a").cast("binary")), F.lit("x"))).otherwise(no).alias("base64"),
        F.when(k == 2, "xyz").alias("fill"), F.when(k == 2, 2 + F.col("doc_id") % 50).cast("long").alias("length"),
    )
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(corpus.materialised(told), 256).alias("sha"))


# ---------------------------------------------------------------- requests that run

_HELD = '"source":{"kind":"artifact","artifact":{"schema_version":"@schema","id":"@id","source_sha256":"@sha","source_bytes":@bytes,"created_at":@made,"expires_at":@until}@more}'


def _asks(total: int = LIMIT, reserved: int = 0, schema: str = "artifact/v3", more: str = "", source: str = _HELD, made: str = "@made", **options) -> str:
    budget = options.pop("budget", f'"budget":{{"unit":"bytes","total_visible_limit":{total},"reserved_envelope":{reserved}}}')
    return _request(source.replace("@schema", schema).replace("@more", more).replace("@made", made), budget=budget, profile='"api-json/v1"', **{"more": options.pop("extra", ""), **options})


#: Request line (~ the row's key, @ what is said of the artifact), the code it fails with whatever the artifact, and which text it shows.
ASKED = [
    (_asks(), None, "whole"), (_asks(), None, "whole"), (_asks(), None, "whole"), (_asks(extra=',"focus":"qqzzqq zzxxyyq"'), None, "whole"), (_asks(16 << 20), None, "all"),
    (_asks(source='"source":{"kind":"inline","bytes":"@text"}'), None, "inline"), (_asks(100, 100), "budget_unsatisfiable", "late"), (_asks(version='"v1"'), "schema_unsupported", ""),
    (_asks(source='"source":{"kind":"socket"}'), "source_unsupported", ""), (_asks(budget='"budget":{"unit":"tokens","total_visible_limit":9,"reserved_envelope":0,"token_profile":"other"}'), "token_profile_unsupported", ""),
    (_asks(schema="artifact/v1"), "artifact_schema_unsupported", ""), (_asks(source='"source":{"kind":"file","root_id":"repo","relative_path":"YQ==","binary_policy":"accept"}'), "unsafe_root", ""), (_asks(made="7"), "artifact_corrupt", "late"),
    (_asks(600, more=',"selector":{"kind":"lines","start_line":2,"line_count":8}'), None, "lines"), (_asks(extra=',"surprise":1'), "invalid_request", ""), ('{"contract_version":"v3"', "invalid_request", ""),
    (_asks(more=',"selector":{"kind":"lines","start_line":0,"line_count":8}'), "invalid_request", ""),
]
#: Every third order asks for this document, the others for one each.
_OF = "case when o_orderkey % 3 = 0 then 7 else o_custkey % (select count(*) from documents) end"
_STORED = f"""stored as (select doc_id, text, substr(sha256(doc_id::varchar || ':' || sha256(text)), 1, 32) id, strlen(text) w, sha256(text) sha, ({NOW} - 200000 + doc_id * 777 % 800000)::bigint expires_at,
    case when doc_id % 17 = 11 then case when doc_id % 2 = 0 then 'artifact_expired' else 'artifact_unknown' end when doc_id % 19 = 13 then 'artifact_schema_unsupported'
    when {NOW} - 200000 + doc_id * 777 % 800000 <= {NOW} then 'artifact_expired' when doc_id % 13 = 6 then 'artifact_corrupt' end unfit, doc_id % 11 = 5 part from documents where text is not null)"""


def _stored(spark, sf_dir) -> DataFrame:
    raw = F.col("text").cast("binary")
    return store.digested(table(spark, sf_dir, "documents"), keep=("text",)).select(
        "doc_id", "text", "id", "source_sha256", "source_bytes", F.lit(NOW - 400_000).cast("long").alias("created_at"), (F.lit(NOW) - 200_000 + F.col("doc_id") * 777 % 800_000).cast("long").alias("expires_at"),
        F.when(F.col("doc_id") % 19 == 13, 9).otherwise(3).alias("schema_version"), F.when(F.col("doc_id") % 11 == 5, "partial").otherwise("complete").alias("state"),
        F.when(F.col("doc_id") % 13 == 6, F.concat(raw, F.lit(b"!"))).otherwise(raw).alias("source"),
    )


def _asked(spark, sf_dir, stored: DataFrame) -> DataFrame:
    number = table(spark, sf_dir, "documents").count()
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 == 0, 7).otherwise(F.col("o_custkey") % number).alias("doc_id"))
    # Dealt anew after the join: a third of the orders meet at one document.
    met = orders.join(stored.select("doc_id", "id", "source_sha256", "source_bytes", "created_at", "expires_at"), "doc_id").repartition("o_orderkey")
    line = F.replace(_turn([a[0] for a in ASKED], key), F.lit("~"), key.cast("string"))
    for sign, column in (("@id", "id"), ("@sha", "source_sha256"), ("@bytes", "source_bytes"), ("@made", "created_at"), ("@until", "expires_at")):
        line = F.replace(line, F.lit(sign), F.col(column).cast("string"))
    brings = F.lit(False)  # requests that bring their text: only these meet it
    for i, a in enumerate(ASKED):
        brings |= (key % len(ASKED) == i) if "@text" in a[0] else F.lit(False)
    texts = stored.select("doc_id", F.replace(F.base64("text"), F.lit("\r\n"), F.lit("")).alias("raw"))
    inline = met.where(brings).select("o_orderkey", "doc_id", line.alias("line")).join(texts, "doc_id")
    return met.where(~brings).select("o_orderkey", line.alias("value")).union(inline.select("o_orderkey", F.replace("line", F.lit("@text"), F.col("raw")).alias("value")))


_PARTS = re.sub(r"\b(sized|grown|ended|told|kept)\b", r"\g<1>_part", _head_tail(_PART, 600))


@query(f"""with recursive {_head_tail(_WHOLE, LIMIT)}, {_PARTS}, {_STORED},
    asked as (select o_orderkey, {_in_turn([a[1] for a in ASKED], 'o_orderkey')} fixed, {_in_turn([a[2] for a in ASKED], 'o_orderkey')} shows, {_OF} doc_id from orders),
    known as (select *, case when shows = '' then fixed when shows = 'inline' then null else coalesce(unfit, case when fixed = 'artifact_corrupt' then fixed end, case when part then 'acquisition_failed' end, case when w > 0 then fixed end) end code
              from asked join stored using (doc_id)),
    shown as (select k.*, case shows when 'all' then text when 'lines' then coalesce(p.kept_part, '') when 'late' then '' else h.kept end visible from known k left join kept h using (doc_id) left join kept_part p using (doc_id))
    select o_orderkey, case when fixed = 'invalid_request' and shows = '' and o_orderkey % {len(ASKED)} = {len(ASKED) - 2} then null else 'r' || o_orderkey end request_id, code error_code,
        case when code is null then 0 when code = 'budget_unsatisfiable' then 3 when code in ('artifact_unknown', 'artifact_expired', 'artifact_corrupt', 'artifact_schema_unsupported') then 4 when code = 'acquisition_failed' then 6 else 2 end exit_code,
        case when code is null or code = 'budget_unsatisfiable' then case when shows = 'inline' then substr(sha256('r' || o_orderkey || ':' || sha), 1, 32) else id end end artifact_id,
        case when code is null then case when shows <> 'lines' and visible = text then 'exact' else 'extractive' end end fidelity, case when code is null then w end::bigint original_count,
        case when code is null then strlen(visible) end::bigint visible_count, case when code is null then visible end visible, case when code is null then true end receipt_sound,
        case when code is null then case when shows = 'inline' then 'inline' else 'artifact' end end source_variant, code is null and shows <> 'inline' replays from shown""")
def handled_requests(spark, sf_dir):
    """Requests of every kind, a third of them for one artifact, run against stored documents some of which are expired, corrupt, partial or gone."""
    stored = _stored(spark, sf_dir)
    gone = F.col("doc_id") % 17 == 11
    dead = stored.where(gone & (F.col("doc_id") % 2 == 0)).select("id", F.lit(NOW + 1).alias("purge_at"))
    out = handling.handled(_asked(spark, sf_dir, stored), stored.where(~gone), dead, NOW, key="o_orderkey").withColumn("r", F.from_json("receipt", store.RECEIPT))
    r = F.col("r")  # read once, looked at by many rules
    sound = F.when(F.col("receipt").isNotNull(), store.receipt_sound(r, F.col("artifact")))
    told = lambda path: F.get_json_object("envelope", path)
    return out.select("o_orderkey", "request_id", "error_code", "exit_code", F.col("artifact.id").alias("artifact_id"), "fidelity", "original_count", "visible_count", "visible", sound.alias("receipt_sound"), told("$.source.variant").alias("source_variant"), F.coalesce(r["acquisition"]["variant"] == "artifact", F.lit(False)).alias("replays"))
