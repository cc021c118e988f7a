"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, html_extract, importance, language_id, minhash_dedup, mixing, secrets, substring_dedup, suffix_dedup, token_codes, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_runs(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encode_table(table(spark, sf_dir, "documents"), vocabulary())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # a null id has no remainder
    model = language_id.train(docs.where(~held))
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digests(spark, chat_format.formatted(rows))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_embedding_dedup, op3_token_codes, op4_language_id, op5_chat_format, op6_suffix_dedup, op7_mixing, op8_html_extraction, op9_minhash_dedup, op10_decontamination, op11_secret_scans, op12_importance_resampling, op13_embedding_whitening)}

ORACLES = {
    "op1_substring_dedup": r"""
        with cut as (
          select doc_id, regexp_extract_all(text, '(?s)(?:[^\n.!?,;:]|[.!?,;:]+[^\n.!?,;: \t\r\f\x0B])*(?:[.!?,;:]+|\n)?') l from documents),
        pieces as (select doc_id, unnest(l) piece, generate_subscripts(l, 1) no from cut),
        placed as (select *, coalesce(sum(len(piece)) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) ahead from pieces),
        stripped as (select doc_id, no, piece, ahead + len(piece) - len(ltrim(piece, E' \t\r\f\x0B\n')) "start", trim(piece, E' \t\r\f\x0B\n') body from placed),
        units as (select doc_id, "start", "start" + len(body) "end", row_number() over (partition by doc_id order by no) - 1 unit,
                  list_filter(regexp_split_to_array(lower(body), '[ \t\r\f\x0B]+'), lambda x: x <> '') w from stripped where body <> ''),
        firsts as (select *, min(struct_pack(d := doc_id, u := unit)) over (partition by w) f from units),
        again as (select *, unit - row_number() over (partition by doc_id order by unit) run from firsts where doc_id <> f.d or unit <> f.u),
        weighed as (select *, sum(greatest(len(w), ("end" - "start") // 8)) over (partition by doc_id, run) run_weight from again)
        select doc_id, unit::int unit, "start"::int "start", "end"::int "end", len(w)::int n_words, run_weight::bigint run_weight, f.d first_doc_id, f.u::int first_unit
        from weighed where run_weight >= 35""",
    "op2_embedding_dedup": """
        with recursive v as (
          select vec_id, embedding::double[] e from embeddings
          where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (select a.vec_id u, b.vec_id v from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
                  where list_cosine_similarity(a.e, b.e) >= 0.95),
        reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
        near as (select u, count(*) n from links group by u),
        low as (select u, min(v) c from reach group by u),
        told as (select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(c, vec_id)) component_id
                 from embeddings left join near on vec_id = near.u left join low on vec_id = low.u)
        select *, vec_id = component_id kept from told""",
    "op7_mixing": r"""
        with sized as (
          select doc_id, source, md5(coalesce(doc_id::varchar, 'null')) turn,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
        sources as (select source, sum(size)::bigint source_size from sized group by source),
        placed as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint]::double weight,
                   2.0::double * source_size cap, 1.5::double * (select sum(source_size) from sources) whole from sources),
        ranked as (select *, row_number() over (order by cap / weight, source is null, encode(source)) r from placed),
        levels as (select *, (whole - coalesce(sum(cap) over (order by r rows between unbounded preceding and 1 preceding), 0))
                   / sum(weight) over (order by r rows between current row and unbounded following) lv from ranked),
        targets as (select source, source_size, least(cap, (select max(lv) from levels where cap >= lv * weight) * weight) target from levels),
        queued as (select s.*, t.source_size, t.target,
                   sum(size) over (partition by s.source order by turn, s.doc_id rows unbounded preceding) run
                   from sized s join targets t on s.source is not distinct from t.source),
        copies as (select q.doc_id, turn, size, (e * source_size + run)::double / target finish
                   from queued q, (values (0), (1)) x(e) where size > 0 and target > 0),
        summed as (select *, sum(size) over (order by finish, turn, doc_id rows unbounded preceding) run from copies),
        picked as (select doc_id, sum(size)::bigint taken from summed
                   where run <= floor(1.5 * (select sum(size) from sized)) group by doc_id)
        select q.doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from queued q left join picked p using (doc_id)""",
    "op11_secret_scans": r"""
        with docs as (select row_number() over () no, doc_id, coalesce(text, '') text from documents),
        kinds(kind, name, tile) as (values
          (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
          (1, 'access', 'AKIA[A-Z0-9]+'),
          (2, 'hex', '[0-9a-f]+'),
          (3, 'login', '(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy](?:_?[Ii][Dd])?|[Kk][Ee][Yy]_?[Ii][Dd])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._+/=-]{3,}'),
          (4, 'email', '[A-Za-z0-9._%+@-]+'),
          (5, 'opaque', '[A-Za-z0-9+/_-]{20,}'),
          (6, 'endpoint', '[A-Za-z]+(?:://[^\x00-\x20"''<>]+)?'),
          (7, 'blank', '\n[\x20\t\r]*\n')),
        cut as (select no, kind, name, tile, regexp_extract_all(text, '(?s)(?:' || tile || ')|.') l from docs, kinds where regexp_matches(text, tile)),
        tiles as (select no, kind, name, tile, unnest(l) piece, generate_subscripts(l, 1) place from cut),
        placed as (select *, sum(len(piece)) over (partition by no, kind order by place) "end" from tiles),
        spans as (
          select no, kind, name, "end" - len(piece) "start", "end" from placed
          where len(piece) > 1 and case kind
            when 0 then len(regexp_extract(piece, '^(?:[A-Za-z]+_?[A-Za-z]+)["'']?\x20*[:=]\x20*["'']?(.+)$', 1)) >= 6 when 1 then len(piece) >= 20 when 2 then len(piece) >= 24
            when 4 then regexp_full_match(piece, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+')
            when 5 then regexp_matches(piece, '[a-z]') and regexp_matches(piece, '[A-Z]') and regexp_matches(piece, '[0-9]')
            when 6 then regexp_matches(piece, '^[A-Za-z]{1,16}://') else true end),
        scoped as (select s.*, (select count(*) from spans b where b.no = s.no and b.kind = 7 and b."start" <= s."start") scope from spans s),
        pairs as (
          select x.no, x.kind, x."start", x."end", y.kind other,
                 case when (y."start", y.kind, y."end") < (x."start", x.kind, x."end") then x."start" - y."end" else y."start" - x."end" end away
          from scoped x join scoped y on x.no = y.no and x.scope = y.scope and (x.kind, x."start") <> (y.kind, y."start") where x.kind between 3 and 6 and y.kind < 6),
        told as (
          select no, kind, "start", "end", bool_or(other in (1, 3, 4) and away <= 400) identified, bool_or(other in (0, 2, 5) and away <= 400) secret,
                 bool_or(other in (0, 1, 2) and away <= -1) covered from pairs group by all),
        linked as (select no, kind, "start", "end" from told where not covered and case when kind in (3, 4) then secret when kind = 5 then identified else identified and secret end),
        kept as (
          select no, kind, "start", "end" from spans where kind < 3 union all select * from linked),
        named as (select no, kind, "start", name || ':' || "start" || ':' || "end" t from kept join kinds using (kind)),
        summed as (
          select no, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
                 string_agg(t, ',' order by "start", kind) filter (kind < 3) base, string_agg(t, ',' order by "start", kind) spans from named group by no)
        select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
               sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from docs left join summed using (no)""",
    "op12_importance_resampling": r"""
        with crc_table as (
          select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) t),
        words as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        docs as (select doc_id, coalesce(w, []) w, row_number() over () no from words),
        goals as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) f from benchmark),
        pieces as (select no, unnest(w) f from docs),
        known as (select distinct f from (select f from pieces union all select f from goals)),
        hashed as (
          select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), 2 * i::int + 1, 2))::bigint)),
                    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 bucket from known, crc_table),
        sources as (select bucket, count(*) s from pieces join hashed using (f) group by bucket),
        targets as (select bucket, count(*) t from goals join hashed using (f) group by bucket),
        gains as (
          select f, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from sources) + 10000)::double
                 / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from targets) + 10000)::double)))::bigint gain
          from hashed left join sources using (bucket) left join targets using (bucket)),
        sums as (select no, sum(gain) total from pieces join gains using (f) group by no),
        weighed as (
          select doc_id, len(w)::bigint n_features, case when len(w) > 0 then floor(total / len(w)) else 0 end::bigint weight,
                 ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint h from docs left join sums using (no)),
        scores as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from weighed),
        placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) place, count(*) filter (n_features >= 20) over () n from scores)
        select doc_id, n_features, weight, score, case when n_features >= 20 and place <= (10 * n) // 100 then place end::bigint rank from placed""",
}
