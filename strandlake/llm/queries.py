"""The opN_ queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import encode
from .common import table
from .linedup import line_classes
from .licenses import licences
from .minhash import near_duplicates
from .packing import pack
from .quality import quality_scores
from .secretscan import ALLOWED, CLASSES, KINDS, WEIGHTS, WINDOW, find_secrets, joined, limit
from .spelling import spelling_groups
from .tokencount import token_counts
from .topk import top_k
from .trie import prefix_trie
from .warc import round_trip
from .winnow import fingerprints


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", " ").alias("licences"), F.col("n_found").cast("long"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), most=4096, end=1)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), k=12, w=32)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 stands for no line."""
    found = line_classes(table(spark, sf_dir, "documents"), num=4, den=5)
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("like_doc_id", "like_line")})


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), least=5, times=3, damage=97)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), branch=(5, 9))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_winnowing": op7_winnowing,
    "op8_token_counts": op8_token_counts,
    "op9_exact_topk": op9_exact_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Words as the operators have them, in SQL: A-Z lower-cased, between ASCII white space.
_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_SHINGLES = "case when len(w) < 4 then case when len(w) = 0 then [] else [array_to_string(w, ' ')] end else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end"
_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast(concat('0x', substr(h, cast(i * 5 + 1 as bigint), 5)) as int) >> b) & 31) + 1 as bigint), 1)), '')), '')"
#: A common table for _CRC: what CRC-32 does with each byte.
_CRC_TABLE = "crc_table as materialized (select list(c order by b) as crc_list from (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) as c from range(256) r(b)))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda p: cast('0x' || p as bigint))), lambda c, b: xor(c >> 8, crc_list[(xor(c, b) & 255) + 1])), 4294967295)"

#: Patterns of op12 in SQL, with both cases spelled out.
_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS = [_ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+", *(f"[{c}]+" for c, _ in CLASSES.values())]

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": (
        f"with recursive d as materialized (select doc_id, {_SHINGLES} as s from (select doc_id, {_WORDS.format('text')} as w from documents)), "
        "x as materialized (select doc_id, len(s) as n, unnest(s) as t from d), "
        "e as materialized (select a.doc_id as a, b.doc_id as b from x a join x b using (t) where a.doc_id <> b.doc_id group by 1, 2 having 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))), "
        "r(a, b) as (select a, a from e union select r.a, e.b from r join e on r.b = e.a), c as (select a, min(b) as c from r group by a) "
        "select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(c, doc_id) as component_id, coalesce(c, doc_id) = doc_id as kept from d left join c on doc_id = a"
    ),
    "op5_warc": (
        "with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as r from pages) "
        f"select page_id, cast(n as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = r then 'response' else 'revisit' end as record_type, case when page_id < r then r end as refers_to from p"
    ),
    "op9_exact_topk": (
        "with v as materialized (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as x from embeddings where vec_id is not null and embedding is not null "
        "and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
        "s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.r <> c.r and len(q.x) = len(c.x)) "
        "select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as int) as rank, vec_id, score from s qualify rank <= 20"
    ),
    "op10_line_dedup": (
        "with l as materialized (select doc_id, cast(i - 1 as int) as line, list_sort(list_distinct(w)) as s from "
        f"(select doc_id, i, {_WORDS.format('x')} as w from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)) where len(w) > 0), "
        "c as materialized (select s, min(struct_pack(d := doc_id, l := line)) as f, len(s) as n, row_number() over () as id from l group by s), "
        "p as (select id, n, unnest(s) as t from c), f as (select t, count(*) as df from p group by t), "
        # The rarest n - ceil(4 n / 5) + 1 words of a set of n: sets alike share one of them.
        "k as (select id, n, t from p join f using (t) qualify row_number() over (partition by id order by df, t) <= n - (4 * n + 4) // 5 + 1), "
        "q as (select distinct a.id as a, b.id as b from k a join k b using (t) where a.id <> b.id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)), "
        "m as (select q.a, x.f as mine, y.f as other, len(list_intersect(x.s, y.s)) as shared, x.n + y.n as total from q join c x on x.id = q.a join c y on y.id = q.b), "
        "g as (select a as id, count(*) as n_links, min(other) as o from m where 5 * shared >= 4 * (total - shared) group by a) "
        "select l.doc_id, l.line, c.f.d as class_doc_id, c.f.l as class_line, coalesce(n_links, 0) as n_links, coalesce(g.o.d, -1) as like_doc_id, coalesce(g.o.l, -1) as like_line, "
        "l.doc_id <> c.f.d or l.line <> c.f.l or coalesce(g.o < c.f, false) as removed from l join c using (s) left join g on g.id = c.id"
    ),
    "op11_spelling_variants": (
        f"with recursive {_CRC_TABLE}, r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents), "
        f"c as (select w, n, length(w) as l, {_CRC.format('concat(doc_id, chr(58), w)')} as h from (select doc_id, w, count(*) as n from r group by doc_id, w), crc_table), "
        "x as materialized (select w, cast(sum(n) as bigint) as n from (select case when h % 97 = 0 then concat(left(w, cast(h % l as bigint)), substr(w, cast(h % l + 2 as bigint))) else w end as w, n from c) where length(w) >= 5 group by w having sum(n) >= 3), "
        "i as materialized (select w, n, unnest(range(length(w))) as i from x), d as materialized (select w, n, i, left(w, i) as a, substr(w, i + 2) as b from i), "
        "p as (select d.w, e.w as o, e.n as m from d join d e using (i, a, b) where d.w <> e.w union select d.w, x.w, x.n from d join x on x.w = concat(a, b) union select x.w, d.w, d.n from d join x on x.w = concat(a, b)), "
        "g as (select w, count(*) as n_near from p group by w), "
        "b as (select w, o, m from p qualify row_number() over (partition by w order by m desc, o) = 1), "
        "f as materialized (select x.w, x.n, coalesce(n_near, 0) as n_near, case when b.m >= 2 * x.n then b.o end as form, case when b.m >= 2 * x.n then b.m end as form_n from x left join g using (w) left join b using (w)), "
        "t as (select w, w as root, form from f union all select t.w, f.w, f.form from t join f on f.w = t.form) "
        "select f.w as word, f.form, t.root, f.n, f.n_near, f.form_n from f join t on t.w = f.w and t.form is null"
    ),
    "op12_secret_scan": (
        "with d as materialized (select row_number() over () as id, doc_id, coalesce(text, '') as t from documents), "
        "m as (" + " union all ".join(f"select id, {k} as kind, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}') as f from d where regexp_matches(t, '{p}')" for k, p in enumerate(_SECRETS)) + "), "
        "p as (select id, kind, g, f, unnest(range(1, len(f) + 1)) as i from m), "
        "b as materialized (select id, kind, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as bigint) as a, f[i] as s from p "
        f"where case kind when 0 then length(regexp_extract(f[i], '{_ASSIGN}', 2)) >= 12 when 1 then length(f[i]) >= 18 when 2 then length(f[i]) >= 16 else length(f[i]) >= {WINDOW} end), "
        "c as (select id, kind, a, unnest(range(1, length(s) + 1)) as i, s from b where kind >= 3 " + " ".join(f"and not regexp_matches(s, '{p}')" for p in ALLOWED) + "), "
        # The sum over each window's characters of c * log2(c), from all counts anew.
        f"w as (select id, kind, a + i - 1 as a, a + i - 1 + {WINDOW} as e, list_sum(list_transform(map_values(histogram(h)), lambda n: {WEIGHTS}[cast(n as int) + 1])) as x from "
        f"(select id, kind, a, i, unnest(string_split(substr(s, i, {WINDOW}), '')) as h from c where i <= length(s) - {WINDOW} + 1) group by id, kind, a, i), "
        "h as (select id, kind, a, e, lag(e) over (partition by id, kind order by a) as before from w where x <= case kind " + " ".join(f"when {KINDS.index(k)} then {limit(bits)}" for k, (_, bits) in CLASSES.items()) + " end), "
        "i as (select id, kind, a, e, count(*) filter (before is null or a > before) over (partition by id, kind order by a) as n from h), "
        "s as (select id, kind, a, a + length(s) as e from b where kind < 3 union all select id, kind, min(a), max(e) from i group by id, kind, n), "
        f"j as (select id, kind, a, concat({KINDS}[kind + 1], ':', a, ':', e) as x from s) "
        "select any_value(doc_id) as doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, "
        "sha256(coalesce(string_agg(x, ',' order by a, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(x, ',' order by a, kind), '') as spans from d left join j using (id) group by id"
    ),
    "op13_prefix_trie": (
        f"with {_CRC_TABLE}, t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, "
        "row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 as i from conversations where conv_id is not null), "
        f"h as (select c, {_CRC.format('cast(c as varchar)')} % 9 as h from (select distinct c from t), crc_table), "
        "s as (select h.c, 0 as own, i, r, x from h join t on t.c = h.c - h.c % 5 and i < h union all select h.c, 1, i, r, x from h join t on t.c = h.c and i >= h), "
        "l as (select h.c, coalesce(list(struct_pack(r := r, x := x) order by own, i) filter (i is not null), []) as l from h left join s using (c) group by h.c), "
        "o as (select c, d, l[1:d] as p, d = len(l) as e, case when d > 0 then octet_length(encode(l[d].x)) else 0 end as b from (select c, l, unnest(range(len(l) + 1)) as d from l)), "
        "n as materialized (select d, p, min(c) as c, count(*) as n, any_value(b) as b, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (e), '') as ends, count(*) filter (e) = count(*) as leaf from o group by d, p), "
        "u as (select d.d, d.p, count(*) filter (x.d = d.d + 1) as n_children, count(*) filter (x.leaf) as n_leaves, sum((x.n - 1) * x.b) as saved from n d join n x on x.d >= d.d and x.p[1:d.d] = d.p group by d.d, d.p) "
        "select n.c as conv_id, n.d as depth, a.c as parent_conv_id, n.n as n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256 "
        "from n join u on u.d = n.d and u.p = n.p left join n a on a.d = n.d - 1 and a.p = n.p[1:n.d - 1]"
    ),
}
