"""DuckDB SQL of the queries that SQL can express."""

TOPK = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id query_id, e from v where vec_id % 50 = 0),
s as (select query_id, vec_id, cast(list_dot_product(q.e, v.e) as bigint) score from q join v on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
select query_id, cast(k as integer) "rank", vec_id, score from r where k <= 5"""

NGRAM_JOIN = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
n as (select doc_id, len(s) n from l), t as (select doc_id, unnest(s) s from l),
c as (select a.doc_id a, b.doc_id b, count(*) shared from t a join t b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
k as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r(a, b) as (select doc_id, doc_id from n union select r.a, k.b from r join k on k.a = r.b)
select a doc_id, n n_shingles, component_id from (select a, min(b) component_id from r group by 1) join n on doc_id = a"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((n >> {0}) & 31 as integer) + 1, 1)"
_CHARS = " || ".join(_DIGIT.format(x) for x in (15, 10, 5, 0))
WARC = f"""with p as (select page_id, coalesce(html, '') h from pages), d as (select page_id, octet_length(encode(h)) bytes, sha1(h) x, h from p),
g as (select page_id, i, cast('0x' || substr(x, i * 5 + 1, 5) as bigint) n from d, range(8) t(i)), b as (select page_id, string_agg({_CHARS}, '' order by i) digest from g group by 1),
f as (select x, min(page_id) f from d group by 1)
select page_id, cast(bytes as bigint) payload_bytes, digest payload_digest, case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from d join b using (page_id) join f using (x)"""

SQL = {"op1_topk": TOPK, "op6_ngram_join": NGRAM_JOIN, "op9_warc": WARC}
