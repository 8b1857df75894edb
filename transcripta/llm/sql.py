"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, warc_fixity

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with docs as (select doc_id, {_WORDS} w from documents),
items as (select item_id::varchar item, {_WORDS} w from benchmark where item_id is not null),
item_windows as (select distinct item, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from items where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from docs, sizes where len(w) >= n)),
met as (select doc_id, i, d.n, item from doc_windows d join item_windows using (n, win)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from met) group by 1),
found as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from met group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join hit using (doc_id) left join found using (doc_id)"""

JACCARD = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
grams as materialized (select distinct doc_id, md5_number(array_to_string(w[i : i + 3], ' ')) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from docs where len(w) > 0)),
sizes as materialized (select doc_id, count(*) n from grams group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * common >= 85 * (x.n + y.n - common)),
edges as materialized (select a, b from links union select b, a from links),
reach as (select doc_id x, doc_id y from docs union select r.x, e.b from reach r join edges e on r.y = e.a)
select d.doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(y)::bigint component_id from docs d left join sizes s on d.doc_id = s.doc_id join reach on x = d.doc_id group by 1"""


def fixity() -> str:
    fixed = "octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' || size || chr(13) || chr(10) || chr(13) || chr(10))) + size + 4"
    drawn = {k: f"substr(md5(page_id || ':{k}'), 1, 2) = '00'" for k in ("lost", "rot", "more")}
    return f"""
with p as (select coalesce(page_id::varchar, '') page_id, coalesce(url, '') url, octet_length(encode(coalesce(html, ''))) size, html from pages),
a as (select page_id, url, {fixed} length, case when {drawn["lost"]} then 'missing' when {drawn["rot"]} and coalesce(substr(html, 1, 1), '') <> '~' then 'changed' end status from p),
keys as (select page_id, url, length, status from a union all select page_id, url || '?more', null, 'extra' from p where {drawn["more"]} and not ({drawn["lost"]})),
counted as (select greatest(1, ceil(greatest((select count(*) from p), (select count(*) from p where not ({drawn["lost"]})) + (select count(*) from p where {drawn["more"]} and not ({drawn["lost"]}))) / {warc_fixity.SHARD_RECORDS}))::bigint shards),
placed as (select *, (('0x' || substr(md5(page_id || ' ' || url), 1, 8))::bigint % shards)::int shard from keys, counted),
offsets as (select *, sum(coalesce(length, 0)) over (partition by shard order by page_id, url rows unbounded preceding) - coalesce(length, 0) o from placed)
select shard, page_id, url, case when length is not null then o end::bigint "offset", length::bigint length, status from offsets where status is not null"""


TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
  where embedding is not null and vec_id is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


COPIES = f"""
with t as (select doc_id, {_LOWERED} n from documents)
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(n) text_sha256 from t window g as (partition by n)"""

#: CRC-32 by its byte table, which follows from the polynomial.
_CRC_TABLE = "crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i)) t)"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


TRIE = rf"""
with {_CRC_TABLE},
turns as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) p,
  coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
convs as (select distinct c, c - c % 20 b, {_crc("list_transform(string_split(c::varchar, ''), lambda y: ord(y)::bigint)")} % 4 h from turns, crc),
rebuilt as (select c.c, row_number() over (partition by c.c order by not t.head, t.p) d, r, x from convs c join (select *, unnest([true, false]) head from turns) t on t.head and t.c = c.b and t.p <= c.h or not t.head and t.c = c.c and t.p > c.h),
hashed as (select c, d, x, md5(r || chr(1) || md5(x)) t from rebuilt),
path as (select c, 0 d, '' k, null x from convs union all select c, d, string_agg(t, '') over (partition by c order by d) k, x from hashed),
length as (select c, max(d) len from path group by 1),
node as (select d, k, min(c) conv_id, count(*) n, any_value(x) x, string_agg(case when d = len then c::varchar end, ',' order by c) ends from path join length using (c) group by 1, 2),
own as (select d, k, conv_id, n, coalesce(ends, '') ends, case when d > 0 then (n - 1) * len(regexp_extract_all(x, '[^ 	-
]+')) else 0 end saved, not exists (select 1 from node m where m.d = node.d + 1 and m.k[: 32 * node.d] = node.k) leaf from node)
select v.conv_id::bigint conv_id, v.d::bigint depth, any_value(w.conv_id)::bigint parent_conv_id, any_value(v.n)::bigint n_convs, (count(*) filter (u.d = v.d + 1))::bigint n_children,
  (count(*) filter (u.leaf))::bigint n_leaves, sum(u.saved)::bigint saved_tokens, sha256(any_value(v.ends)) ends_sha256
from own v join own u on u.d >= v.d and u.k[: 32 * v.d] = v.k left join own w on w.d = v.d - 1 and w.k = v.k[: 32 * w.d] group by v.conv_id, v.d"""

_CODE = "ord(y)::bigint"
_UTF8 = f"flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda y: case when {_CODE} < 128 then [{_CODE}] else [192 | ({_CODE} >> 6), 128 | ({_CODE} & 63)] end))"

SPELLING = rf"""
with recursive {_CRC_TABLE},
runs as (select doc_id, w, count(*) n from (select coalesce(doc_id::varchar, '') doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) w from documents) where length(w) > 6 group by 1, 2),
drawn as (select w, n, {_crc(_UTF8)} h from runs, crc),
words as materialized (select word, sum(n)::bigint n from (select case when h % 31 = 0 then w[: h % length(w)] || w[h % length(w) + 2 :] else w end word, n from drawn) where length(word) > 6 group by 1 having sum(n) > 1),
cut as materialized (select word, n, i, word[: i - 1] || word[i + 1 :] short from words, range(1, 200) r(i) where i <= length(word)),
one as (select distinct a.word a, a.n an, b.word b, b.n bn from cut a join words b on a.short = b.word),
near as materialized (select a.word, a.n, b.word near, b.n near_n from cut a join cut b on a.i = b.i and a.short = b.short and a.word <> b.word
  union select a, an, b, bn from one union select b, bn, a, an from one),
counts as (select word, count(*) n_near from near group by 1),
forms as materialized (select word, near form, near_n form_n from (select *, row_number() over (partition by word order by near_n desc, encode(near)) k from near) where k = 1 and near_n >= 10 * n),
chain as (select word, form step, 1 k from forms union all select chain.word, forms.form, k + 1 from chain join forms on chain.step = forms.word),
roots as (select word, arg_max(step, k) root from chain group by 1)
select word, n, coalesce(n_near, 0)::bigint n_near, form, form_n, coalesce(root, word) root from words left join counts using (word) left join forms using (word) left join roots using (word)"""


def oracles() -> dict[str, str]:
    return {
        "op1_decontamination": DECONTAMINATION,
        "op4_source_mixing": mixing.oracle_sql(),
        "op5_ngram_jaccard_join": JACCARD,
        "op8_warc_fixity": fixity(),
        "op10_exact_topk": TOPK,
        "op11_exact_dedup": COPIES,
        "op12_prefix_trie": TRIE,
        "op13_spelling_variants": SPELLING,
    }
