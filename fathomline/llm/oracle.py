"""DuckDB SQL of the problems' queries that SQL can express over whole tables."""

from __future__ import annotations

#: A character other than Unicode white space.
_VISIBLE = r"[^\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLEAN = "nullif(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"

P2_FOUND = f"""
with tags as (select filepath, {_CLEAN.format('t')} as t from (select filepath, unnest(meta) as t from embed_sources)),
kv as (select filepath, regexp_extract(t, '^-*\\s*(lang|language|domain)\\s*[:=/](.*)$', 1) as k, {_CLEAN.format("regexp_extract(t, '^-*\\s*(lang|language|domain)\\s*[:=/](.*)$', 2)")} as v from tags),
langs as (select filepath, min(n.lang) as lang from kv join lang_names n on n.alias = kv.v where k in ('lang', 'language') group by 1),
domains as (select filepath, min(v) as domain from kv where k = 'domain' group by 1),
d as (select doc_id, filepath, coalesce({_CLEAN.format('source')}, split_part(filepath, '/', 1)) as source, {_CLEAN.format('lang')} as alias
  from documents where regexp_matches(text, '{_VISIBLE}'))
select doc_id, source, coalesce(case when d.alias is not null then n.lang else l.lang end, 'und') as lang, coalesce(domain, 'none') as domain
from d left join lang_names n on n.alias = d.alias left join langs l using (filepath) left join domains using (filepath)"""

P4_FOUND = """
with i as (select 'function' as item_kind, def_id as item_id, filepath, begin_pos as b, end_pos as e from function_defs
  union select 'source', source_id, filepath, subset.start_pos, subset.end_pos from embed_sources),
c as (select item_kind, item_id, greatest(coalesce(b, 0), 0) as b, least(coalesce(e, strlen(text)), strlen(text)) as e
  from i join documents using (filepath) where text is not null)
select distinct item_kind, item_id from c where e - b > 8192"""

_UNIT = """v as (select distinct id, data::double[] as x from vectors where len(data) = 64 and len(list_filter(data, lambda y: y is null or isnan(y) or isinf(y))) = 0),
u as (select id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) as x from v where list_dot_product(x, x) > 0)"""

_NEAREST = f"""{_UNIT},
w as (select distinct query_id as id, embedding::double[] as x from query_log where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
q as (select id, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) as x from w where list_dot_product(x, x) > 0),
s as (select 0 as kind, a.id, b.id as neighbour, round(list_dot_product(a.x, b.x), 6) as sim from u a join u b on a.id <> b.id
  union all select 1, q.id, u.id, round(list_dot_product(q.x, u.x), 6) from q, u),
r as (select *, row_number() over (partition by kind, id order by sim desc, neighbour) as r from s where sim >= 0.85),
n as (select * from r where r <= 5)"""

P6_NEAREST = f"with {_NEAREST} select kind, id, r::int as rank, neighbour, sim from n"
P6_FOUND = f"""with {_NEAREST} select distinct case kind when 0 then 'vector' else 'query' end as probe_kind,
case kind when 0 then least(id, neighbour) else id end as id_a, case kind when 0 then greatest(id, neighbour) else neighbour end as id_b from n"""

P1_FOUND = f"""with {_UNIT},
p as (select a.id as a, b.id as b from u a join u b on a.id = b.id or round(list_dot_product(a.x, b.x), 6) >= 0.85),
h as (select a, list(b order by b) as hood from p group by a),
g as (select hood, min(a) as cluster_id, count(*) as n from h group by hood having count(*) = len(hood) and count(*) >= 3)
select cluster_id, a as id from h join g using (hood) where a > cluster_id"""

P7_TEXTS = "select doc_id, coalesce(text, '') as text from documents"

ORACLE = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p6_nearest": P6_NEAREST, "p7_texts": P7_TEXTS}
