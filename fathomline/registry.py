"""Queries of the core operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.engine import Engine
from fathomline.functions import messages, texts
from fathomline.functions import vectors as vec
from fathomline.operators import catalog, chunks, graph, search, store, worklist
from fathomline.operators.embed import HashEmbedder, embed
from fathomline.plans.rules import parse_rules, with_rules
from fathomline.session import shared_folder
from fathomline.sources import blocks, files
from fathomline.streaming import edits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if SQL can express it over whole tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


K = 10
DIM = 64
#: Cells looked at, and tables and bits of signatures: the vectors of the test table point in all directions, so many are
#: needed for a recall of 0.9 (the tests measure it).
PROBES, TABLES, BITS = 8, 16, 4

# Vectors: the table embeddings, the vector of the smallest id as the query.


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("data"), F.array(F.col("label").cast("string")).alias("meta"), "label")


def first_vector(df: DataFrame) -> list[float]:
    return df.orderBy("id").limit(1).collect()[0]["data"]


_SQL_E = "e as (select vec_id as id, embedding::double[] as data, label from embeddings)"
_SQL_Q = "q as (select data as qv from e order by id limit 1)"


@query(f"with {_SQL_E}, {_SQL_Q} select id, round(1 - list_dot_product(data, qv), 6) + 0.0 as distance from e, q order by round(1 - list_dot_product(data, qv), 12), id limit {K}")
def search_exact(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return search.search(e, first_vector(e), K).select("id", rounded("distance").alias("distance"))


@query(f"with {_SQL_E}, {_SQL_Q} select id, round(1 - list_dot_product(data, qv), 6) + 0.0 as distance from e, q where label = 3 order by round(1 - list_dot_product(data, qv), 12), id limit {K}")
def search_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return search.search(e, first_vector(e), K, ["eq 3"]).select("id", rounded("distance").alias("distance"))


@query(f"with {_SQL_E}, {_SQL_Q} select id, round(1 - list_dot_product(data, qv), 6) + 0.0 as distance from e, q where label not in (0, 1) order by round(1 - list_dot_product(data, qv), 12), id limit {K}")
def search_filter_ne(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return search.search(e, first_vector(e), K, ["ne 0", "ne 1"]).select("id", rounded("distance").alias("distance"))


@query(f"""with v as (select id, any_value(meta) as meta, any_value(data)::double[] as data from vectors group by id),
u as (select * from v where len(data) = {DIM}), q as (select data as qv from u order by id limit 1),
s as (select id, 1 - list_dot_product(data, qv) as x from u, q where list_contains(meta, 'rust') and not list_contains(meta, 'mosswick-core'))
select id, round(x, 6) + 0.0 as distance from s where x is not null and not isnan(x) order by round(x, 12), id limit {K}""")
def search_filter_has(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").groupBy("id").agg(F.any_value("meta").alias("meta"), F.any_value("data").alias("data"))
    q = first_vector(v.where(F.size("data") == DIM))
    found = search.search(v.where(F.size("data") == DIM), q, K, ["has rust", "hasnot mosswick-core"])
    return found.select("id", rounded("distance").alias("distance"))


@query("select vec_id as id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select("id", F.round(vec.norm(F.col("data")), 6).alias("norm"))


_SQL_UNIT = "with n as (select vec_id as id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings)"


@query(f"{_SQL_UNIT} select id, (generate_subscripts(e, 1) - 1)::int as pos, round(unnest(e) / norm, 6) + 0.0 as x from n where norm > 0")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select("id", F.posexplode(vec.normalise(F.col("data"))).alias("pos", "x")).withColumn("x", rounded("x"))


@query(f"with {_SQL_E}, {_SQL_Q} select id, round(list_dot_product(data, qv), 6) + 0.0 as product from e, q")
def dot_product(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    q = F.lit([float(x) for x in first_vector(e)]).cast("array<double>")
    return e.select("id", rounded(vec.dot(F.col("data"), q)).alias("product"))


_SQL_KNN = f"""with {_SQL_E}, p as (select a.id as qid, b.id as id, round(1 - list_dot_product(a.data, b.data), 12) as x from e a, e b where a.id % 50 = 0),
r as (select *, row_number() over (partition by qid order by x, id) as r from p)
select qid, id, round(x, 6) + 0.0 as distance from r where r <= {K}"""


@query(_SQL_KNN)
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    return search.knn(q, e, K).withColumn("distance", rounded("distance"))


# Texts: splitters and filters over all documents.

_SQL_TEXT = "t as (select doc_id, filepath, replace(text, chr(13) || chr(10), chr(10)) as text from documents)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "filepath", "text")


def _sql_max_length(size: int) -> str:
    return f"""with {_SQL_TEXT}, s as (select doc_id, text, unnest(range(0, length(text), {size + 1})) as s from t where length(text) > 0)
select doc_id, s::bigint as "start", least(s + {size}, length(text))::bigint as "end", substring(text, (s + 1)::int, {size}) as chunk from s"""


@query(_sql_max_length(512))
def split_maxlength(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_max_length(documents(spark, d).drop("filepath"), 512)


@query(_sql_max_length(8192))
def split_naive(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_naive(documents(spark, d).drop("filepath"))


# Pieces between line ends, those above 8192 characters flushed with one character dropped.
_SQL_LINES = f"""{_SQL_TEXT}, l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as piece from t where text is not null),
o as (select doc_id, piece, coalesce(sum(length(piece) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as s from l),
c as (select doc_id, s, piece, unnest(range(0, greatest(length(piece), 1), 8193)) as f from o),
lines as (select doc_id, (s + f)::bigint as "start", (s + least(f + 8192, length(piece)))::bigint as "end", substring(piece, (f + 1)::int, 8192) as chunk from c)"""


@query(f"with {_SQL_LINES} select * from lines")
def split_separator(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_separator(documents(spark, d).drop("filepath"), "\n")


@query(f"""with {_SQL_TEXT}, l as (select doc_id, generate_subscripts(string_split(text, '. '), 1) as k, unnest(string_split(text, '. ')) as piece from t where text is not null),
o as (select doc_id, piece, coalesce(sum(length(piece) + 2) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as s from l),
c as (select doc_id, s, piece, unnest(range(0, greatest(length(piece), 1), 8194)) as f from o)
select doc_id, (s + f)::bigint as "start", (s + least(f + 8192, length(piece)))::bigint as "end", substring(piece, (f + 1)::int, 8192) as chunk from c""")
def split_separator_two(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_separator(documents(spark, d).drop("filepath"), ". ")


@query(f"""with {_SQL_LINES} select * from lines where chunk <> '' and "end" - "start" >= 20""")
def filter_minlength(spark: SparkSession, d: str) -> DataFrame:
    return chunks.keep_chunks(split_separator(spark, d), min_length=20)


@query(f"with {_SQL_LINES} select * from lines where chunk <> '' and regexp_matches(chunk, '[\\p{{L}}\\p{{N}}\\s]')")
def filter_alphanumeric(spark: SparkSession, d: str) -> DataFrame:
    return chunks.keep_chunks(split_separator(spark, d), alphanumeric=True)


@query(f"with {_SQL_LINES} select * from lines where chunk <> ''")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return chunks.keep_chunks(split_separator(spark, d))


@query(f"""with {_SQL_TEXT}, s as (select distinct source_id, filepath, subset.start_pos as b, subset.end_pos as e from embed_sources)
select source_id, case when b is null and e is null then text else substring(text, (coalesce(b, 0) + 1)::int, greatest(coalesce(e, length(text)) - coalesce(b, 0), 0)::int) end as chunk
from s join t using (filepath)""")
def subset_read(spark: SparkSession, d: str) -> DataFrame:
    """The engine's subsets are in code points; the table's bounds are taken as such here."""
    s = table(spark, d, "embed_sources").select("source_id", "filepath", F.col("subset.start_pos").alias("start"), F.col("subset.end_pos").alias("end")).distinct()
    return chunks.read_subset(s.join(documents(spark, d), "filepath")).select("source_id", "chunk")


@query()
def split_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of all code documents by a scanner for each language; SQL can't express it, see functions_listed."""
    code = table(spark, d, "documents").where("doc_kind = 'code'").select("doc_id", "filepath", "text")
    return chunks.split_functions(code).select("doc_id", "start", "end", "chunk")


_PACKED = f"""with {_SQL_LINES}, k as (select doc_id, list(strlen(chunk)::bigint order by "start", "end") as sizes from lines where chunk <> '' group by doc_id)
select doc_id, (1 + list_reduce(sizes, lambda a, n: case when a % 100000 + n >= 8192 and a > 0 then (a // 100000 + 1) * 100000 + least(n, 99999) else a + least(n, 99999) end, 0::bigint) // 100000)::bigint as n_batches from k"""


@query(_PACKED)
def batch_pack(spark: SparkSession, d: str) -> DataFrame:
    """Batches of each document's lines, packed up to 8192 bytes."""
    packed = chunks.batches(chunks.keep_chunks(split_separator(spark, d)), "doc_id", in_order=True)
    return packed.groupBy("doc_id").agg((F.max("batch_no") + 1).cast("bigint").alias("n_batches"))


RULES = parse_rules(
    """
    * --minlength 1 --maxlength 512 --alphanumeric true
    rs --code function
    md --split "\\n"
    txt --naive --minlength 20
    """
)
_SQL_EXT = "regexp_extract(filepath, '[^.]*$')"


@query(f"select doc_id, {_SQL_EXT} as extension from documents")
def extension_of(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", texts.extension(F.col("filepath")).alias("extension"))


@query(f"""select doc_id, case {_SQL_EXT} when 'rs' then 'code' when 'md' then 'split' when 'txt' then 'naive' else 'maxlength' end as splitter,
case {_SQL_EXT} when 'rs' then 'function' when 'md' then chr(10) when 'txt' then null else '512' end as splitter_value,
case {_SQL_EXT} when 'txt' then 20 else 1 end as min_length, true as alphanumeric from documents""")
def rule_resolution(spark: SparkSession, d: str) -> DataFrame:
    f = documents(spark, d).select("doc_id", texts.extension(F.col("filepath")).alias("extension"))
    return with_rules(f, RULES).drop("extension")


# The ledger.

_SQL_NOW = "now as (select filepath, sha256(text) as hash, array[trim(lower(lang)), source] as meta from documents where text is not null)"
_SQL_LAST = """held as (select filepath, hash, meta from (
  select *, row_number() over (partition by filepath order by run_id desc, written_at desc, hash desc) as r from ledger) where r = 1)"""


def present(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("filepath", texts.sha256(F.col("text").cast("binary")).alias("hash"), F.array(F.trim(F.lower("lang")), "source").alias("meta"))


def held(spark: SparkSession, d: str) -> DataFrame:
    last = F.struct("run_id", "written_at", "hash")
    return table(spark, d, "ledger").groupBy("filepath").agg(F.max_by("hash", last).alias("hash"), F.max_by("meta", last).alias("meta"))


@query("select doc_id, sha256(text) as hash from documents where text is not null")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", texts.sha256(F.col("text").cast("binary")).alias("hash"))


@query(f"with {_SQL_NOW}, {_SQL_LAST} select n.filepath, n.hash from now n left join held h using (filepath) where h.hash is null or h.hash <> n.hash")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stale(held(spark, d), present(spark, d)).select("filepath", "hash")


@query(f"""with {_SQL_NOW}, {_SQL_LAST}
select filepath, hash from now union all select filepath, hash from held where filepath not in (select filepath from now)""")
def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    return catalog.merge_ledger(held(spark, d), present(spark, d)).select("filepath", "hash")


_SQL_TAGS = "list_sort(list_distinct(list_transform(coalesce(meta, []), lambda t: regexp_replace(t, '^--', ''))))"


@query(f"select distinct source_id, array_to_string({_SQL_TAGS}, ',') as tags from embed_sources")
def tag_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embed_sources").select("source_id", F.array_join(catalog.tag_set(F.col("meta")), ",").alias("tags"))
    return s.distinct()


@query(f"""with {_SQL_LAST}, s as (select distinct source_id, filepath, meta from embed_sources)
select source_id, array_to_string(coalesce(h.meta, s.meta), ',') as tags from s left join held h using (filepath)""")
def meta_refresh(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embed_sources").select("source_id", "filepath", "meta").distinct()
    return catalog.refresh_meta(s, held(spark, d)).select("source_id", F.array_join("meta", ",").alias("tags"))


@query("select filepath from documents where not (filepath like '%.md') and not (filepath like '%/vendor/%')")
def ignore_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Every root ignores `*.md` and `vendor` folders: patterns as a table (root, pattern), joined on the root."""
    rows = table(spark, d, "sources").select("root").distinct()
    patterns = rows.select("root", F.explode(F.array(F.lit(texts.glob_regex("**/*.md")), F.lit(texts.glob_regex("*/vendor/*")))).alias("pattern"))
    return files.without_ignored(documents(spark, d).select("filepath"), patterns)


# Stored vectors: the sources of embed_sources as rows of a store.

_SQL_STORE = "s as (select distinct source_id, filepath from embed_sources), i as (select row_number() over (order by filepath, source_id) - 1 as id, filepath, source_id from s)"


def stored(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embed_sources").select("source_id", "filepath").distinct()
    return store.with_blocks(store.assign_ids(s, "filepath", "source_id"))


@query(f"with {_SQL_STORE} select id, filepath, source_id from i")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).select("id", "filepath", "source_id")


@query(f"with {_SQL_STORE} select id, (id // 1024)::bigint as block from i")
def block_assign(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).select("id", "block")


@query(f"with {_SQL_STORE} select filepath, (max(id) // 1024)::bigint as block, max(id) as id from i group by filepath")
def directory_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.directory(stored(spark, d))


_SQL_EDIT = "new as (select filepath, source_id from s where filepath like 'mosswick-core/%')"


def edited(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embed_sources").select("source_id", "filepath").distinct()
    return s.where("filepath like 'mosswick-core/%'").withColumn("id", -F.col("source_id"))


@query(f"""with {_SQL_STORE} select id, filepath, source_id from i where filepath not like 'mosswick-core/%'
union all select -source_id, filepath, source_id from s where filepath like 'mosswick-core/%'""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(stored(spark, d).select("id", "filepath", "source_id"), edited(spark, d))


@query(f"""with {_SQL_STORE}, {_SQL_EDIT}, t as (select max(id) + 1 as f from i)
select id, filepath from i where filepath not like 'mosswick-core/%'
union all select f + row_number() over (order by filepath) - 1, filepath from (select distinct filepath from new), t""")
def edit_file(spark: SparkSession, d: str) -> DataFrame:
    """Every file of one root is embedded again as one row: old rows go, ids go on after the largest."""
    now = stored(spark, d).select("id", "filepath", F.array(F.lit("tracked")).alias("meta"), "block")
    new = edited(spark, d).select("filepath").distinct().select("filepath", F.lit(None).cast("array<string>").alias("meta"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("block"))
    return store.replace_files(now, new)[0].select("id", "filepath")


# Embedding of texts.

_SQL_TOKENS = """w as (select doc_id, unnest(regexp_split_to_array(lower(replace(text, chr(13) || chr(10), chr(10))), '[ \\t\\n\\r\\f]+')) as w from documents where text is not null),
c as (select doc_id, ('0x' || substr(md5(w), 1, 4))::int % 64 as bucket, count(*)::double as n from w where w <> '' group by 1, 2),
h as (select doc_id, bucket, n / sqrt(sum(n * n) over (partition by doc_id)) as x from c)"""


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", texts.line_feeds(F.col("text")).alias("chunk"))
    return embed(docs, HashEmbedder(DIM), element="double")


@query(f"with {_SQL_TOKENS} select doc_id, bucket, round(x, 6) as x from h")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return embedded_documents(spark, d).select("doc_id", F.posexplode("data").alias("bucket", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


QUESTION = "the index of the engine and what the ledger knows of a file"


@query(f"""with {_SQL_TOKENS}, qw as (select unnest(string_split('{QUESTION}', ' ')) as w),
qc as (select ('0x' || substr(md5(w), 1, 4))::int % 64 as bucket, count(*)::double as n from qw group by 1), q as (select bucket, n / sqrt(sum(n * n) over ()) as y from qc),
s as (select doc_id, 1 - coalesce(sum(x * y), 0) as v from h left join q using (bucket) group by doc_id)
select doc_id, round(v, 6) + 0.0 as distance from s order by round(v, 12), doc_id limit {K}""")
def hash_embed_search(spark: SparkSession, d: str) -> DataFrame:
    q = HashEmbedder(DIM).embed([search.check_query(QUESTION)])[0].tolist()
    found = embedded_documents(spark, d).withColumn("distance", F.round(vec.distance(F.col("data"), F.lit(q).cast("array<double>")), 12))
    return found.orderBy("distance", "doc_id").limit(K).select("doc_id", rounded("distance").alias("distance"))


# The layered graph over embeddings.

_SQL_LAYERS = """c as (select greatest(1, floor(log2(count(*))))::int as m from embeddings),
t as (select j, pow(1 - 1.0::double / m, abs(j - m + 1)) / m as t from c, unnest(range(0, m)) as u(j)), tt as (select j, t / sum(t) over () as t from t),
members as (select j::int as layer, vec_id as id, embedding::double[] as data, m from embeddings, tt, c
  where j = m - 1 or ('0x' || substr(md5(vec_id::varchar), 1, 4))::int / 65536.0::double < t)"""
_SQL_LINKS = f"""{_SQL_LAYERS},
pairs as (select a.layer, a.id as src, b.id as dst, a.m, round(1 - list_dot_product(a.data, b.data), 12) as dist from members a join members b on a.layer = b.layer and a.id <> b.id),
links as (select layer, src, dst, dist from (select *, row_number() over (partition by layer, src order by dist, dst) as r from pairs) where r <= m),
edges as (select layer, src, dst, min(dist) as dist from (select * from links union all select layer, dst, src, dist from links) group by 1, 2, 3)"""


def members_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    e = embeddings(spark, d).select("id", "data")
    m, chances = graph.layer_parameters(e.count())
    return e, graph.layer_members(e, chances), m


@query(f"with {_SQL_LAYERS} select layer, id from members")
def layer_membership(spark: SparkSession, d: str) -> DataFrame:
    return members_of(spark, d)[1]


@query(f"with {_SQL_LINKS} select src, dst, round(dist, 6) + 0.0 as dist from links where layer = (select max(layer) from links)")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    e, members, m = members_of(spark, d)
    return graph.nearest_links(e, members, m - 1, m).select("src", "dst", rounded("dist").alias("dist"))


@query(f"with {_SQL_LINKS} select layer, src, dst, round(dist, 6) + 0.0 as dist from edges")
def graph_symmetrise(spark: SparkSession, d: str) -> DataFrame:
    return graph.build_graph(embeddings(spark, d).select("id", "data"))[1].withColumn("dist", rounded("dist"))


@query(f"""with {_SQL_LINKS}, g as (select layer, src, count(*) as d from edges group by 1, 2)
select layer, count(*) as nodes, count(d)::bigint as linked, coalesce(sum(d), 0)::bigint as edges, coalesce(max(d), 0)::bigint as most, round(avg(d), 6) as mean
from members mm left join g on g.layer = mm.layer and g.src = mm.id group by mm.layer""".replace("select layer, count(*) as nodes", "select mm.layer, count(*) as nodes"))
def layer_stats(spark: SparkSession, d: str) -> DataFrame:
    members, edges = graph.build_graph(embeddings(spark, d).select("id", "data"))
    return graph.layer_statistics(members, edges).withColumn("mean", F.round("mean", 6))


@query(f"with {_SQL_LINKS} select layer, src, string_agg(dst::varchar, ',' order by dist, dst) as neighbours from edges group by 1, 2")
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = graph.adjacency(graph.build_graph(embeddings(spark, d).select("id", "data"))[1])
    return lists.select("layer", "src", F.array_join(F.transform("neighbours", lambda n: n["dst"].cast("string")), ",").alias("neighbours"))


@query(f"with {_SQL_LAYERS} select vec_id as id from embeddings where vec_id not in (select id from members where layer < (select max(layer) from members))")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are in the last layer only: they get their links there."""
    e, members, m = members_of(spark, d)
    upper = members.where(F.col("layer") < m - 1)
    return graph.orphans(members.where(F.col("layer") == m - 1), upper.select(F.lit(m - 1).alias("layer"), F.col("id").alias("src"))).select("id")


@query(f"with {_SQL_LINKS} select layer, src, dst from edges where src % 7 <> 0 and dst % 7 <> 0")
def remove_node(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d).select("id", "data")
    return graph.without_nodes(graph.build_graph(e)[1], e.where("id % 7 = 0")).select("layer", "src", "dst")


@query(f"with {_SQL_LINKS} select src, dst from edges where layer = (select max(layer) from edges)")
def last_layer(spark: SparkSession, d: str) -> DataFrame:
    return graph.last_layer(graph.build_graph(embeddings(spark, d).select("id", "data"))[1]).select("src", "dst")


@query()
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """A walk over the layers for every query with an id divisible by 50; recall against the exact result is in the tests."""
    e = embeddings(spark, d).select("id", "data")
    members, edges = graph.build_graph(e)
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    return graph.graph_search(q, e, members, edges, K).withColumn("distance", rounded("distance"))


# Cells and signatures.

_SQL_CELLS = """ec as (select vec_id as id, label, embedding::double[] as data from embeddings),
lo as (select label, generate_subscripts(data, 1) as i, unnest(data) as x from ec), me as (select label, i, avg(x) as m from lo group by 1, 2),
ce as (select label::bigint as cell, list(m order by i) as centroid from me group by label),
nc as (select id, data, cell, row_number() over (partition by id order by round(1 - list_dot_product(data, centroid), 12), cell) as r from ec, ce)"""


@query(f"with {_SQL_CELLS} select cell, (generate_subscripts(centroid, 1) - 1)::int as pos, round(unnest(centroid), 6) + 0.0 as m from ce")
def mean_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = search.mean_centroids(embeddings(spark, d), "label")
    return c.select(F.col("cell").cast("bigint").alias("cell"), F.posexplode("centroid").alias("pos", "m")).withColumn("m", rounded("m"))


@query(f"with {_SQL_CELLS} select id, cell from nc where r = 1")
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return search.nearest_cells(e, search.mean_centroids(e, "label"), 1).select("id", "cell")


@query(f"""with {_SQL_CELLS}, x as (select q.id as qid, v.id, round(1 - list_dot_product(q.data, v.data), 12) as x
  from nc q join nc v on q.cell = v.cell and v.r = 1 and q.r <= {PROBES} where q.id % 50 = 0)
select qid, id, round(x, 6) + 0.0 as distance from (select *, row_number() over (partition by qid order by x, id) as r from x) where r <= {K}""")
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    return search.cell_search(q, e, search.mean_centroids(e, "label"), K, PROBES).withColumn("distance", rounded("distance"))


_SQL_SIGNS = f"""ev as (select vec_id as id, embedding::double[] as data from embeddings),
pl as (select t, b, list(case when ('0x' || substr(md5(t || ':' || b || ':' || i), 1, 2))::int % 2 = 1 then 1.0::double else -1.0::double end order by i) as p
  from unnest(range(0, {TABLES})) a(t), unnest(range(0, {BITS})) bb(b), unnest(range(0, {DIM})) c(i) group by t, b),
sg as (select id, t, sum(case when round(list_dot_product(data, p), 9) > 0 then (1 << b)::int else 0 end)::bigint as code from ev, pl group by id, t)"""


@query(f"""with {_SQL_SIGNS}, cand as (select distinct q.id as qid, v.id from sg q join sg v using (t, code) where q.id % 50 = 0),
x as (select qid, cand.id, round(1 - list_dot_product(a.data, b.data), 12) as x from cand join ev a on a.id = qid join ev b on b.id = cand.id)
select qid, id, round(x, 6) + 0.0 as distance from (select *, row_number() over (partition by qid order by x, id) as r from x) where r <= {K}""")
def lsh_search(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d).select("id", "data")
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "data")
    return search.signature_search(q, e, K, TABLES, BITS, DIM).withColumn("distance", rounded("distance"))


# Streams and files.


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def edit_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All events as a stream of edits by user, applied in micro-batches to a table in the shared folder."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select("event_id", "ts", "user_id", "event_type")
    folder = shared_folder(spark)
    t = edits.EditTable(spark, f"{folder}/table", "user_id", ["ts", "event_id"])
    t.run(stream, f"{folder}/checkpoint")
    return t.read().select("user_id", "event_id", "event_type")


@query("select vec_id as id, (vec_id // 1024)::bigint as block, md5(array_to_string(list_transform(embedding, lambda x: round(x::double, 6)::decimal(9, 6)), ',')) as data from embeddings")
def block_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written to binary block files in the shared folder and read by the data source."""
    e = embeddings(spark, d)
    rows = store.with_blocks(e).select("id", F.lit("f").alias("filepath"), "meta", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("subset"), "block", "data")
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    blocks.write_blocks(rows, folder)
    shown = F.array_join(F.transform("data", lambda x: F.round(x.cast("double"), 6).cast("decimal(9,6)").cast("string")), ",")
    return blocks.read_blocks(spark, folder, DIM).select("id", "block", F.md5(shown).alias("data"))


@query(f"with {_SQL_LINKS} select layer, src, dst from edges")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The graph written to an index file in the shared folder and read again."""
    e = embeddings(spark, d).select("id", "data")
    path = f"{shared_folder(spark)}/index"
    blocks.write_index(graph.build_graph(e)[1], path, e.count())
    return blocks.read_index(spark, path).select("layer", "src", "dst")


# The engine as a whole.

ENGINE_RULES = """
* --minlength 1 --maxlength 512 --alphanumeric true
md --split "\\n"
txt --naive --minlength 20
"""
_SQL_CUT = f"""f as (select filepath, {_SQL_EXT} as x, replace(text, chr(13) || chr(10), chr(10)) as text from version),
l as (select filepath, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as piece from f where x = 'md'),
o as (select filepath, piece, coalesce(sum(length(piece) + 1) over (partition by filepath order by k rows between unbounded preceding and 1 preceding), 0)::bigint as s from l),
c as (select filepath, s, piece, unnest(range(0, greatest(length(piece), 1), 8193)) as p from o),
w as (select filepath, x, text, case x when 'txt' then 8192 else 512 end as size from f where x <> 'md'),
y as (select *, unnest(range(0, length(text), size + 1)) as s from w where length(text) > 0),
cut as (select filepath, (s + p)::bigint as "start", (s + least(p + 8192, length(piece)))::bigint as "end", substring(piece, (p + 1)::int, 8192) as chunk, 1 as least_length from c
  union all select filepath, s::bigint, least(s + size, length(text))::bigint, substring(text, (s + 1)::int, size), case x when 'txt' then 20 else 1 end from y),
chunks as (select filepath, "start", "end" from cut where chunk <> '' and "end" - "start" >= least_length and regexp_matches(chunk, '[\\p{{L}}\\p{{N}}\\s]') and regexp_matches(chunk, '[^ \\t\\n\\r\\f]'))"""
_SQL_ROWS = 'select row_number() over (order by filepath, "start", "end") - 1 as id, * from chunks'


def engine_of(spark: SparkSession) -> Engine:
    return Engine(spark, shared_folder(spark), HashEmbedder(DIM), parse_rules(ENGINE_RULES))


def engine_files(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("filepath", "text", F.array(F.lit("tracked")).alias("meta"))


def synced(engine: Engine, files: DataFrame) -> DataFrame:
    return engine.sync_ledger(files.select("filepath", F.col("text").cast("binary").alias("content"), "meta"))


def stored_rows(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "filepath", F.col("subset.start").alias("start"), F.col("subset.end").alias("end"), "block")


@query(f"with version as (select filepath, text from documents where text is not null), {_SQL_CUT} select id, filepath, \"start\", \"end\", (id // 1024)::bigint as block from ({_SQL_ROWS})")
def engine_embed(spark: SparkSession, d: str) -> DataFrame:
    """All documents catalogued, cut by rules, embedded and stored: every chunk once, ids dense and in order."""
    engine, f = engine_of(spark), engine_files(spark, d)
    synced(engine, f)
    return stored_rows(engine.embed(f, full=True))


@query(f"""with first as (with version as (select filepath, case when filepath like 'mosswick-core/%' then text || ' before' else text end as text from documents where text is not null and filepath not like 'fenmark-cli/%'), {_SQL_CUT} {_SQL_ROWS}),
second as (with version as (select filepath, text from documents where text is not null and (filepath like 'mosswick-core/%' or filepath like 'fenmark-cli/%')), {_SQL_CUT} {_SQL_ROWS}),
both_ as (select id, filepath, "start", "end" from first where filepath not like 'mosswick-core/%' union all select id + (select max(id) + 1 from first), filepath, "start", "end" from second)
select *, (id // 1024)::bigint as block from both_""")
def engine_sync(spark: SparkSession, d: str) -> DataFrame:
    """A second sync and embedding after one root was edited and another one added: only their files are embedded, the
    others keep their ids."""
    engine, f = engine_of(spark), engine_files(spark, d)
    edited_root = F.col("filepath").like("mosswick-core/%")
    before = f.where("filepath not like 'fenmark-cli/%'").withColumn("text", F.when(edited_root, F.concat("text", F.lit(" before"))).otherwise(F.col("text")))
    synced(engine, before)
    engine.embed(before, full=True)
    synced(engine, f)
    return stored_rows(engine.embed(f))


@query(f"""with {_SQL_LAST}, v as (select id, any_value(filepath) as filepath, any_value(meta) as meta from vectors where id is not null group by id)
select id, array_to_string(coalesce(h.meta, v.meta), ',') as tags, true as in_full_block from v left join held h using (filepath)""")
def reblock(spark: SparkSession, d: str) -> DataFrame:
    """Every id once, with the ledger's tags, in blocks of which all but the last have 1024 rows."""
    v = table(spark, d, "vectors").where("id is not null").groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("filepath", "meta", "data")])
    out = store.reblock(v, search.mean_centroids(embeddings(spark, d), "label"), held(spark, d))
    sizes = out.groupBy("block").count()
    last, n = sizes.agg(F.max("block").alias("last")), sizes.agg(F.sum("count").alias("n"))
    good = sizes.crossJoin(last).crossJoin(n).select("block", (F.col("count") == F.when(F.col("block") < F.col("last"), store.BLOCK_ROWS).otherwise(F.col("n") - F.col("last") * store.BLOCK_ROWS)).alias("in_full_block"))  # one row each
    return out.join(good, "block").select("id", F.array_join("meta", ",").alias("tags"), "in_full_block")


@query(f"with {_SQL_NOW} select filepath, hash, array_to_string(list_sort(list_distinct(list_filter(meta, lambda m: m is not null))), ',') as tags from now")
def ledger_sync(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    f = docs.select("filepath", F.col("text").cast("binary").alias("content"), F.array_compact(F.array(F.trim(F.lower("lang")), "source")).alias("meta"))
    return engine_of(spark).sync_ledger(f).select("filepath", "hash", F.array_join("meta", ",").alias("tags"))


@query("select distinct id, filepath from vectors where id % 50 = 0")
def access_by_id(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").select("id", "filepath").distinct()
    return store.by_ids(v, v.where("id % 50 = 0").select("id"))


@query("select s.root, count(d.filepath) as kept from (select distinct root from sources) s left join documents d on split_part(d.filepath, '/', 1) = s.root group by 1")
def kept_per_root(spark: SparkSession, d: str) -> DataFrame:
    return files.kept_counts(documents(spark, d), table(spark, d, "sources"))


@query("select distinct query_id, 10::bigint as k, text, array_to_string(filters, ',') as filters from query_log where text is not null and filters is not null")
def message_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The logged queries as JSON requests, and what is read from these."""
    q = table(spark, d, "query_log").where("text is not null and filters is not null").select("query_id", "text", "filters").distinct()
    payload = F.struct(F.lit(K).alias("k"), F.col("text").alias("query"), "filters")
    sent = q.select("query_id", F.to_json(F.struct(F.lit("query").alias("message_type"), payload.alias("payload"))).alias("json"))
    p = messages.request(F.col("json"))["payload"]
    return sent.select("query_id", p["k"].alias("k"), p["query"].alias("text"), F.array_join(p["filters"], ",").alias("filters"))


@query(f"""select distinct def_id from function_defs f join documents d using (filepath) where doc_kind = 'code' and begin_pos >= 0 and begin_pos < end_pos and end_pos <= strlen(text)
and end_pos - begin_pos <= 8192 and {_SQL_EXT} in ('rs', 'py', 'js', 'ts')""")
def functions_listed(spark: SparkSession, d: str) -> DataFrame:
    """The listed functions that come out of the splitter as one chunk: start and end are those of the list, converted from
    bytes of the text as stored to characters of the text with line feeds."""
    code = table(spark, d, "documents").where("doc_kind = 'code'").select("doc_id", "filepath", "text")
    found = chunks.split_functions(code).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    defs = table(spark, d, "function_defs").select("def_id", "filepath", "begin_pos", "end_pos").distinct()
    inside = defs.join(code, "filepath").where("begin_pos >= 0 and begin_pos < end_pos and end_pos <= octet_length(text) and end_pos - begin_pos <= 8192")
    at = lambda c: F.length(texts.line_feeds(F.decode(F.expr(f"substring(encode(text, 'UTF-8'), 1, int({c}))"), "UTF-8"))).cast("bigint")
    listed = inside.where(texts.extension(F.col("filepath")).isin("rs", "py", "js", "ts")).select("def_id", "doc_id", at("begin_pos").alias("s"), at("end_pos").alias("e"))
    return listed.join(found, ["doc_id", "s", "e"], "left_semi").select("def_id").distinct()


# Problem 3. Paths as in the tables: rewriting of `//`, `/./`, `./` at the start and `name/../`.
_SQL_PATH = "regexp_replace(regexp_replace(regexp_replace(filepath, '(^|/)(\\./)+', '\\1', 'g'), '/+', '/', 'g'), '[^/]+/\\.\\./', '', 'g')"
_SQL_HASH = "nullif(regexp_extract(lower(trim(hash)), '^(?:sha256:)?([0-9a-f]{64})$', 1), '')"
_SQL_WORK = f"""
with scans as (
  select {_SQL_PATH} as path, {_SQL_HASH} as h, outcome, seen_at, loaded_at, scan_id from scan_log),
latest as (
  select path, h, outcome, row_number() over (partition by path order by seen_at desc, loaded_at desc, scan_id desc) as r
  from scans where outcome = 'gone' or (outcome = 'ok' and h is not null)),
written as (
  select {_SQL_PATH} as path, {_SQL_HASH} as h, l.run_id, written_at
  from ledger l where l.run_id in (select run_id from sync_runs where status = 'ok')),
known as (
  select path, h, run_id, row_number() over (partition by path order by run_id desc, written_at desc, h desc) as r from written where h is not null)
select l.path as filepath, l.h as hash, case when k.h = l.h then 'done' else 'pending' end as state, k.run_id as token
from latest l left join known k on k.path = l.path and k.r = 1 where l.r = 1 and l.outcome = 'ok'"""


@query(_SQL_WORK)
def p3_work_items(spark: SparkSession, d: str) -> DataFrame:
    return worklist.work_items(table(spark, d, "scan_log"), table(spark, d, "ledger"), table(spark, d, "sync_runs"))


@query(f"select filepath, hash from ({_SQL_WORK}) where state <> 'done'")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run's lease takes."""
    return worklist.next_run(spark, shared_folder(spark), table(spark, d, "scan_log"), table(spark, d, "ledger"), table(spark, d, "sync_runs"))[2]


@query(f"""select filepath, hash, case when hash < '8' then 'done' else 'leased' end as state,
(select max(run_id) from sync_runs) + case when hash < '8' then 1 else 2 end as token from ({_SQL_WORK}) where state <> 'done'""")
def p3_take_over(spark: SparkSession, d: str) -> DataFrame:
    """A run that dies half way: it commits half of its items in two portions; after its lease has expired another run takes
    over the rest, and what the first one commits then doesn't count."""
    work, token, items, now = worklist.next_run(spark, shared_folder(spark), table(spark, d, "scan_log"), table(spark, d, "ledger"), table(spark, d, "sync_runs"))
    for portion in ("hash < '4'", "hash >= '4' and hash < '8'"):
        work.commit(token, items.where(portion), now)
    late = now + dt.timedelta(seconds=worklist.LEASE_SECONDS)
    work.lease(late, worklist.LEASE_SECONDS)
    work.commit(token, items, late)
    return work.states(late).join(items, ["filepath", "hash"], "left_semi")
