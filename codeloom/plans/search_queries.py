"""Catalogue: lexical, fuzzy, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scoring, text
from codeloom.operators import aggregates, search
from codeloom.plans import dsl
from codeloom.plans.base import N, nodes
from codeloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TERMS = ["lattice", "snapshot", "quiet"]
_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"


def _bm25_sql(terms: list[str]) -> str:
    cols = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{k} > 0) df{k}" for k in range(len(terms)))
    part = " + ".join(f"greatest(1e-6, ln((n - df{k} + 0.5) / (df{k} + 0.5))) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / al))" for k in range(len(terms)))
    some = " or ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""tk as (select doc_id, {_TOK} tk from documents where text is not null), tf as (select doc_id, len(tk) dl, {cols} from tk),
      st as (select count(*) n, avg(dl) al, {df} from tf), bm as (select doc_id, round({part}, 6) score from tf, st where {some})"""


@query(f"with {_bm25_sql(TERMS)} select doc_id, score from bm order by score desc, doc_id limit 20")
def bm25_topk(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    scored = search.bm25(docs, "doc_id", {"text": 1.0}, " ".join(TERMS), prefix=False).withColumn("score", F.round("score", 6))
    return search.top(scored, "doc_id", 20)


@query(f"with tk as (select {_TOK} tk, doc_id from documents where text is not null) select term, count(*) documents, sum(c)::bigint occurrences from (select doc_id, unnest(tk) term, 1 c from tk) group by doc_id, term".replace("select term, count(*) documents, sum(c)::bigint occurrences from (select doc_id, unnest(tk) term, 1 c from tk) group by doc_id, term", "select term, count(*) documents, sum(c)::bigint occurrences from (select doc_id, term, count(*) c from (select doc_id, unnest(tk) term from tk) group by all) group by term"))
def document_frequencies(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return search.postings(docs, "doc_id", {"text": 1.0}).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").cast("bigint").alias("occurrences"))


@query("""with x as (select doc_id, lower(text) t from documents where text is not null),
  m as (select doc_id, length(t) n, list_contains(list_filter(string_split_regex(t, '[^a-z0-9_]+'), lambda x: x <> ''), 'gateway')::int a, list_contains(list_filter(string_split_regex(t, '[^a-z0-9_]+'), lambda x: x <> ''), 'journal')::int b,
    ((length(t) - length(replace(t, 'gateway', ''))) / 7 + (length(t) - length(replace(t, 'journal', ''))) / 7) c from x)
  select doc_id, round((a + b) / 2.0 * least(1.0, 2000.0 / n) * (0.5 + 0.5 * least(c, 10) / 10), 6)::double score from m where a + b > 0""")
def inmem_fts_score(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return search.token_search(docs, "doc_id", "text", "gateway journal").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""with {N} select id, case when lower(name) = 'scan' then 1.0 when starts_with(lower(name), 'scan') then 0.9 when contains(lower(name), 'scan') then 0.8 else 0.7 end::double score
  from n where contains(lower(name), 'scan') or contains(lower(qualified_name), 'scan') order by score desc, length(name), id limit 50""")
def like_tiered(spark, d):
    return search.like_scores(nodes(spark, d), "scan").orderBy(F.desc("score"), F.length("name"), "id").limit(50).select("id", F.col("score").cast("double").alias("score"))


@query(f"""with {N}, near as (select distinct name, levenshtein(lower(name), 'hashledger') dist from n where abs(length(name) - 10) <= 2 and levenshtein(lower(name), 'hashledger') <= 2 order by dist, name limit 50),
  h as (select id, n.name, dist, row_number() over (partition by n.name order by id) r from n join near using (name)) select id, name, round(1 / (1 + dist), 6)::double score from h where r <= 5""")
def fuzzy_names(spark, d):
    return search.fuzzy_scores(nodes(spark, d), "hashLedger", 25).select("id", "name", F.round("score", 6).alias("score"))


@query()
def search_nodes(spark, d):
    return search.search(nodes(spark, d), dsl.parse('kind:function,method lang:go path:pkg "snapshot"'), 20)


@query()
def search_fallback(spark, d):
    return search.search(nodes(spark, d), dsl.parse("hashLedgr kind:function"), 20)


_WEIGHTED = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def _node_bm25_sql(terms: list[str]) -> str:
    cut = ", ".join(f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9_]+'), lambda x: x <> '') t{i}" for i, c in enumerate(_WEIGHTED))
    tf = ", ".join(" + ".join(f"{w} * len(list_filter(t{i}, lambda x: starts_with(x, '{t}')))" for i, w in enumerate(_WEIGHTED.values())) + f" tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{k} > 0) df{k}" for k in range(len(terms)))
    part = " + ".join(f"greatest(1e-6, ln((c - df{k} + 0.5) / (df{k} + 0.5))) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / al))" for k in range(len(terms)))
    return f"""with {N}, tk as (select id, {cut} from n), tf as (select id, len(t0) + len(t1) + len(t2) + len(t3) dl, {tf} from tk), st as (select count(*) c, avg(dl) al, {df} from tf)
      select id, round({part}, 6)::double score from tf, st where {' or '.join(f'tf{k} > 0' for k in range(len(terms)))} order by score desc, id limit 50"""


@query(_node_bm25_sql(["scan", "ledger"]))
def node_bm25(spark, d):
    scored = search.bm25(nodes(spark, d), "id", _WEIGHTED, "scan ledger").withColumn("score", F.round("score", 6))
    return search.top(scored, "id", 50)


@query(f"""with {N}, h as (select id, name, kind, file_path, lower(name) k from n where lower(name) in ('scanledger', 'hashnode', 'log')),
  few as (select k from h group by 1 having count(distinct file_path) < 10), rare as (select distinct file_path, k other from h where k in (from few)),
  mates as (select distinct h.id from h join rare using (file_path) where h.k <> other),
  s as (select id, name, kind, file_path, case kind when 'function' then 10 when 'method' then 10 when 'class' then 8 when 'interface' then 8 when 'struct' then 8 when 'constant' then 5 when 'field' then 5 when 'namespace' then 4 when 'module' then 4 else 3 end + case when id in (from mates) then 20 else 0 end score, k from h)
  select id, name, kind, file_path, score from (select *, row_number() over (partition by k order by score desc, id) r from s) where r <= 8""")
def exact_name_colocated(spark, d):
    return search.exact_names(nodes(spark, d), ["scanLedger", "hashNode", "log"], 20)


@query(f"""with {N}, names as (select distinct name from n where kind in ('function', 'method', 'class', 'interface', 'struct')),
  seg as (select name, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) between 2 and 32 and not regexp_full_match(x, '[0-9]+')))) segment from names)
  select segment, count(*) names from seg group by 1""")
def segment_rarity(spark, d):
    return aggregates.segment_vocabulary(nodes(spark, d)).groupBy("segment").agg(F.count("*").alias("names"))


@query(f"""with {N}, names as (select distinct name from n where kind in ('function', 'method', 'class', 'interface', 'struct')),
  seg as (select name, unnest(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) between 2 and 32 and not regexp_full_match(x, '[0-9]+')))) segment from names),
  form as (select * from (values ('caches', 'caches'), ('caches', 'cache'), ('caches', 'cach'), ('scans', 'scans'), ('scans', 'scan')) v(word, segment))
  select name, count(distinct word) matches from seg join form using (segment) group by 1 having count(distinct word) >= 1""")
def segment_cooccurrence(spark, d):
    return aggregates.segment_matches(aggregates.segment_vocabulary(nodes(spark, d)), ["caches", "scans"], 1)


@query("""with q as (select vec_id query_id, embedding v from embeddings where vec_id % 20 = 0)
  select query_id, vec_id, round(s, 6) score from (select query_id, vec_id, s, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) r
    from (select query_id, vec_id, list_cosine_similarity(embedding::double[], v::double[]) s from embeddings, q)) where r <= 10 and s > 0""")
def cosine_topk_batch(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_search(v, "vec_id", "embedding", q, "query_id", 10).withColumn("score", F.round("score", 6))


@query("""with q as (select embedding v from embeddings where vec_id = 0)
  select vec_id, round(list_cosine_similarity(embedding::double[], v::double[]), 6) score from embeddings, q where list_cosine_similarity(embedding::double[], v::double[]) > 0 order by score desc, vec_id limit 10""")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = v.crossJoin(F.broadcast(one)).select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row
    return search.top(scored.where("score > 0"), "vec_id", 10)


_LISTS = f"""with {_bm25_sql(TERMS)}, l as (select doc_id, score from bm order by score desc, doc_id limit 50),
  q as (select embedding v from embeddings where vec_id = 0),
  s as (select vec_id doc_id, round(list_cosine_similarity(embedding::double[], v::double[]), 6) score from embeddings, q where list_cosine_similarity(embedding::double[], v::double[]) > 0 order by score desc, vec_id limit 50)"""


def _lists(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lexical = search.top(search.bm25(docs, "doc_id", {"text": 1.0}, " ".join(TERMS), prefix=False).withColumn("score", F.round("score", 6)), "doc_id", 50)
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = search.vector_search(v, "vec_id", "embedding", q, "query_id", 50).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    return lexical, near


@query(f"""{_LISTS} select doc_id, greatest(l.score, s.score) score, case when l.score is null then 'semantic' when s.score is null then 'keyword' else 'both' end source
  from l full join s using (doc_id) order by score desc, doc_id limit 30""")
def hybrid_fusion_max(spark, d):
    return search.fused(*_lists(spark, d), "doc_id", "max", 30)


@query(f"""{_LISTS}, lr as (select doc_id, 1.0 / (60 + row_number() over (order by score desc, doc_id)) score from l), sr as (select doc_id, 1.0 / (60 + row_number() over (order by score desc, doc_id)) score from s)
  select doc_id, round(coalesce(lr.score, 0) + coalesce(sr.score, 0), 6)::double score, case when lr.score is null then 'semantic' when sr.score is null then 'keyword' else 'both' end source
  from lr full join sr using (doc_id) order by coalesce(lr.score, 0) + coalesce(sr.score, 0) desc, doc_id limit 30""")
def hybrid_fusion_rrf(spark, d):
    return search.fused(*_lists(spark, d), "doc_id", "rrf", 30).withColumn("score", F.round("score", 6))


@query(f"""with {N}, f as (select file_path, count(*) c from n where kind in ('function', 'method') group by 1)
  select id, file_path from (select id, file_path, row_number() over (partition by file_path order by length(name) desc, id) r from n where kind in ('function', 'method')) where r <= 5""")
def per_file_cap(spark, d):
    from codeloom.operators.graph import per_file_cap as cap

    n = nodes(spark, d).where("kind in ('function', 'method')").select("id", "file_path", F.length("name").alias("score"))
    return cap(n, 20).select("id", "file_path")


@query(f"with {N} select id, name, regexp_extract(qualified_name, '([^.:]*)$', 1) tail, contains(name, '_') or regexp_matches(name, '[0-9]') or regexp_matches(name, '^.+[A-Z]') as distinctive from n")
def name_features(spark, d):
    return nodes(spark, d).select("id", "name", text.name_tail("qualified_name").alias("tail"), text.is_distinctive("name").alias("distinctive"))
