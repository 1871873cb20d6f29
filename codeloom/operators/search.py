"""Lexical, fuzzy, vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scoring, text
from codeloom.plans.dsl import Query
from codeloom.runtime import materialise, spread

#: Published BM25 parameters and the weights of the node columns.
K1, B = 1.2, 0.75
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def postings(docs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, term, tf, len): weighted term counts per document and its length in tokens over all columns.

    Counted within each document before anything is shuffled, so a term that
    every document has costs one row per document.
    """

    def weighted(c: str, w: float):
        return F.transform(text.fts_tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    arrays = [weighted(c, w) for c, w in weights.items()]
    tokens = docs.select(key, F.concat(*arrays).alias("t")).select(key, "t", F.size("t").alias("len"))
    return tokens.select(key, "len", F.explode("t").alias("x")).groupBy(key, "len", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def bm25(docs: DataFrame, key: str, weights: dict[str, float], query: str, prefix: bool = True) -> DataFrame:
    """(key, score) of documents that have a query term (or, with prefix, a term that begins with one).

    Each document counts its own tokens: one pass gives length and the tf of
    every query term, so no posting is shuffled; document frequencies and the
    mean length are one small aggregate.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    hit = (lambda t: lambda x: x.startswith(t)) if prefix else (lambda t: lambda x: x == t)
    cols, ks = list(weights), range(len(terms))
    # one step each, so that a text is cut into tokens once and not per term
    cut = spread(docs.select(key, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)))).select(key, *(text.fts_tokens(F.coalesce(F.col(f"_c{i}"), F.lit(""))).alias(f"_t{i}") for i in range(len(cols))))
    counted = cut.select(key, sum((F.size(f"_t{i}") for i in range(len(cols))), F.lit(0)).alias("len"), *(F.size(F.filter(f"_t{i}", hit(terms[k]))).alias(f"_n{i}_{k}") for i in range(len(cols)) for k in ks))
    tfs = [sum((F.col(f"_n{i}_{k}") * F.lit(weights[c]) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"tf{k}") for k in ks]
    seen = [F.greatest(*(F.col(f"_n{i}_{k}") for i in range(len(cols))), F.lit(0)).alias(f"n{k}") for k in ks]
    rows = materialise(counted.select(key, "len", *tfs, *seen))  # a few numbers per document, read for the statistics and again for the scores
    stats = rows.agg(F.count("*").alias("N"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"n{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    both = rows.where(" or ".join(f"n{k} > 0" for k in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("N") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)))
        tf = F.col(f"tf{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return both.select(key, score.alias("score"))


def query_terms(query: str) -> list[str]:
    """Terms of a full-text query: signs and the words AND, OR, NOT, NEAR dropped, lower case, distinct."""
    words = re.sub(r"[\"'()*:^]", " ", query.replace("::", " ")).split()
    low = [w for w in words if w not in ("AND", "OR", "NOT", "NEAR")]
    return list(dict.fromkeys(t for w in low for t in re.sub(r"[^a-z0-9_]+", " ", w.lower()).split()))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def filtered(nodes: DataFrame, q: Query) -> DataFrame:
    """Hard filters of a parsed query: kinds, languages, path and name parts; before any limit."""
    out = nodes
    if q.kinds:
        out = out.where(F.col("kind").isin(q.kinds))
    if q.languages:
        out = out.where(F.col("language").isin(q.languages))
    for column, parts in (("file_path", q.paths), ("name", q.names)):
        if parts:
            cond = F.lit(False)
            for p in parts:
                cond = cond | F.contains(F.lower(F.col(column)), F.lit(p.lower()))
            out = out.where(cond)
    return out


def like_scores(nodes: DataFrame, needle: str, wildcards: bool = False) -> DataFrame:
    """Substring search in name and qualified name: exact 1, prefix 0.9, name 0.8, qualified name 0.7."""
    n, qn = F.lower("name"), F.lower("qualified_name")
    t = needle.lower()
    has = (lambda c: c.like(f"%{t}%")) if wildcards else (lambda c: F.contains(c, F.lit(t)))
    starts = n.like(f"{t}%") if wildcards else n.startswith(t)
    score = F.when(n == t, 1.0).when(starts, 0.9).when(has(n), 0.8).when(has(qn), 0.7).otherwise(0.5)
    return nodes.where(has(n) | has(qn)).select("*", score.alias("score"))


def fuzzy_scores(nodes: DataFrame, needle: str, limit: int = 50, per_name: int = 5) -> DataFrame:
    """Names within edit distance 1 (up to 4 characters) or 2, the nearest max(2 limit, 50) names, at most five nodes each."""
    t = needle.lower()
    most = 1 if len(t) <= 4 else 2
    names = nodes.select("name").distinct().where(F.abs(F.length("name") - len(t)) <= most)
    near = names.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(t), most)).where("distance >= 0").orderBy("distance", "name").limit(max(2 * limit, 50))
    w = Window.partitionBy("name").orderBy("id")
    hits = nodes.join(near, "name").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_name).drop("_r")
    return hits.withColumn("score", 1 / (1 + F.col("distance"))).drop("distance")


def search(nodes: DataFrame, q: Query, limit: int = 20) -> DataFrame:
    """(id, name, kind, file_path, score, tier): full text, else substring, else fuzzy; rescored, best first.

    A tier is run only if the one before finds nothing. Exact names missed by
    the full-text tier join it at its best score.
    """
    pool = filtered(nodes, q)
    cols = ["id", "name", "kind", "file_path"]
    if not q.text:
        return pool.select(*cols, F.lit(0.5).alias("score"), F.lit("filter").alias("tier")).orderBy("name", "id").limit(limit)
    weights = {c: w for c, w in WEIGHTS.items() if c in nodes.columns}
    found = pool.join(bm25(pool, "id", weights, q.text), "id").select(*cols, "score").withColumn("tier", F.lit("fts"))
    if found.isEmpty():
        found = like_scores(pool, q.text).select(*cols, "score", F.lit("like").alias("tier")) if len(q.text) >= 2 else found
        if len(q.text) >= 3 and found.isEmpty():
            found = fuzzy_scores(pool, q.text, limit).select(*cols, "score", F.lit("fuzzy").alias("tier"))
    else:
        terms = [t for t in q.text.lower().split() if len(t) >= 2]
        best = found.agg(F.max("score")).first()[0]
        extra = pool.where(F.lower("name").isin(terms)).select(*cols, F.lit(best).alias("score"), F.lit("exact").alias("tier"))
        found = found.unionByName(extra.join(found.select("id"), "id", "left_anti"))
    final = scoring.rescored(F.col("score"), q.text, F.col("kind"), F.col("name"), F.col("file_path"))
    return found.withColumn("score", F.round(final, 6)).orderBy(F.desc("score"), "id").limit(limit)


def exact_names(nodes: DataFrame, names: list[str], limit: int = 20) -> DataFrame:
    """Nodes of these names without regard to case; +20 beside a distinctive name (one in at most nine files); per name at most max(8, limit / names)."""
    low = [n.lower() for n in names]
    hits = nodes.where(F.lower("name").isin(low)).select("id", "name", "kind", "file_path")
    spread = hits.groupBy(F.lower("name").alias("n")).agg(F.countDistinct("file_path").alias("files"))
    rare = hits.join(spread.where("files < 10"), F.lower("name") == F.col("n")).select("file_path", F.lower("name").alias("other")).distinct()
    mates = hits.join(rare, "file_path").where("lower(name) <> other").select("id").distinct().withColumn("bonus", F.lit(20))
    scored = hits.join(mates, "id", "left").withColumn("score", scoring.kind_bonus(F.col("kind")) + F.coalesce("bonus", F.lit(0))).drop("bonus")
    w = Window.partitionBy(F.lower("name")).orderBy(F.desc("score"), "id")
    cap = max(8, -(-limit // max(1, len(names))))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def token_search(docs: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """(key, score): share of query tokens present, damped by length and by how often they occur; tokens of three characters and more."""
    tokens = [t for t in query_terms(query) if len(t) >= 3]
    if not tokens:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    have = text.fts_tokens(low)
    matched = sum((F.when(F.array_contains(have, t), 1).otherwise(0) for t in tokens), F.lit(0))
    times = sum((text.occurrences(low, F.lit(t)) for t in tokens), F.lit(0))
    score = matched / len(tokens) * F.least(F.lit(1.0), 2000.0 / F.length(low)) * (0.5 + 0.5 * F.least(times, F.lit(10)) / 10)
    return docs.where(matched > 0).select(key, score.alias("score"))


def vector_search(vectors: DataFrame, key: str, column: str, queries: DataFrame, query_key: str, k: int = 10, block: int = 10_000) -> DataFrame:
    """(query_key, key, score): the k nearest of all vectors by cosine for each query vector; only positive similarities.

    The queries are a stated set and go to the tasks in blocks of about
    `block`, one pass over the vectors for each; a task keeps the k best per
    query before the one small shuffle, so no query meets its rows in one
    place. Null vectors are no queries and are not found.
    """
    import numpy as np
    import pandas as pd

    queries = queries.where(F.col(column).isNotNull())
    blocks = max(1, -(-queries.count() // block))
    kinds = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    unit = lambda m: np.divide(m, (s := np.sqrt((m * m).sum(1, keepdims=True))), out=np.zeros_like(m), where=s > 0)

    def scanner(names: list, given: list):
        dim = max((len(v) for v in given), default=0)

        def padded(rows) -> np.ndarray:
            m = np.zeros((len(rows), dim))
            for n, v in enumerate(rows):
                m[n, : min(dim, len(v))] = v[:dim]
            return m

        q = unit(padded(given))

        def scan(batches):
            best: list = [([], []) for _ in names]
            for b in batches:
                scores, keys = unit(padded(b[column].tolist())) @ q.T, b[key].to_numpy()
                for n in range(len(names)):
                    s = np.r_[best[n][1], scores[:, n]]
                    ids = np.r_[np.array(best[n][0], dtype=keys.dtype), keys]
                    keep = np.lexsort((ids, -s))[:k]
                    best[n] = (ids[keep], s[keep])
            rows = [(names[n], i, float(s)) for n in range(len(names)) for i, s in zip(*best[n]) if s > 0]
            yield pd.DataFrame(rows, columns=[query_key, key, "score"])

        return scan

    near = None
    for at in range(blocks):
        qs = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == at).select(F.col(query_key).alias("q"), F.col(column).alias("v")).collect()
        rows = vectors.where(f"{column} is not null").select(key, column).mapInPandas(scanner([r.q for r in qs], [r.v for r in qs]), kinds)
        near = rows if near is None else near.unionByName(rows)
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fused(lexical: DataFrame, semantic: DataFrame, key: str, mode: str = "max", k: int = 10, least: float = 0.0) -> DataFrame:
    """(key, score, source): full outer merge of two result lists, by the greater score (`max`) or by reciprocal ranks (`rrf`)."""
    if mode == "rrf":
        rank = lambda d: d.withColumn("score", 1.0 / (60 + F.row_number().over(Window.orderBy(F.desc("score"), key))))  # noqa: E731 - result lists are short
        lexical, semantic = rank(lexical), rank(semantic)
    a, b = lexical.select(key, F.col("score").alias("a")), semantic.select(key, F.col("score").alias("b"))
    both = a.join(b, key, "full_outer")
    score = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) if mode == "rrf" else F.greatest("a", "b")
    source = F.when(F.col("a").isNull(), "semantic").when(F.col("b").isNull(), "keyword").otherwise("both")
    return both.select(key, score.alias("score"), source.alias("source")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def chunk_search(chunks: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(id, symbol_name, file_path, content, score): full text over chunks (id, symbol_name, file_path, content); the content comes back as it was stored."""
    found = bm25(chunks, "id", {"symbol_name": 5.0, "content": 1.0}, query)
    return chunks.select("id", "symbol_name", "file_path", "content").join(top(found, "id", k), "id").orderBy(F.desc("score"), "id")


def search_tool(nodes: DataFrame, query: str, mode: str = "hybrid", limit: int = 5, semantic: DataFrame | None = None) -> DataFrame:
    """(id, score, source): the exposed search, 1 to 20 results.

    keyword: full text, substring or fuzzy names; semantic: the given scored
    ids; hybrid: both merged by the greater score. Without vectors every mode
    is by keyword.
    """
    from codeloom.plans.dsl import parse

    k = max(1, min(20, limit))
    if mode not in ("semantic", "keyword", "hybrid"):
        raise ValueError(f"no mode {mode}")
    words = search(nodes, parse(query), k).select("id", "score")
    if semantic is None or mode == "keyword":
        return words.withColumn("source", F.lit("keyword"))
    if mode == "semantic":
        return top(semantic, "id", k).withColumn("source", F.lit("semantic"))
    return fused(words, semantic, "id", "max", k)
