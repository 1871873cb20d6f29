"""From a task text to a subgraph, its code and a report; and the read-only tools over the graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scoring, text
from codeloom.functions.constants import SUPERTYPE_KINDS
from codeloom.operators import graph, search
from codeloom.plans.dsl import Query
from codeloom.runtime import materialise

#: Kinds in the order in which their code is shown; fixed values.
BLOCK_ORDER = "function method class interface struct trait enum type_alias component route constant".split()


def symbols_in(task: str) -> list[str]:
    """Symbols named in a task: dotted paths, SCREAMING, snake and camel case."""
    patterns = (r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b", r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b")
    found = [m for p in patterns for m in re.findall(p, task)]
    tails = [t for m in found if "." in m for t in m.split(".") if re.search(r"[_0-9]|.[A-Z]", t)]
    return list(dict.fromkeys(found + tails))


def entry_points(nodes: DataFrame, task: str, limit: int = 3) -> DataFrame:
    """(id, name, kind, file_path, score, step): where to start: exact names, then capitalised stems in names, full text, substrings, fuzzy names.

    A step runs only while fewer than `limit` nodes are found. Nodes whose
    file two or more symbols hit gain half their score for each. step tells
    the confidence: up to 3 is high.
    """
    symbols = symbols_in(task) or [w for w in re.findall(r"\w{3,}", task)][:8]
    cols = ["id", "name", "kind", "file_path"]
    low = [s.rsplit(".", 1)[-1].lower() for s in symbols]

    def exact():
        return nodes.where(F.lower("name").isin(low)).select(*cols, (F.lit(100.0) + scoring.kind_bonus(F.col("kind"))).alias("score"))

    def stems():
        cond = F.lit(False)
        for s in {s[:1].upper() + s[1:] for s in low if len(s) >= 4}:
            cond = cond | F.col("name").contains(s)
        return nodes.where(cond).select(*cols, (F.lit(60.0) + scoring.kind_bonus(F.col("kind"))).alias("score"))

    def full_text():
        weights = {c: w for c, w in search.WEIGHTS.items() if c in nodes.columns}
        return nodes.join(search.bm25(nodes, "id", weights, " ".join(low)), "id").select(*cols, "score")

    def like():
        out = None
        for s in low:
            part = search.like_scores(nodes, s).select(*cols, "score")
            out = part if out is None else out.unionByName(part)
        return out.groupBy(*cols).agg(F.max("score").alias("score"))

    def fuzzy():
        return search.fuzzy_scores(nodes, low[0], limit).select(*cols, "score")

    found, have = None, 0
    for step, rule in enumerate((exact, stems, full_text, like, fuzzy), 1):
        if not low or have >= limit:
            break
        got = rule().withColumn("step", F.lit(step))
        if found is not None:
            got = got.join(found.select("id"), "id", "left_anti")
        got = got.orderBy(F.desc("score"), "id").limit(limit * 5)
        found = materialise(got if found is None else found.unionByName(got))
        have = found.count()  # at most a few times the limit
    if found is None:
        return nodes.select(*cols, F.lit(0.0).alias("score"), F.lit(0).alias("step")).limit(0)
    mates = found.groupBy("file_path").agg(F.countDistinct(F.lower("name")).alias("m"))
    boosted = found.join(mates, "file_path").withColumn("score", F.when(F.col("m") >= 2, F.col("score") * (1 + 0.5 * F.col("m"))).otherwise(F.col("score")))
    return boosted.select(*cols, "score", "step").orderBy("step", F.desc("score"), "id").limit(limit)


def expand(entries: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, max_nodes: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the entries: a walk both ways, supertypes and subtypes of types, caps per file and for tests, trimmed with entries first.

    nodes has depth and is_root; edges are all between kept nodes.
    """
    starts = entries.select("id")
    near = graph.levels(starts, graph.links(edges, "both"), depth)
    types = nodes.where(F.col("kind").isin(SUPERTYPE_KINDS)).select("id").join(near, "id", "left_semi")
    family = graph.type_hierarchy(types, edges).select("id", (F.col("depth") + depth).alias("depth"))
    reached = near.unionByName(family).groupBy("id").agg(F.min("depth").alias("depth"))
    rows = reached.join(nodes, "id").withColumns({"is_root": F.col("depth") == 0, "is_test": scoring.is_test(F.col("file_path"))})
    rank = [F.col("depth"), scoring.kind_bonus(F.col("kind")).desc(), F.col("id")]
    capped = rows.withColumn("_f", F.row_number().over(Window.partitionBy("file_path").orderBy(*rank))).withColumn("_t", F.row_number().over(Window.partitionBy("is_test").orderBy(*rank)))
    kept = capped.where(F.col("is_root") | (F.col("_f") <= max(5, -(-max_nodes // 5))) & (~F.col("is_test") | (F.col("_t") <= max(3, -(-max_nodes * 15 // 100)))))
    final = materialise(kept.drop("_f", "_t", "is_test").orderBy(F.desc("is_root"), *rank).limit(max_nodes))
    return final, graph.subgraph(final, edges)


def code_blocks(picked: DataFrame, texts: DataFrame, most: int = 5, size: int = 1500) -> DataFrame:
    """(id, name, kind, file_path, start_line, code): code of the first nodes by kind, cut to a size; only the texts of their files are read."""
    first, last = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    rank = F.array_position(F.array(*map(F.lit, BLOCK_ORDER)), F.col("kind"))
    best = picked.where("start_line is not null and end_line is not null").orderBy(F.desc("is_root"), F.when(rank > 0, rank).otherwise(99), "id").limit(most)
    lines = F.split("text", "\n")
    joined = best.join(texts.select(F.col("path").alias("file_path"), "text"), "file_path")
    return joined.select("id", "name", "kind", "file_path", first.alias("start_line"), F.left(F.array_join(F.slice(lines, first, last - first + 1), "\n"), F.lit(size)).alias("code"))


def imports_to_definitions(picked: DataFrame, edges: DataFrame) -> DataFrame:
    """ids with import nodes replaced by the first target of their imports or exports edges; imports without target are dropped."""
    first = edges.where("kind in ('imports', 'exports')").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("definition"))
    return picked.join(first, "id", "left").where("kind <> 'import' or definition is not null").select(F.when(F.col("kind") == "import", F.col("definition")).otherwise(F.col("id")).alias("id")).distinct()


def summary(picked: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, value): totals and the five commonest kinds."""
    kinds = picked.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "key").limit(5).select(F.lit("kind").alias("metric"), "key", "value")
    total = lambda d, m: d.agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), F.lit("").alias("key"), "value")
    return total(picked, "nodes").unionByName(total(edges, "edges")).unionByName(kinds)


def markdown(blocks: DataFrame) -> DataFrame:
    """One row: the code blocks as Markdown, by file and line."""
    part = F.concat(F.lit("### "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(") "), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("\n```\n"), F.col("code"), F.lit("\n```"))
    rows = blocks.select(F.struct("file_path", "start_line", part.alias("md")).alias("b"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["md"]), "\n\n").alias("markdown"))  # at most a few blocks


def build(task: str, nodes: DataFrame, edges: DataFrame, texts: DataFrame, max_nodes: int = 20, max_blocks: int = 5) -> dict[str, DataFrame]:
    """entries, nodes, edges, blocks, files and summary of a task."""
    entries = entry_points(nodes, task)
    picked, inner = expand(entries, nodes, edges, 1, max_nodes)
    return {
        "entries": entries, "nodes": picked, "edges": inner, "blocks": code_blocks(picked, texts, max_blocks),
        "files": picked.select("file_path").distinct().orderBy("file_path"), "summary": summary(picked, inner),
    }


# tools


def tool_search(nodes: DataFrame, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    return search.filtered(nodes.where(F.col("name") == name), Query(kinds=[kind] if kind else [])).orderBy("file_path", "start_line", "id").limit(limit)


def resolve_file(files: DataFrame, wanted: str) -> DataFrame:
    """(path): the exact path, else the only file of that base name, else the only path that contains it; no rows if it is not unique."""
    p = F.col("path")
    tier = F.when(p == wanted, 1).when(F.element_at(F.split(p, "/"), -1) == wanted, 2).when(p.contains(wanted), 3)
    hits = files.select("path", tier.alias("tier")).where("tier is not null")
    best = hits.groupBy("tier").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1 or tier = 1")
    return best.orderBy("tier").limit(1).select("path")


def node_at(nodes: DataFrame, name: str, line: int | None = None) -> DataFrame:
    """The node of a name; of several the innermost around the line, else the first by file and line."""
    here = F.lit(False) if line is None else (F.least("start_line", "end_line") <= line) & (F.greatest("start_line", "end_line") >= line)
    return nodes.where(F.col("name") == name).orderBy(F.coalesce(here, F.lit(False)).desc(), F.when(here, -F.col("start_line")), "file_path", "start_line", "id").limit(1)


def explore(nodes: DataFrame, texts: DataFrame, terms: list[str], max_files: int = 5, lines_each: int = 40) -> DataFrame:
    """(file_path, line, content): lines that name one of the terms in the files that define most of them."""
    hits = nodes.where(F.col("name").isin(terms)).groupBy("file_path").agg(F.countDistinct("name").alias("n")).orderBy(F.desc("n"), "file_path").limit(max_files)
    pattern = r"\b(" + "|".join(map(re.escape, terms)) + r")\b"
    rows = hits.join(texts.select(F.col("path").alias("file_path"), "text"), "file_path")
    found = F.filter(F.transform(F.split("text", "\n"), lambda l, k: F.struct((k + 1).alias("line"), l.alias("content"))), lambda x: x["content"].rlike(pattern))
    return rows.select("file_path", F.explode(F.slice(found, 1, lines_each)).alias("x")).select("file_path", "x.line", "x.content")


def file_tree(files: DataFrame, depth: int = 4, prefix: str = "") -> DataFrame:
    """(directory, level, files): directories down to a depth with the number of files below."""
    p = files.where(F.col("path").startswith(prefix))
    dirs = scoring.directories(F.col("path"))
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(dirs), F.lit(depth))), lambda n: F.struct(F.array_join(F.slice(dirs, F.lit(1), n), "/").alias("directory"), n.alias("level")))
    return p.where(F.size(dirs) > 0).select(F.explode(each).alias("d")).groupBy("d.directory", "d.level").agg(F.count("*").alias("files"))


def status_json(stats: DataFrame) -> DataFrame:
    """One row of JSON with all statistics."""
    return stats.agg(F.to_json(F.array_sort(F.collect_list(F.struct("metric", "key", "value")))).alias("status"))  # a row per kind and language


def render_terms(task: str) -> list[str]:
    return [t for s in symbols_in(task) for t in s.split(".")] or re.findall(r"\w{3,}", task)


def prose_to_names(nodes: DataFrame, task: str) -> DataFrame:
    """(name, matches): names whose words occur in the prose of a task, commonest first."""
    spark = nodes.sparkSession
    words = spark.createDataFrame([(task,)], "t string").select(F.explode(text.prose_candidates("t")).alias("word")).select("word", F.explode(text.lookup_variants("word")).alias("segment"))
    names = nodes.select("name").distinct().select("name", F.explode(text.identifier_segments("name")).alias("segment"))
    return names.join(F.broadcast(words), "segment").groupBy("name").agg(F.countDistinct("word").alias("matches"))  # at most 48 words
