"""Statistics over nodes, edges and files, and window operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions import scoring, text


def graph_stats(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(metric, key, value): totals and counts by kind and language."""
    by = lambda d, c, m: d.groupBy(F.coalesce(F.col(c), F.lit("")).alias("key")).agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "key", "value")
    total = lambda d, m: d.agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), F.lit("").alias("key"), "value")
    return by(nodes, "kind", "nodes").unionByName(by(edges, "kind", "edges")).unionByName(by(files, "language", "files")).unionByName(total(nodes, "total_nodes")).unionByName(total(edges, "total_edges")).unionByName(total(files, "total_files"))


def dominant_files(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """(file_path, inner_edges, runner_up): files by edges within them; tests and generated files leave after the top rows are taken."""
    a = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("f1"))
    b = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("file_path"))
    counts = edges.join(a, "source").join(b, "target").where("f1 = file_path").groupBy("file_path").agg(F.count("*").alias("inner_edges"))
    best = counts.orderBy(F.desc("inner_edges"), "file_path").limit(top)
    w = Window.orderBy(F.desc("inner_edges"), "file_path")  # at most `top` rows
    return best.where(~scoring.is_low_value(F.col("file_path"))).withColumn("runner_up", F.lead("inner_edges").over(w))


def concentration(nodes: DataFrame, kind: str, top: int = 20) -> DataFrame:
    """(file_path, n, share): files by nodes of one kind with their share of the top rows."""
    best = nodes.where(F.col("kind") == kind).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(top).where(~scoring.is_low_value(F.col("file_path")))
    return best.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def routing_manifest(nodes: DataFrame, edges: DataFrame, route_kind: str = "route", limit: int = 40) -> DataFrame:
    """(route, handler, handler_file): routes and the callables and classes they lead to by references or calls."""
    r = nodes.where(F.col("kind") == route_kind).select(F.col("id").alias("source"), F.col("name").alias("route"))
    h = nodes.where("kind in ('function', 'method', 'class')").select(F.col("id").alias("target"), F.col("name").alias("handler"), F.col("file_path").alias("handler_file"))
    rows = edges.where("kind in ('references', 'calls')").join(r, "source").join(h, "target").select("route", "handler", "handler_file", "source", "target").distinct()
    return rows.orderBy("route", "source", "handler", "target").limit(limit).where(~scoring.is_low_value(F.col("handler_file"))).select("route", "handler", "handler_file")


def segment_vocabulary(nodes: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class", "interface", "struct")) -> DataFrame:
    """(segment, name): the words of the distinct names of some kinds."""
    return nodes.where(F.col("kind").isin(*kinds)).select("name").distinct().select("name", F.explode(text.identifier_segments("name")).alias("segment")).select("segment", "name")


def segment_matches(vocabulary: DataFrame, words: list[str], least: int = 2) -> DataFrame:
    """(name, matches): names in which at least `least` of the words occur, in any of their lookup forms."""
    spark = vocabulary.sparkSession
    forms = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.explode(text.lookup_variants("word")).alias("segment"))
    hits = vocabulary.join(F.broadcast(forms), "segment")  # a query's words
    return hits.groupBy("name").agg(F.countDistinct("word").alias("matches")).where(F.col("matches") >= least)


def module_structure(files: DataFrame) -> DataFrame:
    """(directory, files, languages): files of each directory, counted."""
    return files.groupBy(F.array_join(scoring.directories(F.col("path")), "/").alias("directory")).agg(F.count("*").alias("files"), F.countDistinct("language").alias("languages"))


def repo_summary(files: DataFrame) -> DataFrame:
    """(repo, metric, key, value): files, directories and languages of each repository."""
    repo = F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(scoring.directories(F.col("path"))), F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    a = files.groupBy(repo).agg(F.count("*").alias("value")).select("repo", F.lit("files").alias("metric"), F.lit("").alias("key"), "value")
    b = files.select(repo, F.explode(dirs).alias("d")).distinct().groupBy("repo").agg(F.count("*").alias("value")).select("repo", F.lit("directories").alias("metric"), F.lit("").alias("key"), "value")
    c = files.groupBy(repo, F.col("language").alias("key")).agg(F.count("*").alias("value")).select("repo", F.lit("language").alias("metric"), "key", "value")
    return a.unionByName(b).unionByName(c)


def running_budget(rows: DataFrame, group: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def split_point(rows: DataFrame, group: str, order: str, cost: Column, keep: int, is_boundary: Column) -> DataFrame:
    """(group, split): where to cut each group: the first boundary row among the newest rows within `keep`."""
    return running_budget(rows, group, order, cost, keep).where(is_boundary).groupBy(group).agg(F.min(order).alias("split"))


def pruned(rows: DataFrame, group: str, order: str, column: str, is_prunable: Column, keep: int = 6, marker: str = "[pruned]") -> DataFrame:
    """Prunable texts beyond the newest `keep` rows of each group are replaced by a marker."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    old = F.row_number().over(w) > keep
    return rows.withColumn("_old", old).withColumn(column, F.when(F.col("_old") & is_prunable, F.lit(marker)).otherwise(F.col(column))).drop("_old")


def greedy_pack(items: Column, budget: int) -> Column:
    """Names of an array of structs (name, cost), in order, that fit one after the other; one that does not fit is passed over."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("names"))
    step = lambda s, i: F.when(s["used"] + i["cost"] <= budget, F.struct((s["used"] + i["cost"]).alias("used"), F.array_append(s["names"], i["name"]).alias("names"))).otherwise(s)
    return F.aggregate(items, start, step)["names"]


def read_lines(texts: DataFrame, key: str, offset: int, limit: int, max_bytes: int) -> DataFrame:
    """(key, line, content): lines from a 1-based offset, at most `limit`, stopping before max_bytes bytes."""
    lines = F.slice(F.split("text", "\n"), F.lit(offset), F.lit(limit))
    cost = lambda l: F.octet_length(l) + 1
    fit = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(True).alias("go")),
        lambda s, l: F.struct(
            (s["n"] + F.when(s["go"] & (s["b"] + cost(l) <= max_bytes), 1).otherwise(0)).alias("n"),
            (s["b"] + cost(l)).alias("b"),
            (s["go"] & (s["b"] + cost(l) <= max_bytes)).alias("go"),
        ),
    )["n"]
    return texts.select(key, F.posexplode(F.slice(lines, F.lit(1), fit)).alias("k", "content")).select(key, (F.col("k") + offset).alias("line"), "content")


def line_chunks(texts: DataFrame, key: str, size: int = 81, overlap: int = 5) -> DataFrame:
    """(key, chunk, start_line, end_line, content): windows of lines; the last one ends with the text."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    step = size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    rows = texts.where("text is not null").select(key, lines.alias("lines"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    first = F.col("chunk") * step + 1
    return rows.select(key, "chunk", first.alias("start_line"), F.least(first + size - 1, F.size("lines")).alias("end_line"), F.array_join(F.slice("lines", first, F.lit(size)), "\n").alias("content"))


def node_chunks(nodes: DataFrame) -> DataFrame:
    """(id, content, node_kind, symbol_name): what is embedded of a node: its signature or name."""
    return nodes.where("kind not in ('file', 'import', 'export', 'parameter', 'module', 'namespace')").select("id", F.coalesce("signature", "name").alias("content"), F.col("kind").alias("node_kind"), F.col("name").alias("symbol_name"))


def grep(texts: DataFrame, key: str, pattern: str, width: int = 200) -> DataFrame:
    """(key, line, content): lines that match, cut to a width."""
    rows = texts.where(F.col("text").rlike(pattern)).select(key, F.posexplode(F.split("text", "\n")).alias("k", "content"))
    return rows.where(F.col("content").rlike(pattern)).select(key, (F.col("k") + 1).alias("line"), F.left("content", F.lit(width)).alias("content"))
