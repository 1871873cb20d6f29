"""Edges that no reference states: events, observers, callbacks, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import enclosing
from codeloom.operators.resolve import channel_pairs

_EMIT = r"\b(?:emit|dispatch|trigger|publish|fire)\(\s*['\"]([\w:.-]+)['\"]"
_ON = r"\b(?:on|once|subscribe|addListener|addEventListener)\(\s*['\"]([\w:.-]+)['\"]"
_REGISTER = r"\bthis\.(\w+)\.(?:push|add|append|set)\("
_DISPATCH = r"\bthis\.(\w+)\.(?:forEach|map)\(|\bof\s+this\.(\w+)"
_ANNOTATED = r"^@?(?:Override|Bean|EventListener|KafkaListener|Scheduled|Subscribe|Async|Transactional)\b"


def pattern_points(texts: DataFrame, pattern: str, column: str, group: int = 1) -> DataFrame:
    """(file_path, line, column): matches of a pattern with their lines; texts without a match are not cut into lines."""
    lines = texts.where(F.col("text").rlike(pattern)).select(F.col("path").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("k", "l"))
    return lines.where(F.col("l").rlike(pattern)).select("file_path", (F.col("k") + 1).alias("line"), F.regexp_extract("l", pattern, group).alias(column)).where(F.col(column) != "")


def event_edges(nodes: DataFrame, texts: DataFrame, cap: int = 6) -> DataFrame:
    """(source, target, event): functions that emit an event and functions that listen to it; events with more than `cap` on either side are too general."""
    around = lambda p: enclosing(pattern_points(texts, p, "event"), nodes).where("enclosing is not null").select(F.col("enclosing").alias("id"), "event").distinct()
    return channel_pairs(around(_EMIT), around(_ON), "event", cap)


def observer_edges(nodes: DataFrame, texts: DataFrame, cap: int = 40) -> DataFrame:
    """(source, target, field): within a file, the function that walks a collection field and those that register in it."""
    reg = enclosing(pattern_points(texts, _REGISTER, "field"), nodes).where("enclosing is not null").select("file_path", "field", F.col("enclosing").alias("target")).distinct()
    dis = pattern_points(texts, _DISPATCH, "field", 1).unionByName(pattern_points(texts, r"\bof\s+this\.(\w+)", "field"))
    dis = enclosing(dis, nodes).where("enclosing is not null").select("file_path", "field", F.col("enclosing").alias("source")).distinct()
    small = reg.groupBy("file_path", "field").count().where(F.col("count") <= cap).select("file_path", "field")
    return dis.join(reg.join(small, ["file_path", "field"], "left_semi"), ["file_path", "field"]).where("source <> target").select("source", "target", "field").distinct()


def route_edges(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """(source, target, route): the file of a framework route and the one callable of its handler's name, that of the same file first."""
    name = F.regexp_extract("handler", r"(\w+)$", 1)
    calls = nodes.where("kind in ('function', 'method', 'class')").select(F.col("id").alias("target"), F.col("name").alias("h"), F.col("file_path").alias("path2"))
    named = routes.withColumn("h", name)
    here = named.join(calls, "h").where("path = path2").groupBy("path", "route", "method", "h").agg(F.min("target").alias("target"))
    only = calls.groupBy("h").agg(F.count("*").alias("n"), F.min("target").alias("any_target")).where("n = 1")
    files = nodes.where("kind = 'file'").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("source"))
    both = named.join(here, ["path", "route", "method", "h"], "left").join(only, "h", "left").withColumn("target", F.coalesce("target", "any_target"))
    return both.where("target is not null").join(files, "path").select("source", "target", "route").distinct()


def callback_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): components and the handlers they contain: members named handleX or onX."""
    members = edges.where("kind = 'contains'").join(nodes.where(F.col("name").rlike("^(handle|on)[A-Z]")).select(F.col("id").alias("target")), "target")
    owners = nodes.where("kind in ('component', 'class', 'function')").select(F.col("id").alias("source"))
    return members.join(owners, "source", "left_semi").select("source", "target").distinct()


def annotated_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): types and their methods that a framework calls by annotation."""
    methods = nodes.where(F.exists("decorators", lambda d: d.rlike(_ANNOTATED))).select(F.col("id").alias("target"))
    return edges.where("kind = 'contains'").join(methods, "target", "left_semi").select("source", "target").distinct()


def receiver_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): Go types and methods of theirs in other files of the directory; by the receiver in the qualified name."""
    go = nodes.where("language = 'go'").withColumn("dir", F.regexp_replace("file_path", "/?[^/]*$", ""))
    types = go.where("kind in ('struct', 'interface')").select(F.col("id").alias("source"), F.col("name").alias("owner"), "dir", F.col("file_path").alias("f1"))
    methods = go.where("kind = 'method'").select(F.col("id").alias("target"), F.split_part("qualified_name", F.lit("::"), F.lit(1)).alias("owner"), "dir", F.col("file_path").alias("f2"))
    return types.join(methods, ["owner", "dir"]).where("f1 <> f2").select("source", "target").distinct()
