"""Tables as the catalogue reads them, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import attached, clean_edges, newest_nodes
from codeloom.runtime import materialise, table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return newest_nodes(table(spark, d, "nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return clean_edges(table(spark, d, "edges"))


def graph(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (the given columns) and the edges between them, written once for walks that read them again and again."""
    n = materialise(nodes(spark, d).select("id", *columns))
    return n, materialise(attached(edges(spark, d), n))


def files(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash", "language", "size", "node_count")).alias("m"))
    return m.select("path", "m.*")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, language, text) of file documents; the language is that of the extension."""
    from codeloom.sources.scan import detect_language

    t = table(spark, d, "documents").where("source = 'file' and path is not null and text is not null")
    return t.select("path", detect_language(F.col("path")).alias("language"), "text")


KEY = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
N = "n as (select * exclude (r, qualified_name), coalesce(qualified_name, name) qualified_name from (select *, row_number() over (partition by id order by updated_at desc) r from nodes) where r = 1)"
E0 = f"e0 as (select distinct {KEY.format(c='source')} source, {KEY.format(c='target')} target, lower(trim(kind)) kind, coalesce(line, -1) line, coalesce(col, -1) col from edges)"
E = f"{E0}, e as (select * from e0 where source in (select id from n) and target in (select id from n))"
FILES = "f as (select path, arg_max(content_hash, indexed_at) content_hash, arg_max(language, indexed_at) as language, arg_max(struct_pack(s := size), indexed_at).s size from files group by path)"
TEXTS = "t as (select path, text from documents where source = 'file' and path is not null and text is not null)"
W = f"with {N}, {E}"
R = f"with recursive {N}, {E}"
LIFT = """own as (select target id, min(source) o from e join n on n.id = source where e.kind = 'contains' and n.kind in ('class', 'struct', 'interface') group by 1),
  lift as (select distinct coalesce(a.o, e.source) source, coalesce(b.o, e.target) target, e.kind from e left join own a on a.id = e.source left join own b on b.id = e.target where e.kind in ('extends', 'implements'))"""
