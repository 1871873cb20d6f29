"""The graph as a store: one step that takes a batch of indexed files in, as a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.resolve import retargeted
from codeloom.runtime import materialise
from codeloom.sources import sinks
from codeloom.sources.extract import extract

SCHEMA_VERSION = 8


def apply_batch(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a batch.

    Files whose content_hash is unchanged are skipped. For the rest, in this
    order: incoming edges from other files are kept aside, the old rows of the
    file are deleted with all edges at them, the new rows come in, and the
    kept edges are led to the new node of the same kind and name. Invalid
    nodes and edges without both ends are left out.
    """
    known = files.select("path", F.col("content_hash").alias("old"))
    changed = new_files.join(known, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("old"))).drop("old")
    paths = changed.select("path")
    mine = F.col("file_path")
    fresh = sinks.valid_nodes(new_nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    old = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    inside = old.select("id")
    incoming = edges.join(inside.withColumnRenamed("id", "target"), "target", "left_semi").join(inside.withColumnRenamed("id", "source"), "source", "left_anti")
    kept = retargeted(incoming, old, fresh)
    left_nodes, left_edges, left_files = sinks.delete_files(paths, nodes, edges, files)
    all_nodes = left_nodes.unionByName(fresh.select(*left_nodes.columns))
    cols = ["source", "target", "kind", "line", "col"]
    came = new_edges.join(new_nodes.select(F.col("id").alias("source"), mine), "source").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*cols)
    all_edges = sinks.attached_edges(left_edges.select(*cols).unionByName(came).unionByName(kept.select(*cols)), all_nodes)
    return all_nodes, all_edges, left_files.unionByName(changed.select(*left_files.columns))


def pending_migrations(applied: list[int], known: list[int]) -> list[int]:
    """Versions to apply, in order."""
    return sorted(set(known) - set(applied))


def upgraded(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table with every column of a newer schema, new ones null; to apply it twice changes nothing."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def index_files(texts: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after one file or a list of them (path, language, text) was indexed again at a time.

    Texts whose hash is stored already are not extracted. Columns that an
    extractor does not know are null.
    """
    hashed = texts.where("path is not null and text is not null").withColumn("content_hash", F.sha2("text", 256))
    fresh = materialise(hashed.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_anti").dropDuplicates(["path"]))
    rows = materialise(extract(fresh))
    kinds = {f.name: f.dataType for f in nodes.schema}
    found = rows.where("tag = 'node'").withColumn("updated_at", F.lit(at))
    new_nodes = found.select(*((F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    new_edges = rows.where("tag = 'edge'").select("source", "target", "kind", "line", F.lit(None).cast("int").alias("col"))
    counts = found.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("node_count"))
    stored = fresh.join(counts, "path", "left").withColumns({"size": F.octet_length("text"), "indexed_at": F.lit(at)})
    new_files = stored.select(*((F.col(f.name) if f.name in stored.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in files.schema))
    return apply_batch(nodes, edges, files, new_nodes, new_edges, new_files)
