"""Table sinks: versions published whole, keyed upserts and cascading deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table, the oldest first."""
    return sorted(n for n in folders(spark, path) if n.startswith("version-") and exists(spark, f"{path}/{n}/_SUCCESS"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a published table, None if there is none."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def publish(spark: SparkSession, df: DataFrame, path: str, keep: int = 2) -> None:
    """Write the next version of a table beside the last one; it counts once its success mark stands.

    A reader always finds a whole version, and one that began before goes on
    with the version before; older ones are removed.
    """
    found = _versions(spark, path)
    number = int(found[-1].split("-")[1]) + 1 if found else 0
    df.write.mode("overwrite").parquet(f"{path}/version-{number:012d}")  # an unfinished try of the same number is replaced
    for old in found[: max(0, len(found) + 1 - keep)]:
        remove(spark, f"{path}/{old}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` replaces rows of `old` with its keys; of several new rows with one key one stays, the greatest."""
    order = [F.col(c).desc_nulls_last() for c in new.columns if c not in keys and not new.schema[c].dataType.typeName() == "map"]
    one = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)])))).where("_r = 1").drop("_r")
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with all five required fields; defaults filled in."""
    need = ["id", "kind", "name", "file_path", "language"]
    ok = nodes.where(" and ".join(f"length({c}) > 0" for c in need))
    fill = {"start_line": 0, "end_line": 0, "start_column": 0, "end_column": 0}
    flags = ["is_exported", "is_async", "is_static", "is_abstract"]
    cols = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in nodes.columns}
    cols |= {c: F.coalesce(F.col(c), F.lit(False)) for c in flags if c in nodes.columns}
    if "qualified_name" in nodes.columns:
        cols["qualified_name"] = F.coalesce("qualified_name", "name")
    return ok.withColumns(cols) if cols else ok


EDGE_IDENTITY = ["source", "target", "kind", "line", "col"]


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per edge identity; null line and col count as -1."""
    e = edges.withColumns({"line": F.coalesce("line", F.lit(-1)), "col": F.coalesce("col", F.lit(-1))})
    return e.dropDuplicates(EDGE_IDENTITY)


def attached_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist, without repeats."""
    ids = nodes.select("id").distinct()
    return unique_edges(edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def delete_files(paths: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cascade: nodes of the files, edges at those nodes, the file rows."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept_nodes = nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept_nodes, kept_edges, files.join(paths.select("path"), "path", "left_anti")
