"""Queries of the text operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import documented, handwritten, invalid_files, leakage, packing, sentences, splitting
from codeloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files.judge_files(table(spark, d, "documents"), table(spark, d, "files")).where("valid = false").select("path")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files.invalid_rates(invalid_files.judge_files(table(spark, d, "documents"), table(spark, d, "files")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify_files(table(spark, d, "documents"), table(spark, d, "files")).where("reason is not null").select("path")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = handwritten.classify_files(table(spark, d, "documents"), table(spark, d, "files"))
    return rows.groupBy("repo", "language", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(*(table(spark, d, t) for t in ("nodes", "files", "size_limits", "documents")), content=False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item over its limit has a first piece."""
    return _pieces(spark, d).where("piece = 0").select("item_type", "item_key")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("item_type", "item_key", "piece", "begin", "finish")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a comment attached by the join; the recorded docstring has to hold the same words."""
    return documented.documented_functions(table(spark, d, "nodes"), table(spark, d, "documents")).where("origin = 'confirmed'").select("node_id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.pairs(table(spark, d, "nodes"), table(spark, d, "documents"))


def _contexts(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "size_limits").where("unit = 'tokens'").select("limit_name", "capacity").collect()
    return {r.limit_name: r.capacity for r in rows}


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, d, "documents")), _contexts(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    limits = _contexts(spark, d)
    return packing.fill_report(packing.pack(packing.token_sizes(table(spark, d, "documents")), limits), limits)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    found = leakage.find_leaks(table(spark, d, "documents"), items).select("doc_id", "item_id").distinct()
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(per, "item_id", "left").groupBy("suite", "split").agg(F.count("*").alias("items"), F.count("documents").alias("leaked"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left for training: affected ones are removed."""
    docs = table(spark, d, "documents")
    return leakage.without_leaked(docs, leakage.find_leaks(docs, table(spark, d, "eval_items"))).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents").where("not source <=> 'file'")).select("doc_id", "end_offset")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_reasons, p5_found, p5_pieces, p6_found, p6_pairs, p8_pack, p8_fill, p9_found, p9_report, p9_kept, p10_found)}

SQL = {
    "p5_found": """
      select 'node' item_type, id item_key from (
        select id, unnest(max(struct_pack(updated_at, kind, file_path, start_line, end_line))) from nodes group by id)
      where kind not in ('file', 'module', 'namespace') and abs(end_line - start_line) + 1 > (select capacity from size_limits where limit_name = 'node_span')
      union all
      select 'file', path from (select path, arg_max(struct_pack(size := size), indexed_at).size s from files group by path)
      where s > (select capacity from size_limits where limit_name = 'file_text')""",
}
