"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import spread

def newest_files(files: DataFrame) -> DataFrame:
    """(path, language, size, first_seen) of the newest row by indexed_at of each path, with the least time; ties take the greatest row. Null paths are left out."""
    rows = files.where("path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "language", "size")).alias("m"), F.min("indexed_at").alias("first_seen"))
    return rows.select("path", F.lower("m.language").alias("language"), F.col("m.size").alias("size"), "first_seen")


def file_texts(documents: DataFrame, *columns: str) -> DataFrame:
    return documents.where("source = 'file' and path is not null and text is not null").select("path", *columns)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from codeloom.llm.syntax import readings

    for b in batches:
        rows = [(p, *readings(t), not t.strip()) for p, t in zip(b["path"], b["text"])]
        yield pd.DataFrame(rows, columns=["path", "takes", "unsure", "blank"])


def judge_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(path, repo, language, valid, other): each file text against the grammar of its newest files row.

    Every text is parsed against all grammars where it is read, in the order
    of its tokens, whatever its name; only the list of those that take it
    meets the language. `other` is the likeliest that takes a text which its
    own refuses (a wrong extension), null if none does (corruption). `valid`
    is null for languages without grammar and where the parser met a limit of
    its own. Blank text is valid in all languages but JSON and Go. Paths without
    files row, text or path are left out; repeated rows of a path count once
    (invalid wins).
    """
    from codeloom.llm.syntax import GRAMMARS

    verdicts = spread(file_texts(documents, "text")).mapInPandas(_judge, "path string, takes array<string>, unsure array<string>, blank boolean")
    rows = verdicts.join(newest_files(files).select("path", "language"), "path")
    known = F.col("language").isin(*GRAMMARS)
    valid = F.when(~known | F.array_contains("unsure", F.col("language")), None).otherwise(F.array_contains("takes", F.col("language")))
    other = F.when(valid.eqNullSafe(False) & ~F.col("blank"), F.try_element_at("takes", F.lit(1)))
    out = rows.select("path", "language", valid.alias("valid"), other.alias("other")).groupBy("path", "language").agg(F.min("valid").alias("valid"), F.max("other").alias("other"))
    return out.withColumn("repo", F.split_part("path", F.lit("/"), F.lit(1)))


def invalid_rates(judged: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones, those in another language, rate of invalid ones."""
    bad = F.col("valid").eqNullSafe(False)
    return judged.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("invalid"),
        F.count_if(bad & F.col("other").isNotNull()).alias("wrong_extension"),
        F.round(F.count_if(bad) / F.count("*"), 6).alias("rate"),
    )
