"""What can be plugged in: stores, searches, embedders, chunkers, synthesis passes, node filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


class VectorStore(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class TextSearch(Protocol):
    def search(self, query: str, k: int) -> DataFrame: ...


class Embedder(Protocol):
    """Vectors of a batch of texts; may raise where the service is away."""

    dimension: int

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Chunker(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame: ...


class SynthesisPass(Protocol):
    """nodes, edges, texts -> edges (source, target)."""

    name: str

    def run(self, nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame: ...


NodeFilter = Callable[[DataFrame], Column]


def synthesised(passes: Sequence[SynthesisPass], nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, target, pass) of all passes; an edge of several passes names the first."""
    out = None
    for k, p in enumerate(passes):
        rows = p.run(nodes, edges, texts).select("source", "target", F.lit(k).alias("k"), F.lit(p.name).alias("pass"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("source", "target").agg(F.min(F.struct("k", "pass")).alias("m")).select("source", "target", F.col("m.pass").alias("pass"))


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, keep: NodeFilter) -> tuple[DataFrame, DataFrame]:
    """The nodes that a filter keeps and the edges between them."""
    from codeloom.operators.graph import subgraph

    kept = nodes.where(keep(nodes))
    return kept, subgraph(kept, edges)


def embedded(texts: DataFrame, key: str, column: str, embed: Embedder, batch: int = 256) -> DataFrame:
    """(key, embedding) of texts in batches; where the embedder fails, or the text is null, a vector of zeros stands."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = [0.0] * embed.dimension
        for b in parts:
            out = []
            for at in range(0, len(b), batch):
                some = b[column].iloc[at : at + batch].tolist()
                try:
                    vectors = iter(embed([t for t in some if t is not None]))
                    out += [list(map(float, next(vectors))) if t is not None else zero for t in some]
                except Exception:
                    out += [zero] * len(some)
            yield pd.DataFrame({key: b[key], "embedding": out})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, column).mapInPandas(run, f"{key} {kind}, embedding array<float>")
