"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import materialise, spread

#: Ranks of a public byte-pair vocabulary, on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary cuts text before merging; fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str = VOCABULARY, stretch: int = 1_000_000) -> int:
    """Tokens of a whole text. Long texts are encoded in stretches that end with a visible piece of the split rule.

    No token crosses a piece, and the rule looks behind no piece, so the sum
    is that of the whole; a piece longer than a stretch is encoded whole.
    """
    enc = _encoder(vocabulary)
    text = text.encode("utf-8", "replace").decode("utf-8")
    if len(text) <= stretch:
        return len(enc.encode_ordinary(text))
    import regex

    n, at, end = 0, 0, 0
    for m in regex.finditer(_SPLIT, text):
        if end - at >= stretch:
            n += len(enc.encode_ordinary(text[at:end]))
            at = end
        if not m[0][-1].isspace():
            end = m.end()
    return n + len(enc.encode_ordinary(text[at:]))


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens); a null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [token_count(t, vocabulary) if t else 0 for t in b["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(count, "doc_id bigint, tokens int")


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, list[tuple[int, int]]], int]:
    """Best fit for all size classes: (segments, gaps, containers).

    A superstep takes one size, the largest first. Its documents meet the open
    gaps in a successor sweep: the run of containers with the smallest gap
    that fits, then the next. Conflicts are resolved by rank: the documents of
    ranks [first, first + n) go to the containers from `container` on, `per`
    to each. Then the gaps are updated; what is left opens new containers.
    Segment: (size, first, n, container, per). Gaps: size of gap to runs
    (container, count). A run holds all containers that were opened and filled
    alike; each segment splits at most one run in three, so runs and segments
    grow with the distinct sizes (at most the capacity) and not with the
    documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out, containers = [], 0

    def put(gap: int, start: int, count: int) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((start, count))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, first = histogram[size], 0
        while left:
            k = bisect_left(order, size)
            if k == len(order):
                per = capacity // size
                n = -(-left // per)
                start, count, gap = containers, n, capacity
                containers += n
            else:
                gap = order[k]
                start, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            per = gap // size
            taken = min(left, per * count)
            full, rest = divmod(taken, per)
            out.append((size, first, taken, start, per))
            put(gap - per * size, start, full)
            if rest:
                put(gap - rest * size, start + full, 1)
            put(gap, start + full + bool(rest), count - full - bool(rest))
            left, first = left - taken, first + taken
    if n := histogram.get(0, 0):  # texts without tokens take no room and are spread evenly
        if not containers:
            containers = 1
            put(capacity, 0, 1)
        per = -(-n // containers)
        out.append((0, 0, n, 0, per))
    return out, gaps, containers


def pack(sizes: DataFrame, limits: dict[str, int], partitions: int | None = None) -> DataFrame:
    """(limit_name, container, doc_id, piece, begin, tokens) of every document for every capacity.

    A text that alone exceeds the capacity is cut into full pieces and a
    rest, token ranges [begin, begin + tokens); any other goes whole. Every
    document appears; null sizes count as 0. Repeated doc_ids are separate
    documents.

    Documents are range-sorted by size, largest first, which also splits a
    size that a third of all documents share; a document's rank is its place
    in its sorted partition plus the counts of those before. The plan comes
    from the counts per size (at most capacity + 1 per limit) and is an array
    of rank intervals in which every document looks up its container.
    """
    spark = sizes.sparkSession
    names = sorted(limits)
    sizes = materialise(sizes)  # the range sort reads them twice, and counting tokens costs the most
    n = F.coalesce("tokens", F.lit(0))

    def cut(k: int, c: int):
        """The pieces of a document under one limit."""
        piece = lambda i: F.struct(F.lit(k).alias("limit"), i.alias("piece"), F.least(n - i * c, F.lit(c)).cast("int").alias("size"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(c)), F.lit(1)).cast("int") - 1), piece)

    cuts = [cut(k, limits[name]) for k, name in enumerate(names)]
    rows = sizes.select("doc_id", F.explode(F.concat(*cuts)).alias("p")).select("doc_id", "p.*")
    parts_wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = materialise(
        rows.repartitionByRange(parts_wanted, "limit", F.desc("size"), "doc_id", "piece").sortWithinPartitions("limit", F.desc("size"), "doc_id", "piece").withColumn("place", F.monotonically_increasing_id())
    )
    counts = sorted((r.part, r["count"]) for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    offset, total = {}, 0
    for part, c in counts:
        offset[part] = total
        total += c
    by_size: dict[int, dict[int, int]] = {k: {} for k in range(len(names))}
    for r in ranked.groupBy("limit", "size").count().collect():
        by_size[r.limit][r.size] = r["count"]
    segments, at = [], 0  # (rank from, rank to, container, per)
    for k, name in enumerate(names):
        runs, _, _ = plan_runs(by_size[k], limits[name])
        start_of, run_at = {}, at
        for s in sorted(by_size[k], reverse=True):
            start_of[s] = run_at
            run_at += by_size[k][s]
        segments += [(start_of[s] + first, container, per) for s, first, _, container, per in runs]
        at = run_at
    segments.sort()
    starts, containers, pers = (np.array([s[i] for s in segments], dtype=np.int64) for i in range(3))
    parts = np.array([p for p, _ in counts], dtype=np.int64)
    offsets = np.array([offset[p] for p, _ in counts], dtype=np.int64)
    shared = spark.sparkContext.broadcast((starts, containers, pers, parts, offsets))
    capacity = np.array([limits[x] for x in names], dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, containers, pers, parts, offsets = shared.value
        for b in batches:
            mid = b["place"].to_numpy()
            rank = offsets[np.searchsorted(parts, mid >> 33)] + (mid & ((1 << 33) - 1))
            seg = np.searchsorted(starts, rank, side="right") - 1
            limit = b["limit"].to_numpy()
            yield pd.DataFrame(
                {
                    "limit_name": [names[k] for k in limit],
                    "container": containers[seg] + (rank - starts[seg]) // pers[seg],
                    "doc_id": b["doc_id"],
                    "piece": b["piece"],
                    "begin": b["piece"].to_numpy() * capacity[limit],
                    "tokens": b["size"],
                }
            )

    return ranked.mapInPandas(place, "limit_name string, container bigint, doc_id bigint, piece int, begin bigint, tokens int")


def fill_report(packed: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per limit: containers, documents, share of room used."""
    cap = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))[F.col("limit_name")]
    per = packed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    return per.groupBy("limit_name").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"), F.round(F.sum("used") / F.sum(cap), 6).alias("filled")
    )
