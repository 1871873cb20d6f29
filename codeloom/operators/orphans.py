"""References to records that do not exist.

State per key: signed counts of references, of existence and of deletion,
with the first times of both. Counts are additive, so a run folds the deltas
of a period into the state of the last one; keys that are referenced and do
not exist form the current orphan report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import likely_in, materialise, packed_key, skewed_join
from codeloom.sources.sinks import current, publish

_COUNTS = ("refs", "exists", "deletions")


def _delta(df: DataFrame, key, **cols) -> DataFrame:
    base = {"refs": F.lit(0), "exists": F.lit(0), "deletions": F.lit(0), "first_seen": F.lit(None), "first_ref": F.lit(None)}
    picked = base | cols
    return df.select(key.alias("key"), *(picked[k].cast("bigint").alias(k) for k in base)).where("key is not null")


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge; a null or blank end names no record and is left out."""
    side = lambda s: F.struct(F.lit(s).alias("side"), packed_key(s).alias("key"))
    return (
        edges.select(F.col("id").alias("edge_id"), F.lower(F.btrim("kind")).alias("kind"), "recorded_at", F.explode(F.array(side("source"), side("target"))).alias("e"))
        .select("edge_id", "kind", "recorded_at", "e.side", "e.key")
        .where("key is not null and length(key) > 1")
    )


def reference_deltas(edges: DataFrame, sign: int = 1) -> DataFrame:
    """+1 (or, for retracted edges, -1) for each end."""
    return _delta(edge_ends(edges), F.col("key"), refs=F.lit(sign), first_ref=F.col("recorded_at"))


def existence_deltas(nodes: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(nodes, packed_key("id"), exists=F.lit(sign), first_seen=F.col("updated_at"))


def deletion_deltas(deletions: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(deletions, packed_key("id"), deletions=F.lit(sign))


def fold(*parts: DataFrame) -> DataFrame:
    """Signed counts per key over states and deltas. Partial sums are made before the shuffle, so a hot key costs one row per task."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("key").agg(*(F.sum(c).alias(c) for c in _COUNTS), F.min("first_seen").alias("first_seen"), F.min("first_ref").alias("first_ref"))


def suspects(state: DataFrame) -> DataFrame:
    """Keys with references and no existence, or first seen after their first reference."""
    return state.where("refs > 0 and (exists <= 0 or first_seen > first_ref)")


def find_orphans(nodes: DataFrame, edges: DataFrame, deletions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(edge_id, side, kind, recorded_at, key, state) of every end without a record at its time.

    state: `deleted` (not in nodes, in deletions), `missing` (in neither),
    `late` (the smallest updated_at in nodes is greater than recorded_at; a
    null time on either side is never late). Repeated rows count once. An
    empty edges table gives no rows; empty nodes make every end missing or
    deleted. Extra columns are ignored. The counts are folded from the tables
    as one delta each, or are given as the kept `state` of earlier runs.

    Only ends that a filter of the suspects lets through are moved. One
    missing id may hold a third of them: the counts say into how many parts
    each key is cut.
    """
    if state is None:
        state = fold(reference_deltas(edges), existence_deltas(nodes), deletion_deltas(deletions))
    bad = materialise(suspects(state).select("key", "refs", "exists", "deletions", "first_seen"))
    ends = likely_in(edge_ends(edges), F.col("key"), bad, F.col("key"))
    found = skewed_join(ends, bad, "key", "refs", ["edge_id", "side", "recorded_at"]).withColumn(
        "state",
        F.when(F.col("exists") > 0, F.when(F.col("first_seen") > F.col("recorded_at"), F.lit("late"))).when(F.col("deletions") > 0, "deleted").otherwise("missing"),
    )
    return found.where("state is not null").select("edge_id", "side", "kind", "recorded_at", "key", "state")


def next_state(spark: SparkSession, target: str, *deltas: DataFrame) -> DataFrame:
    """Fold signed deltas of a period into the state kept at `target` and publish the result as its next version."""
    kept = current(spark, target)
    publish(spark, fold(*([kept] if kept is not None else []), *deltas).where("refs <> 0 or exists <> 0 or deletions <> 0"), target)
    return current(spark, target)


def orphan_report(found: DataFrame) -> DataFrame:
    """Distinct orphan ends per edge kind, month of recorded_at and state."""
    month = F.date_format(F.timestamp_millis(F.col("recorded_at")), "yyyy-MM")
    return found.withColumn("month", month).select("edge_id", "side", "kind", "month", "state").distinct().groupBy("kind", "month", "state").agg(F.count("*").alias("ends"))
