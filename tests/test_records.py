"""Orphans, changes and hierarchies on small fixtures, with dirt."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import changed, hierarchy, orphans
from codeloom.sources import sinks
from conftest import EDGE

DEL = "id string, file_path string, deleted_at bigint"
FILES = "path string, content_hash string, indexed_at bigint"
SCAN = "path string, op string, content_hash string, ts timestamp"
RUNS = "run_id bigint, repo string, started_at bigint, ended_at bigint, status string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans_states_and_dirt(spark, make_nodes):
    nodes = make_nodes({"id": "a", "updated_at": 5}, {"id": "a", "updated_at": 50}, {"id": "late", "updated_at": 99}).withColumn("key", F.lit("clash")).withColumn("state", F.lit(0))
    edges = spark.createDataFrame(
        [
            (1, " A\t", "gone", "CALLS", None, None, 10),
            (1, "a", "gone", "calls", None, None, 10),
            (2, "a", "late", "calls", 1, 1, 10),
            (3, "a", "late", "calls", 1, 1, 99),
            (4, "nowhere", None, "calls", None, None, 10),
            (5, "  ", "a", None, None, None, None),
            (6, "late", "a", "calls", None, None, None),
        ],
        EDGE,
    )
    dels = spark.createDataFrame([("GONE", None, 3), ("gone", "x", 3), (None, None, None)], DEL)
    found = orphans.find_orphans(nodes, edges, dels)
    assert rows(found.select("edge_id", "side", "state").distinct()) == [(1, "target", "deleted"), (2, "target", "late"), (4, "source", "missing")]
    assert rows(orphans.orphan_report(found).select("kind", "month", "state", "ends")) == [("calls", "1970-01", "deleted", 1), ("calls", "1970-01", "late", 1), ("calls", "1970-01", "missing", 1)]
    assert orphans.find_orphans(nodes, edges.limit(0), dels).count() == 0
    assert orphans.find_orphans(nodes.limit(0), edges, dels.limit(0)).where("state <> 'missing'").count() == 0


def test_orphan_state_is_additive(spark, make_nodes, make_edges):
    n, e = make_nodes({"id": "a"}, {"id": "b"}), make_edges(("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"))
    whole = orphans.fold(orphans.reference_deltas(e), orphans.existence_deltas(n))
    first = orphans.fold(orphans.reference_deltas(e.where("id < 2")))
    second = orphans.fold(first, orphans.reference_deltas(e.where("id >= 2")), orphans.existence_deltas(n))
    assert rows(whole) == rows(second)
    undone = orphans.fold(whole, orphans.reference_deltas(e.where("target = 'c' or source = 'c'"), -1))
    assert orphans.suspects(undone).where(F.col("refs") > 0).count() == 0


def test_changed_paths(spark):
    runs = spark.createDataFrame([(1, "r", 10, 20, "ok"), (2, "r", 30, None, "crashed"), (3, "r", 50, 60, "ok"), (4, None, 1, 2, "ok")], RUNS)
    files = spark.createDataFrame([("r/a", "h1", 12), ("r/a", "h2", 35), ("r/b", "h1", 55), ("r/b", "h1", 55), ("r/c", "old", 12), ("r/c", "new", 55), ("r/d", "x", 5), ("r/n", None, 12), (None, "z", 12)], FILES)
    at = "2025-01-01 00:00:0"
    seen = [("r/a", "seen", "h2", f"{at}1"), (".\\r//a", "seen", "h2", f"{at}1"), ("./r/b", "seen", "h1", f"{at}1"), ("r/c", "seen", "old", f"{at}1"), ("r/d", "seen", "x", f"{at}1"), ("r/e", "delete", None, f"{at}2"), ("r/e", "seen", "q", f"{at}1"), ("r/n", "seen", None, f"{at}1"), (None, "seen", "h", f"{at}1")]
    scan = spark.createDataFrame(seen, "path string, op string, content_hash string, t string").select("path", "op", "content_hash", F.to_timestamp("t").alias("ts"), F.lit(1).alias("bucket"))
    assert rows(changed.changed_paths(scan, files, runs)) == [("r/a",), ("r/c",), ("r/d",), ("r/n",)]
    assert rows(changed.changed_paths(scan, files.limit(0), runs)) == [("r/a",), ("r/b",), ("r/c",), ("r/d",), ("r/n",)]
    assert changed.changed_paths(scan.limit(0), files, runs).count() == 0
    assert changed.changed_paths(scan, files, runs.limit(0)).count() == 5


def test_refresh_repeats_after_failure_and_skips_nothing(spark, tmp_path):
    target, calls = str(tmp_path / "t"), []
    v1 = spark.createDataFrame([(k, f"v{k}") for k in range(40)], "k int, v string")

    def compute(df):
        calls.append(df.count())
        return df.withColumn("out", F.upper("v"))

    def failing(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        changed.refresh(spark, v1, ["k"], ["v"], target, failing, 8)
    assert sinks.current(spark, f"{target}/manifest") is None
    assert changed.refresh(spark, v1, ["k"], ["v"], target, compute, 8) == 8
    assert changed.refresh(spark, v1, ["k"], ["v"], target, compute, 8) == 0
    v2 = v1.withColumn("v", F.when(F.col("k") == 7, "new").otherwise(F.col("v")))
    assert changed.refresh(spark, v2, ["k"], ["v"], target, compute, 8) == 1
    assert calls[-1] < 40
    out = spark.read.parquet(f"{target}/data")
    assert out.count() == 40 and out.where("k = 7").first()["out"] == "NEW"
    changed.refresh(spark, v2.where("k < 3"), ["k"], ["v"], target, compute, 8)
    assert sorted(r.k for r in spark.read.parquet(f"{target}/data").collect()) == [0, 1, 2]


def test_hierarchy(spark, make_nodes, make_edges):
    nodes = make_nodes(*({"id": x} for x in "abcdexyzs"), {"id": "b", "qualified_name": "bee", "updated_at": 9})
    edges = make_edges(("A ", "b", "Contains"), ("a", "b", "contains"), ("b", "c", "CONTAINS"), ("c", "d", "contains"), ("x", "y", "contains"), ("y", "x", "contains"), ("y", "z", "contains"), ("s", "s", "contains"), ("nobody", "e", "contains"), ("a", "e", "calls"))
    got = hierarchy.resolve(nodes, edges, names=True).select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"))
    want = [("a", "a", 0, "a"), ("b", "a", 1, "a/bee"), ("c", "a", 2, "a/bee/c"), ("d", "a", 3, "a/bee/c/d"), ("e", "e", 0, "e"), ("s", "cycle", -1, None), ("x", "cycle", -1, None), ("y", "cycle", -1, None), ("z", "cycle", -1, None)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert rows(hierarchy.descendants(nodes, edges)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)]
    assert hierarchy.resolve(nodes.limit(0), edges).count() == 0
    assert hierarchy.resolve(nodes, edges.limit(0)).where("depth = 0").count() == 9


def test_descendants_on_and_below_cycles(spark, make_nodes, make_edges):
    rng = random.Random(5)
    up = {f"c{k}": f"c{(k + 1) % 5}" for k in range(5)} | {"s": "s", "t": "s", "x": "y", "y": "x"} | {f"m{k}": f"m{k - 1}" if k else "c2" for k in range(12)} | {f"k{k}": rng.choice(["x", "c4", "m3", "r", *(f"k{j}" for j in range(k))]) for k in range(25)}
    want = []
    for v in up:
        line = [v]
        while line[-1] in up and up[line[-1]] not in line:
            line.append(up[line[-1]])
        want += [(a, v, k) for k, a in enumerate(line) if k]
    nodes, edges = make_nodes(*({"id": x} for x in ["r", *up])), make_edges(*((p, c, "contains") for c, p in up.items()))
    assert rows(hierarchy.descendants(nodes, edges, endless=True)) == sorted(want)
    assert rows(hierarchy.descendants(nodes, edges)) == sorted(x for x in want if ("r", x[1]) in {w[:2] for w in want})


def test_long_chain_and_random_forest(spark, make_nodes, make_edges):
    rng = random.Random(3)
    up = {f"n{k}": f"n{k - 1}" for k in range(1, 70)} | {f"m{k}": f"m{rng.randrange(k)}" for k in range(1, 60)}
    nodes = make_nodes(*({"id": x} for x in ["n0", "m0", *up]))
    edges = make_edges(*((p, c, "contains") for c, p in up.items()))
    want = []
    for x in ["n0", "m0", *up]:
        at, depth = x, 0
        while at in up:
            at, depth = up[at], depth + 1
        want.append((x, at, depth))
    assert rows(hierarchy.resolve(nodes, edges).select("node_id", "root_id", "depth")) == sorted(want)


def test_refresh_empties_buckets_without_output(spark, tmp_path):
    target = str(tmp_path / "t")
    v1 = spark.createDataFrame([(k, "keep") for k in range(20)], "k int, v string")
    compute = lambda df: df.where("v = 'keep'")
    assert changed.refresh(spark, v1, ["k"], ["v"], target, compute, 4) == 4
    assert changed.read_buckets(spark, target).count() == 20
    assert changed.refresh(spark, v1.withColumn("v", F.lit("drop")), ["k"], ["v"], target, compute, 4) == 4
    assert changed.read_buckets(spark, target) is None
    assert changed.refresh(spark, v1.limit(0), ["k"], ["v"], target, compute, 4) == 4


def test_changed_paths_reads_changed_partitions_only(spark, tmp_path):
    runs = spark.createDataFrame([(1, "r", 10, 20, "ok")], RUNS)
    files = spark.createDataFrame([(f"r/{k}", f"h{k}", 12) for k in range(200)], FILES)
    scan = spark.createDataFrame([(f"r/{k}", "seen", "new" if k == 7 else f"h{k}") for k in range(200)], "path string, op string, content_hash string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    target = str(tmp_path / "t")
    assert rows(changed.changed_paths(scan, files, runs, target, 16)) == [("r/7",)]
    hot = changed.read_buckets(spark, f"{target}/todo").select("bucket").distinct()
    assert hot.count() == 1
    old = changed.read_buckets(spark, f"{target}/stored", hot)
    scanned = old.select(F.input_file_name()).distinct().count()
    assert scanned == 1 < len(spark.read.parquet(f"{target}/stored/data").inputFiles())
    # the next run has stored it: nothing is left to take, nor in the target
    later = files.unionByName(spark.createDataFrame([("r/7", "new", 13)], FILES))
    assert rows(changed.changed_paths(scan, later, runs, target, 16)) == []


def test_published_tables_are_always_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path) is None
    for k in range(4):
        sinks.publish(spark, spark.range(k), path)
        assert sinks.current(spark, path).count() == k
    assert len(sinks.folders(spark, path)) == 2
    sinks.remove(spark, f"{path}/version-000000000003/_SUCCESS")  # an unfinished version does not count
    assert sinks.current(spark, path).count() == 2


def test_orphan_state_is_kept(spark, tmp_path, make_nodes, make_edges):
    path, n = str(tmp_path / "state"), make_nodes({"id": "a"}, {"id": "b"})
    e = make_edges(*(("a", "gone" if k % 3 else "b", "calls") for k in range(300)))
    orphans.next_state(spark, path, orphans.reference_deltas(e.where("id < 100")), orphans.existence_deltas(n))
    state = orphans.next_state(spark, path, orphans.reference_deltas(e.where("id >= 100")))
    got = orphans.find_orphans(n, e, spark.createDataFrame([], DEL), state)
    assert got.count() == 200 and rows(got.select("state").distinct()) == [("missing",)]
    undone = orphans.next_state(spark, path, orphans.reference_deltas(e.where("target = 'gone'"), -1))
    assert orphans.suspects(undone).count() == 0


def test_rejected_parents(spark, make_nodes, make_edges):
    n, e = make_nodes({"id": "a"}, {"id": "b"}, {"id": "c"}), make_edges(("a", "c", "contains"), ("b", "c", "contains"), ("a", "b", "contains"))
    assert rows(hierarchy.rejected_parents(n, e)) == [("c", "a", 1)]
