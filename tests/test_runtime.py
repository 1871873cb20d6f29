"""Key filter and skewed joins against plain joins."""

import random

from codeloom import runtime
from pyspark.sql import functions as F


def test_filter_loses_no_key(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, rng.randrange(3000) or None) for k in range(5000)], "n int, k bigint").withColumn("bits", F.lit("clash"))
    wanted = spark.createDataFrame([(rng.randrange(4000),) for _ in range(500)] + [(None,)], "w bigint")
    exact = {r.n for r in rows.join(wanted, rows.k == wanted.w, "left_semi").collect()}
    some = runtime.likely_in(rows, F.col("k"), wanted, F.col("w"))
    got = {r.n for r in some.collect()}
    assert exact <= got and len(got) < len(exact) + 50 and some.columns == rows.columns
    tight = {r.n for r in runtime.marked(rows, F.col("k"), wanted, F.col("w"), bits=64).where("_maybe").collect()}
    assert exact <= tight  # a full filter lets more through and loses nothing
    assert runtime.likely_in(rows, F.col("k"), wanted.limit(0), F.col("w")).count() == 0
    left = runtime.without_keys(rows, "k", wanted.withColumnRenamed("w", "k"))
    assert {r.n for r in left.collect()} == set(range(5000)) - exact and left.columns == rows.columns


def test_skewed_join_equals_a_join(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 40}") for k in range(3000)], "n int, key string")
    side = rows.groupBy("key").agg(F.count("*").alias("w")).where("key <> 'k3'").withColumn("v", F.upper("key"))
    want = sorted((r.n, r.v) for r in rows.join(side, "key").collect())
    for pieces in (1, 5, 1000):
        assert sorted((r.n, r.v) for r in runtime.skewed_join(rows, side, "key", "w", ["n"], pieces).collect()) == want
    assert runtime.skewed_join(rows, side.limit(0), "key", "w", ["n"]).count() == 0
    spread = runtime.skewed_join(rows, side, "key", "w", ["n"], 10)
    assert "hashpartitioning(key" in spread._jdf.queryExecution().toString() and "_salt" in spread._jdf.queryExecution().toString()
