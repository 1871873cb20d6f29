"""Streams give the rows of their batch twins."""

from pyspark.sql import functions as F

from codeloom.streaming import changes


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "change", 0.0), ("a", "delete", 0.1), ("a", "change", 0.2), ("b", "create", 0.1), ("b", "change", 5.0), ("zz", "change", 1000.0)]
    e = spark.createDataFrame(rows, "path string, op string, s double").select("path", "op", F.timestamp_seconds("s").alias("ts"))
    e.coalesce(1).write.parquet(src)
    for name, f in (("c", lambda d: changes.coalesced(d, "300 milliseconds")), ("d", lambda d: changes.debounced(d))):
        q = f(spark.readStream.schema(e.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        batch = f(e).where("path <> 'zz'")
        stream = spark.table(name).where("path <> 'zz'")
        assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    ops = {r.path: r.op for r in changes.coalesced(e.where("s is null or true") if "s" in e.columns else e, "1 second").where("path = 'a'").collect()}
    assert ops == {"a": "delete"}


def test_run_incremental_takes_each_batch_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    e = lambda *r: spark.createDataFrame(list(r), "path string, op string, s double").select("path", "op", F.timestamp_seconds("s").alias("ts"))
    e(("a", "change", 1.0), ("a", "delete", 2.0)).coalesce(1).write.mode("append").parquet(src)
    schema = e(("a", "change", 1.0)).schema
    for _ in range(2):
        changes.run_incremental(spark.readStream.schema(schema).parquet(src), lambda d, k: seen.extend((r.path, r.op) for r in d.collect()), str(tmp_path / "cp")).awaitTermination(60)
    e(("b", "create", 3.0)).coalesce(1).write.mode("append").parquet(src)
    changes.run_incremental(spark.readStream.schema(schema).parquet(src), lambda d, k: seen.extend((r.path, r.op) for r in d.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [("a", "delete"), ("b", "create")]


def test_reconcile(spark):
    h = lambda *r: spark.createDataFrame(list(r), "path string, content_hash string")
    got = changes.reconcile(h(("a", "1"), ("b", "1"), ("c", "1"), ("n", None)), h(("a", "1"), ("b", "2"), ("d", "1"), ("n", None)))
    assert sorted(map(tuple, got.collect())) == [("b", "modified"), ("c", "removed"), ("d", "added")]
