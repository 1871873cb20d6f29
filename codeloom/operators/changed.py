"""Processing only new or changed records.

Rows are cut into partitions by a hash of their key. A partition's fingerprint
is its row count with additive and xor row hashes, so it can be kept up by
deltas and compared without comparing rows. Only partitions whose fingerprints
differ are looked into or recomputed, and each is replaced atomically by
dynamic partition overwrite; the manifest of fingerprints is written last, so
a run that fails half-way is repeated and nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.runtime import discard, materialise, shared_path


def clean_path(c: Column | str) -> Column:
    """Single forward slashes, no leading `./`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.btrim(c), r"[\\/]+", "/"), r"^(\./)+", "")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


#: Size of a partition when a table is refreshed for the first time, and the most partitions.
ROWS_A_BUCKET, MOST_BUCKETS = 2000, 4096


def fingerprints(rows: DataFrame, keys: list[str], values: list[str], buckets: int, forced: Column | None = None) -> DataFrame:
    """(bucket, buckets, n, added, mixed, forced): count, additive hash and xor of a second hash of the rows of each bucket, and whether one of them forces it."""
    h1, h2 = F.xxhash64(*keys, *values), F.xxhash64(F.lit("second"), *values, *keys)
    return (
        rows.select(bucket_of(keys, buckets).alias("bucket"), h1.alias("h1"), h2.alias("h2"), (F.lit(False) if forced is None else forced).alias("f"))
        .groupBy("bucket")
        .agg(F.lit(buckets).alias("buckets"), F.count("*").alias("n"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("added"), F.bit_xor("h2").alias("mixed"), F.max("f").alias("forced"))
    )


def changed_buckets(now: DataFrame, before: DataFrame) -> DataFrame:
    """Buckets whose fingerprints differ or exist on one side only."""
    b = before.select("bucket", F.col("n").alias("n0"), F.col("added").alias("added0"), F.col("mixed").alias("mixed0"))
    same = F.col("n").eqNullSafe(F.col("n0")) & F.col("added").eqNullSafe(F.col("added0")) & F.col("mixed").eqNullSafe(F.col("mixed0"))
    return now.join(b, "bucket", "full_outer").where(~same).select("bucket")


def newest_scan(scan: DataFrame) -> DataFrame:
    """(path, content_hash) of the newest row of each path unless it is a delete.

    Spellings of one file are one path. Rows without path or time are left
    out; of rows with one time, `seen` wins over `delete`, then the greatest
    hash.
    """
    last = F.max(F.struct("ts", "op", "content_hash")).alias("m")
    return (
        scan.where("path is not null and ts is not null")
        .select(clean_path("path").alias("path"), "ts", F.lower("op").alias("op"), "content_hash")
        .groupBy("path")
        .agg(last)
        .where("m.op <> 'delete'")
        .select("path", "m.content_hash")
    )


def with_run_status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """files rows with `run_status`: that of the run of their repository that started last at or before indexed_at.

    As-of join: the runs of a repository become one sorted array, so files
    meet one row per repository and no range of runs. A row before the first
    run, or without indexed_at, gets null. Runs with one start: the greatest
    run_id.
    """
    per_repo = (
        runs.where("repo is not null and started_at is not null")
        .groupBy("repo")
        .agg(F.array_sort(F.collect_set(F.struct("started_at", "run_id", "status"))).alias("_runs"))
        .withColumnRenamed("repo", "_repo")
    )
    upto = F.filter("_runs", lambda r: r["started_at"] <= F.col("indexed_at"))
    return (
        files.withColumn("_repo", F.split_part(clean_path("path"), F.lit("/"), F.lit(1)))
        .join(per_repo, "_repo", "left")
        .withColumn("run_status", F.try_element_at(upto, F.lit(-1))["status"])
        .drop("_repo", "_runs")
    )


def stored_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, content_hash) of the newest row of each path that a successful run stored; ties take the greatest hash."""
    return (
        with_run_status(files.select("path", "content_hash", "indexed_at").where("path is not null"), runs)
        .where("run_status = 'ok'")
        .select(clean_path("path").alias("path"), "indexed_at", "content_hash")
        .groupBy("path")
        .agg(F.max(F.struct("indexed_at", "content_hash")).alias("m"))
        .select("path", "m.content_hash")
    )


def changed_paths(scan: DataFrame, files: DataFrame, runs: DataFrame, target: str | None = None, buckets: int | None = None) -> DataFrame:
    """Paths the next run must take: present in the scan with other content than the last successful run stored, or never stored.

    What that run left behind is kept as a table of partitions under
    target/stored with a manifest of fingerprints; refresh() brings it up to
    the log. The scan is cut into the same partitions, and those with another
    fingerprint are compared with the stored partitions of that number, which
    alone are read, and replaced in target/todo. Without a target both live in
    the shared folder until the session ends. A null hash on either side never
    counts as unchanged. Empty tables: an empty scan gives no rows, empty
    files or runs give every present path.
    """
    from codeloom.sources.sinks import current

    spark = scan.sparkSession
    target = target or shared_path(spark, "index")
    stored = f"{target}/stored"
    refresh(spark, stored_state(files, runs), ["path"], ["content_hash"], stored, lambda rows: rows, buckets)
    manifest = current(spark, f"{stored}/manifest")
    count = manifest.agg(F.max("buckets")).first()[0] or buckets or 1

    def compare(rows: DataFrame) -> DataFrame:
        old = read_buckets(spark, stored, rows.select("bucket").distinct())
        if old is None:
            return rows.select("path", "bucket")
        old = old.select("bucket", "path", F.col("content_hash").alias("stored"), F.lit(True).alias("known"))
        same = F.coalesce(F.col("content_hash") == F.col("stored"), F.lit(False))
        return rows.join(old, ["bucket", "path"], "left").where(F.col("known").isNull() | ~same).select("path", "bucket")

    refresh(spark, newest_scan(scan), ["path"], ["content_hash"], f"{target}/todo", compare, count, manifest, F.col("content_hash").isNull())
    out = read_buckets(spark, f"{target}/todo")
    return out.select("path") if out is not None else spark.createDataFrame([], "path string")


def read_buckets(spark: SparkSession, target: str, wanted: DataFrame | None = None) -> DataFrame | None:
    """The data of a refreshed table, or of the wanted buckets only: files of others are not read. None without data."""
    from codeloom.sources.sinks import folders

    if not any(x.startswith("bucket=") for x in folders(spark, f"{target}/data")):
        return None
    data = spark.read.parquet(f"{target}/data")
    return data if wanted is None else data.where(F.col("bucket").isin([r.bucket for r in wanted.collect()]))  # at most as many as there are buckets


def refresh(
    spark: SparkSession,
    rows: DataFrame,
    keys: list[str],
    values: list[str],
    target: str,
    compute: Callable[[DataFrame], DataFrame],
    buckets: int | None = None,
    against: DataFrame | None = None,
    always: Column | None = None,
) -> int:
    """Recompute the buckets of `rows` that changed since the last successful refresh of `target`; how many there were.

    `compute` maps rows (with their `bucket`) to output rows that keep
    `bucket`. Data is under target/data, partitioned by bucket; fingerprints
    under target/manifest, published after the data. A failure in between
    leaves the old manifest, so the same buckets are replaced again: nothing
    is skipped and, as replacing is idempotent, nothing is doubled. Buckets
    that give no output any more are emptied. The manifest names the rows that
    were computed: changed buckets are written once, and their fingerprints
    are taken from that copy, whatever the source does meanwhile.

    buckets: their number at the first refresh (one per ROWS_A_BUCKET rows, at
    most MOST_BUCKETS, if not given); the manifest keeps it. against: compare
    with these fingerprints instead of the target's own; the
    target then holds the output of the changed buckets only. always: rows whose
    bucket is taken whatever its fingerprint.
    """
    from codeloom.sources.sinks import current, folders, publish, remove

    mine = current(spark, f"{target}/manifest")
    before = against if against is not None else mine
    known = before.agg(F.max("buckets")).first()[0] if before is not None else None
    buckets = known or buckets or min(MOST_BUCKETS, rows.count() // ROWS_A_BUCKET + 1)
    rows = rows.withColumn("bucket", bucket_of(keys, buckets))
    flag = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    seen = fingerprints(rows, keys, values, buckets, flag)
    hot = seen.where("forced").select("bucket")
    changed = seen.select("bucket") if before is None else changed_buckets(seen, before).unionByName(hot).distinct()
    todo = [r.bucket for r in changed.collect()]  # at most `buckets` numbers
    if not todo and against is None:
        if mine is None:
            publish(spark, seen, f"{target}/manifest")
        return 0
    picked = materialise(rows.where(F.col("bucket").isin(todo)))
    out = materialise(compute(picked))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{target}/data")
    filled = {r.bucket for r in out.select("bucket").distinct().collect()}
    stale = set(todo) - filled if against is None else {int(x.split("=")[1]) for x in folders(spark, f"{target}/data") if x.startswith("bucket=")} - filled
    for b in stale:
        remove(spark, f"{target}/data/bucket={b}")
    now = fingerprints(picked, keys, values, buckets, flag)
    if mine is not None and against is None:
        now = now.unionByName(mine.where(~F.col("bucket").isin(todo)))
    publish(spark, now, f"{target}/manifest")
    discard(picked)
    discard(out)
    return len(todo)
