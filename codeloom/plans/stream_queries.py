"""Catalogue: changes and event windows (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators.changed import clean_path, newest_scan
from codeloom.plans.base import FILES, files
from codeloom.runtime import table
from codeloom.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SCAN = "scan as (select regexp_replace(regexp_replace(trim(path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') path, op, content_hash, ts from tree_scan), seen as (select path, h content_hash from (select path, arg_max(op, ts) op, arg_max(content_hash, ts) h from scan group by 1) where op <> 'delete')"


@query(f"""with {FILES}, {_SCAN} select path, case when f.path is null then 'added' when seen.path is null then 'removed' else 'modified' end as change from f full join seen using (path)
  where f.content_hash is distinct from seen.content_hash""".replace("f.path is null", "f.content_hash is null").replace("seen.path is null", "seen.content_hash is null"))
def sync_reconcile(spark, d):
    return changes.reconcile(files(spark, d), newest_scan(table(spark, d, "tree_scan")))


@query(f"with {FILES}, {_SCAN} select path from f join seen using (path) where f.content_hash <> seen.content_hash")
def stale_files(spark, d):
    return changes.stale(files(spark, d), newest_scan(table(spark, d, "tree_scan")))


@query("""with scan as (select regexp_replace(regexp_replace(trim(path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') path, op, ts from tree_scan)
  select epoch(time_bucket(interval '1 hour', ts, timestamp '1970-01-01'))::bigint as hour, path, case when count(*) filter (op = 'delete') > 0 then 'delete' else 'seen' end as op, count(*) events from scan group by 1, 2""")
def event_coalesce(spark, d):
    e = table(spark, d, "tree_scan").select(clean_path("path").alias("path"), "op", F.col("ts").cast("timestamp").alias("ts"))
    return changes.coalesced(e, "1 hour", None).select(F.unix_timestamp("window_start").alias("hour"), "path", "op", "events")


@query("""with g as (select user_id, ts, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) < 1800 then 0 else 1 end as fresh from events),
  s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) sid from g)
  select user_id, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us, count(*) events from s group by user_id, sid""")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = changes.debounced(e, "30 minutes", None, "user_id")
    return s.select("user_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "events")


@query("""select epoch(date_trunc('hour', ts))::bigint as hour, event_type, count(*) events, round(sum(value), 4) total from events group by 1, 2""")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = changes.windowed_counts(e, "1 hour", None, None)
    return c.select(F.unix_timestamp("window_start").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


@query("""select k.w start, event_type, count(*) events from events, (select unnest([0, 1800]) o) o, lateral (select (floor((epoch(ts) - o.o) / 3600) * 3600 + o.o)::bigint w) k group by 1, 2""")
def sliding_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = changes.windowed_counts(e, "1 hour", "30 minutes", None)
    return c.select(F.unix_timestamp("window_start").alias("start"), "event_type", "events")
