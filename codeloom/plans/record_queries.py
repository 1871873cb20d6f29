"""Queries of the general record operators: orphans, changes, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changed, hierarchy, orphans
from codeloom.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.find_orphans(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "node_deletions"))
    return found.select("edge_id", "side", "state").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.find_orphans(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "node_deletions"))
    return orphans.orphan_report(found)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changed.changed_paths(table(spark, d, "tree_scan"), table(spark, d, "files"), table(spark, d, "index_runs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "nodes"), table(spark, d, "edges")).select("node_id", "root_id", "depth")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    full = hierarchy.resolve(table(spark, d, "nodes"), table(spark, d, "edges"), names=True)
    return full.select("node_id", F.array_join("path", " > ").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "nodes"), table(spark, d, "edges"))


def p7_descendants_endless(spark: SparkSession, d: str) -> DataFrame:
    """p7_descendants with the pairs on and below cycles, which its SQL leaves out."""
    return hierarchy.descendants(table(spark, d, "nodes"), table(spark, d, "edges"), endless=True)


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p7_found, p7_paths, p7_descendants, p7_descendants_endless)}

_KEY = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_ENDS = f"""
ends as (
  select id edge_id, 'source' side, {_KEY.format(c='source')} k, lower(kind) kind, recorded_at from edges
  union select id, 'target', {_KEY.format(c='target')}, lower(kind), recorded_at from edges),
have as (select {_KEY.format(c='id')} k, min(updated_at) first_seen from nodes group by 1),
gone as (select distinct {_KEY.format(c='id')} k from node_deletions),
orphans as (
  select edge_id, side, kind, recorded_at,
    case when have.k is null then case when gone.k is null then 'missing' else 'deleted' end
         when first_seen > recorded_at then 'late' end state
  from ends left join have using (k) left join gone using (k) where k <> '')
"""
_P4 = """
with scan as (select regexp_replace(regexp_replace(trim(path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') path, op, content_hash, ts from tree_scan),
newest as (select path, arg_max(op, ts) op, arg_max(coalesce(content_hash, ''), ts) h from scan group by 1),
owned as (
  select f.path, f.content_hash, f.indexed_at, r.status from files f
  asof join index_runs r on split_part(f.path, '/', 1) = r.repo and f.indexed_at >= r.started_at),
stored as (select path, arg_max(content_hash, indexed_at) h from owned where status = 'ok' group by 1)
select n.path from newest n left join stored s using (path)
where n.op <> 'delete' and (s.path is null or s.h <> n.h or n.h = '')
"""
_TREE = f"""
with recursive n as (select {_KEY.format(c='id')} k, arg_max(coalesce(qualified_name, name), (updated_at, qualified_name, name)) label from nodes group by 1),
link as (
  select {_KEY.format(c='target')} child, min({_KEY.format(c='source')}) up from edges
  where lower(trim(kind)) = 'contains' and {_KEY.format(c='source')} in (select k from n) and {_KEY.format(c='target')} in (select k from n) group by 1),
"""
SQL = {
    "p3_found": f"with {_ENDS} select distinct edge_id, side, state from orphans where state is not null",
    "p3_report": f"""with {_ENDS} select kind, month, state, count(*) ends from (
        select distinct edge_id, side, kind, state, strftime(make_timestamp(recorded_at * 1000), '%Y-%m') as month from orphans where state is not null)
        group by all""",
    "p4_found": _P4,
    "p7_found": _TREE
    + """walk(node_id, root_id, depth) as (
        select k, k, 0 from n where k not in (select child from link)
        union all select link.child, root_id, depth + 1 from walk join link on link.up = walk.node_id)
      select node_id, root_id, depth::int as depth from walk
      union all select k, 'cycle', -1 from n where k not in (select node_id from walk)""",
    "p7_paths": _TREE
    + """walk(node_id, path) as (
        select k, coalesce(label, '') from n where k not in (select child from link)
        union all select link.child, walk.path || ' > ' || coalesce(n.label, '') from walk join link on link.up = walk.node_id join n on n.k = link.child)
      select node_id, path from walk
      union all select k, null from n where k not in (select node_id from walk)""",
    "p7_descendants": _TREE
    + """top(node_id) as (
        select k from n where k not in (select child from link)
        union all select link.child from top join link on link.up = top.node_id),
      pairs(node_id, descendant_id, distance) as (
        select up, child, 1 from link where child in (select node_id from top)
        union all select link.up, pairs.descendant_id, distance + 1 from pairs join link on link.child = pairs.node_id)
      select node_id, descendant_id, distance::int as distance from pairs""",
}
