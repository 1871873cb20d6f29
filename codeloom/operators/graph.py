"""Operators on the property graph: levels, hierarchies, impact, paths, cycles.

Every walk is level-synchronous: one join of the frontier with the edges per
level, whatever the number of nodes in it. The visited set is a table in the
shared folder; no frontier goes to the driver.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions.constants import CALLER_KINDS, CONTAINER_KINDS
from codeloom.runtime import id_key, materialise


def newest_nodes(nodes: DataFrame) -> DataFrame:
    """The newest version of every node; qualified_name falls back to name."""
    cols = [c for c in nodes.columns if c != "id"]
    order = ["updated_at", *(c for c in cols if c != "updated_at")]
    m = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct(*order)).alias("m")).select("id", *(F.col(f"m.{c}").alias(c) for c in cols))
    return m.withColumn("qualified_name", F.coalesce("qualified_name", "name"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (source, target, kind, line, col) with ids and kinds in one spelling; null line and col become -1."""
    return (
        edges.select(id_key("source").alias("source"), id_key("target").alias("target"), F.lower(F.btrim("kind")).alias("kind"), F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("col", F.lit(-1)).alias("col"))
        .where("source <> '' and target <> ''")
        .distinct()
    )


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def links(edges: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """Distinct (here, there) pairs to walk along."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    out, back = e.select(F.col("source").alias("here"), F.col("target").alias("there")), e.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def levels(starts: DataFrame, steps: DataFrame, max_depth: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth): every node within reach of the start ids, at its least depth.

    allowed: ids that may be entered. Ends when a level adds nothing, so
    cycles are harmless. Starts count as depth 0.
    """
    steps = materialise(steps if allowed is None else steps.join(allowed.select(F.col("id").alias("there")), "there", "left_semi"))
    frontier = materialise(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = parts[0].select("id")
        for p in parts[1:]:
            seen = seen.unionByName(p.select("id"))
        found = frontier.join(steps, frontier.id == steps.here).select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialise(found)
        if frontier.isEmpty():
            break
        parts.append(frontier)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def subgraph(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Induced edges: both ends among the reached ids."""
    ids = reached.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def edge_rank(kind: Column) -> Column:
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def limited(reached: DataFrame, nodes: DataFrame, limit: int = 1000) -> DataFrame:
    """The first nodes of a walk by depth and id: a limit that does not depend on row order."""
    return reached.join(nodes.select("id", "kind", "name"), "id").orderBy("depth", "id").limit(limit)


def tree_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """One edge into each reached node from the level before: contains, then calls, then others; least source id."""
    up = reached.select(F.col("id").alias("source"), F.col("depth").alias("up"))
    down = reached.select(F.col("id").alias("target"), "depth")
    e = edges.join(down, "target").join(up, "source").where("depth = up + 1")
    return e.groupBy("target").agg(F.min(F.struct(edge_rank(F.col("kind")).alias("rank"), "source", "kind")).alias("m")).select("target", "m.source", "m.kind")


def callers(starts: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    return levels(starts, links(edges, "in", CALLER_KINDS), depth)


def callees(starts: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    return levels(starts, links(edges, "out", CALLER_KINDS), depth)


def call_graph(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    both = callers(starts, edges, depth).withColumn("side", F.lit("caller")).unionByName(callees(starts, edges, depth).withColumn("side", F.lit("callee")))
    return both.where("depth > 0")


def type_hierarchy(starts: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = ["extends", "implements"]
    up = levels(starts, links(edges, "out", kinds)).withColumn("side", F.lit("ancestor"))
    down = levels(starts, links(edges, "in", kinds)).withColumn("side", F.lit("descendant"))
    return up.unionByName(down).where("depth > 0")


def usages(starts: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(starts.select(F.col("id").alias("target")), "target", "left_semi")


def membership(inside: DataFrame) -> DataFrame:
    """(here, there): all members of each container through any depth, by doubling: rounds grow with the logarithm of the depth."""
    pairs, n = materialise(inside.select("here", "there").distinct()), -1
    while (m := pairs.count()) != n:
        n = m
        far = pairs.select(F.col("here").alias("there"), F.col("there").alias("far"))
        pairs = materialise(pairs.unionByName(pairs.join(far, "there").select("here", F.col("far").alias("there"))).distinct())
    return pairs


def impact_radius(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, depth): what a change reaches. Members of containers cost nothing, other incoming edges one step.

    0-1 search: the members of every container are known beforehand, so each
    level is one step and one join.
    """
    boxes = nodes.where(F.col("kind").isin(CONTAINER_KINDS)).select(F.col("id").alias("here"))
    inside = membership(links(edges, "out", ["contains"]).join(boxes, "here", "left_semi"))
    into = materialise(edges.where("kind <> 'contains'").select(F.col("target").alias("here"), F.col("source").alias("there")).distinct())
    seen = None
    frontier = starts.select("id")
    for depth in range(max_depth + 1):
        new = frontier.unionByName(frontier.join(inside, frontier.id == inside.here).select(F.col("there").alias("id"))).distinct()
        if seen is not None:
            new = new.join(seen.select("id"), "id", "left_anti")
        new = materialise(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.join(into, new.id == into.here).select(F.col("there").alias("id")).distinct()
    return seen


def impact_report(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes and files at each depth."""
    return reached.join(nodes.select("id", "file_path"), "id").groupBy("depth").agg(F.count("*").alias("nodes"), F.countDistinct("file_path").alias("files"))


def shortest_path(start: str, end: str, edges: DataFrame, kinds: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(step, id) of a shortest path along outgoing edges, the least ids among equals; no rows if there is none (of max_depth steps, if given)."""
    spark = edges.sparkSession
    first = spark.createDataFrame([(start,)], "id string")
    if start == end:
        return first.select(F.lit(0).alias("step"), "id")
    steps = materialise(links(edges, "out", kinds))
    frontier, tables, depth = first.withColumn("prev", F.lit(None).cast("string")), [], 0
    seen = first
    while max_depth is None or depth <= max_depth:
        frontier = materialise(frontier)
        tables.append(frontier)
        if frontier.isEmpty():
            return spark.createDataFrame([], "step int, id string")
        if not frontier.where(F.col("id") == end).isEmpty():
            break
        nxt = frontier.select(F.col("id").alias("here")).join(steps, "here").groupBy(F.col("there").alias("id")).agg(F.min("here").alias("prev"))
        seen = tables[0].select("id")
        for t in tables[1:]:
            seen = seen.unionByName(t.select("id"))
        frontier = nxt.join(seen, "id", "left_anti")
        depth += 1
    else:
        return spark.createDataFrame([], "step int, id string")
    path, at = [], end
    for k in range(len(tables) - 1, -1, -1):  # one row per level
        path.append((k, at))
        at = tables[k].where(F.col("id") == at).select("prev").first()[0]
    return spark.createDataFrame(path[::-1], "step int, id string")


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (file, depends_on) across files, contains apart."""
    a = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"))
    b = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    return edges.where("kind <> 'contains'").join(a, "source").join(b, "target").where("file <> depends_on").select("file", "depends_on").distinct()


def cyclic_groups(pairs: DataFrame, a: str = "file", b: str = "depends_on") -> DataFrame:
    """(id, group): strongly connected groups of more than one member; group is the least id of it.

    Trim, colour and cut: nodes without a way in or out are dropped first.
    Then the least id spreads forward and backward; nodes with the same colour
    both ways are one group and are taken out. Links between nodes that differ
    in either colour lie in no group and are cut, and the rest is repeated
    until no link is left. The least id of the rest always settles, so every
    round takes out at least one node.
    """
    spark = pairs.sparkSession
    left = materialise(pairs.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t").distinct())
    out = spark.createDataFrame([], "id string, grp string")
    while True:
        while True:  # trim
            n = left.count()
            left = materialise(left.join(left.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(left.select(F.col("s").alias("t")).distinct(), "t", "left_semi"))
            if left.count() == n:
                break
        if left.isEmpty():
            break
        colour = []
        for x, y in (("s", "t"), ("t", "s")):
            c = materialise(left.select(F.col("s").alias("id")).union(left.select("t")).distinct().withColumn("c", F.col("id")))
            while True:
                way = left.select(F.col(x).alias("id"), F.col(y).alias("to")).join(c, "id").select(F.col("to").alias("id"), "c")
                new = materialise(c.unionByName(way).groupBy("id").agg(F.min("c").alias("c")))
                settled = new.join(c.withColumnRenamed("c", "c0"), "id").where("c <> c0").isEmpty()
                c = new
                if settled:
                    break
            colour.append(c)
        both = materialise(colour[0].join(colour[1].withColumnRenamed("c", "c2"), "id"))
        out = out.unionByName(both.where("c = c2").select("id", F.col("c").alias("grp")))
        rest = both.where("c <> c2")
        here, there = rest.select(F.col("id").alias("s"), "c", "c2"), rest.select(F.col("id").alias("t"), "c", "c2")
        left = materialise(left.join(here, "s").join(there, ["t", "c", "c2"]).select("s", "t"))
    sizes = out.groupBy("grp").count().where("count > 1").select("grp")
    return out.join(sizes, "grp", "left_semi").select("id", F.col("grp").alias("group"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions, methods and classes that are not exported and that no edge but contains leads to."""
    used = edges.where("kind <> 'contains'").select(F.col("target").alias("id")).distinct()
    return nodes.where("kind in ('function', 'method', 'class') and not coalesce(is_exported, false)").join(used, "id", "left_anti")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of every node; ends are counted before they meet the nodes."""
    outs = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"), F.count_if(F.col("kind") == "calls").alias("calls_out"), F.count_if(F.col("kind") == "contains").alias("children"))
    ins = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"), F.count_if(F.col("kind") == "calls").alias("callers"))
    return nodes.select("id").join(outs, "id", "left").join(ins, "id", "left").na.fill(0)


def node_context(start: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(role, id, edge_kind) around one node: focal, child, parent, incoming, outgoing, type."""
    e = edges.where((F.col("source") == start) | (F.col("target") == start))
    out = F.col("source") == start
    role = (
        F.when(out & (F.col("kind") == "contains"), "child")
        .when(F.col("kind") == "contains", "parent")
        .when(out & F.col("kind").isin("type_of", "returns"), "type")
        .when(out, "outgoing")
        .otherwise("incoming")
    )
    around = e.select(role.alias("role"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("id"), F.col("kind").alias("edge_kind")).distinct()
    focal = nodes.where(F.col("id") == start).select(F.lit("focal").alias("role"), "id", F.lit("").alias("edge_kind"))
    return focal.unionByName(around)


def per_file_cap(ranked: DataFrame, limit: int) -> DataFrame:
    """At most max(5, a fifth of the limit) rows of each file by rank and id."""
    w = Window.partitionBy("file_path").orderBy(F.desc("score"), "id")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(5, -(-limit // 5))).drop("_r")


def call_paths(starts: DataFrame, edges: DataFrame, max_hops: int = 6) -> DataFrame:
    """Simple paths over calls between start nodes: arrays of ids, at most max_hops steps.

    Only nodes that lie between two starts are walked, so paths do not fan out
    into the whole graph.
    """
    step = links(edges, "out", ["calls"])
    near = levels(starts, step, max_hops).select("id").join(levels(starts, links(edges, "in", ["calls"]), max_hops).select("id"), "id", "left_semi")
    inner = materialise(step.join(near.withColumnRenamed("id", "here"), "here", "left_semi").join(near.withColumnRenamed("id", "there"), "there", "left_semi"))
    walk = starts.select(F.array("id").alias("path"), F.col("id").alias("here"))
    found = None
    for _ in range(max_hops):
        walk = materialise(walk.join(inner, "here").where(~F.array_contains("path", F.col("there"))).select(F.array_append("path", F.col("there")).alias("path"), F.col("there").alias("here")))
        if walk.isEmpty():
            break
        hit = walk.join(starts.select(F.col("id").alias("here")).distinct(), "here", "left_semi").select("path")
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else walk.select("path")


def innermost(lines: list[int], firsts: list[int], lasts: list[int], ids: list[str]) -> list[str | None]:
    """For each line the span around it that starts last, the least id of equal starts; lines and spans are swept once in order."""
    order, heap, out, k = sorted(range(len(ids)), key=firsts.__getitem__), [], {}, 0
    for line in sorted(set(lines)):
        while k < len(order) and firsts[order[k]] <= line:
            i = order[k]
            heappush(heap, (-firsts[i], ids[i], lasts[i]))
            k += 1
        while heap and heap[0][2] < line:
            heappop(heap)
        out[line] = heap[0][1] if heap else None
    return [out[x] for x in lines]


def enclosing(points: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("method", "function", "component")) -> DataFrame:
    """points (file_path, line, ...) with `enclosing`: the innermost node around the line, the one that starts last.

    No range join: the distinct lines and the spans of a file meet in one row
    and are swept together once. A null line or a file without spans gives
    null; of equal starts the least id wins.
    """
    spans = nodes.where(F.col("kind").isin(*kinds) & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()).select("file_path", F.least("start_line", "end_line").alias("first"), F.greatest("start_line", "end_line").alias("last"), "id")
    per_file = spans.groupBy("file_path").agg(F.collect_list(F.struct("first", "last", "id")).alias("s"))
    asked = points.where("file_path is not null and line is not null").select("file_path", F.col("line").cast("int").alias("line")).distinct().groupBy("file_path").agg(F.collect_list("line").alias("lines"))

    def sweep(batches):
        for b in batches:
            rows = [(p, x, e) for p, lines, f, t, i in zip(b["file_path"], b["lines"], b["first"], b["last"], b["id"]) for x, e in zip(lines, innermost(list(lines), list(f), list(t), list(i))) if e is not None]
            yield pd.DataFrame(rows, columns=["file_path", "line", "enclosing"])

    found = asked.join(per_file, "file_path").select("file_path", "lines", "s.first", "s.last", "s.id").mapInPandas(sweep, "file_path string, line int, enclosing string")
    return points.join(found, ["file_path", "line"], "left").select(*points.columns, "enclosing")
