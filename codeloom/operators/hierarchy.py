"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import discard, materialise, packed_key, unpacked_key


def members(nodes: DataFrame, names: bool = False) -> DataFrame:
    """(nid, key[, label]): a dense number and, if asked for, the newest qualified name of every id, written once so that numbers stay."""
    rows = nodes.select(packed_key("id").alias("key"), *(["qualified_name", "name", "updated_at"] if names else [])).where("key is not null")
    newest = F.max_by(F.coalesce("qualified_name", "name"), F.struct("updated_at", "qualified_name", "name")).alias("label") if names else None
    one = rows.groupBy("key").agg(newest) if names else rows.distinct()
    return materialise(one.withColumn("nid", F.monotonically_increasing_id()))


def parents(ids: DataFrame, edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(nid, parent, parent_key, more): one link per child between members; of several parents the smallest id wins, `more` counts the others."""
    links = (
        edges.where(F.lower(F.btrim("kind")) == kind)
        .select(packed_key("target").alias("child"), packed_key("source").alias("up"))
        .where("child is not null and up is not null")
        .distinct()
    )
    up = ids.select(F.col("key").alias("up"), F.col("nid").alias("parent"))
    down = ids.select(F.col("key").alias("child"), "nid")
    return links.join(up, "up").join(down, "child").groupBy("nid").agg(F.min_by("parent", "up").alias("parent"), F.min("up").alias("parent_key"), (F.count("*") - 1).alias("more"))


def rejected_parents(nodes: DataFrame, edges: DataFrame, kind: str = "contains") -> DataFrame:
    """(node_id, parent_id, others): children with several parents, the one that the hierarchy follows and how many it does not."""
    ids = members(nodes)
    many = parents(ids, edges, kind).where("more > 0")
    return many.join(ids, "nid").select(unpacked_key("key").alias("node_id"), unpacked_key("parent_key").alias("parent_id"), F.col("more").alias("others"))


def endless_lines(open_: DataFrame, up: DataFrame) -> DataFrame:
    """(nid, line): for nodes whose chain never ends, the numbers from the last new one of the chain down to the node.

    Each round appends the line of the node that the pointer leads to, without
    what the own line holds. A line is whole when that line repeats something
    or is whole itself, so it ends where the chain first comes back to a node.
    """
    state = materialise(open_.select("nid").join(up, "nid").select("nid", F.col("parent").alias("anc"), F.array("nid").alias("line"), F.lit(False).alias("whole")))
    while not state.where("not whole").isEmpty():
        far = state.select(F.col("nid").alias("anc"), F.col("anc").alias("anc2"), F.col("line").alias("line2"), F.col("whole").alias("whole2"))
        new = F.array_except("line2", "line")
        step = state.where("not whole").join(far, "anc").select("nid", F.col("anc2").alias("anc"), F.concat(new, "line").alias("line"), (F.col("whole2") | (F.size(new) < F.size("line2"))).alias("whole"))
        state = materialise(state.where("whole").unionByName(step))
    return state.select("nid", "line")


def resolve(nodes: DataFrame, edges: DataFrame, kind: str = "contains", names: bool = False, ancestors: bool = False, endless: bool = False) -> DataFrame:
    """One row per id: node_id, root_id, depth and, if asked for, path (labels from the root) and ancestors (numbers).

    Each round joins every open pointer with the pointer it leads to, which
    doubles its length, and joins the path pieces. Nodes that reach a root
    leave the loop. Only nodes with children take part, the others follow their
    parent at the end; ids travel with their pointers, so that no node has to
    be joined with its root. If a round closes none, no depth beyond it can exist, so
    all that are open lead into a cycle: root `cycle`, depth -1, null path.
    A self-link is a cycle. Null ids are left out; without edges every node is
    its own root. Rounds: log2 of the greatest depth, plus two. endless: with
    ancestors, nodes that lead into a cycle have them as well (endless_lines).
    """
    ids = members(nodes, names)
    up = materialise(parents(ids, edges, kind))
    extra = (["path"] if names else []) + (["line"] if ancestors else [])
    inner = up.select(F.col("parent").alias("nid")).distinct().withColumn("inner", F.lit(True))
    own = ids.join(up, "nid", "left").join(inner, "nid", "left").select(
        "nid",
        "key",
        F.coalesce("inner", F.lit(False)).alias("inner"),
        F.coalesce("parent", "nid").alias("anc"),
        F.coalesce("parent_key", "key").alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist"),
        F.col("parent").isNull().alias("done"),
        *([F.array(F.coalesce("label", F.lit(""))).alias("path")] if names else []),
        *([F.array("nid").alias("line")] if ancestors else []),
    )
    own = materialise(own)
    state = own.where("inner")
    parts, before = [state.where("done")], None
    open_ = state.where("not done")
    made = [up]
    while (left := open_.count()) and left != before:
        before = left
        every = open_
        for p in parts:
            every = every.unionByName(p)
        far = every.select(F.col("nid").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("root").alias("root2"), *(F.col(c).alias(f"{c}2") for c in extra))
        step = open_.join(far, "anc").select(
            "nid", "key", "inner", F.col("root2").alias("root"), F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), *(F.concat(f"{c}2", c).alias(c) for c in extra)
        )
        state = materialise(step)
        parts.append(state.where("done"))
        open_ = state.where("not done")
    lines = endless_lines(open_, up) if ancestors and endless else None
    for m in made:
        discard(m)
    whole = open_.select("nid", "key", F.lit(None).cast("binary").alias("root"), F.lit(-1).alias("dist"), *(F.lit(None).cast(open_.schema[c].dataType).alias(c) for c in extra))
    if lines is not None:
        whole = whole.drop("line").join(lines, "nid")
    for p in parts:
        whole = whole.unionByName(p.select(*whole.columns))
    # nodes without children stand one step below their parent
    leaves = own.where("not inner")
    above = whole.select(F.col("nid").alias("anc"), F.col("root").alias("root2"), F.col("dist").alias("dist2"), *(F.col(c).alias(f"{c}2") for c in extra))
    depth = F.when(F.col("dist2") >= 0, F.col("dist2") + 1).otherwise(-1)
    below = leaves.where("not done").join(above, "anc").select("nid", "key", F.col("root2").alias("root"), depth.alias("dist"), *(F.concat(f"{c}2", c).alias(c) for c in extra))
    whole = whole.unionByName(below).unionByName(leaves.where("done").select(*whole.columns))
    return whole.select(
        F.col("nid"),
        unpacked_key("key").alias("node_id"),
        F.coalesce(unpacked_key("root"), F.lit("cycle")).alias("root_id"),
        F.col("dist").cast("int").alias("depth"),
        *extra,
    )


def descendants(nodes: DataFrame, edges: DataFrame, kind: str = "contains", endless: bool = False) -> DataFrame:
    """(node_id, descendant_id, distance) for every node below another; nodes on or below a cycle have none.

    endless: they have them too. Every node is below all others that its chain
    of parents meets before it first comes back to a node, at the distance of
    the first meeting; so nodes of one cycle are below each other and none is
    below itself.
    """
    full = materialise(resolve(nodes, edges, kind, ancestors=True, endless=endless).select("nid", "node_id", "line"))
    far = F.size("line") - 1
    pairs = full.where(F.size("line") > 1).select(F.col("node_id").alias("descendant_id"), far.alias("far"), F.posexplode(F.slice("line", F.lit(1), far)).alias("at", "nid"))
    return pairs.join(full.select("nid", "node_id"), "nid").select("node_id", "descendant_id", (F.col("far") - F.col("at")).cast("int").alias("distance"))
