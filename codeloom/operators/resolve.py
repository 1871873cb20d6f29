"""Reference resolution and edge synthesis as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions import scoring
from codeloom.functions.constants import BUILT_INS
from codeloom.functions.text import name_tail
from codeloom.runtime import materialise

#: A name that more nodes than this share resolves to none of them.
AMBIGUITY_CEILING = 500
#: Types, and interfaces, of one set of method names that are paired at one place, about; more are cut.
CELL = 4000
#: A set of at most so many names goes along with each of them; larger ones are compared at their owners.
FEW = 16


def without_built_ins(refs: DataFrame) -> DataFrame:
    """References to symbols of the language itself are dropped."""
    cond = F.lit(False)
    for family, names in BUILT_INS.items():
        cond = cond | (scoring.language_family(F.col("language")) == family) & F.col("reference_name").isin(names)
    return refs.where(~F.coalesce(cond, F.lit(False)))


def _candidates(nodes: DataFrame, key: Column, ceiling: int) -> DataFrame:
    """One row per key with its candidate nodes as an array; ubiquitous keys are left out before the join, so no hot name is multiplied."""
    fields = F.struct("id", "kind", "language", "file_path", "start_line", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), "visibility", "qualified_name")
    counted = nodes.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") <= ceiling)
    return nodes.withColumn("key", key).join(counted.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list(fields).alias("cands"))


def resolve_live(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, target_kind, confidence): exact name 0.9, else qualified name 0.95, else name without case 0.85.

    Among candidates: same language, callables for function_ref, exported,
    public, least id. Every reference is resolved in one pass; those without
    candidate are missing.
    """

    callable_ = F.col("kind").isin("function", "method")
    rank = F.struct((~F.coalesce("is_exported", F.lit(False))).alias("c"), (~F.coalesce(F.col("visibility") == "public", F.lit(False))).alias("d"), "id", "kind")

    def leaders(key: Column) -> DataFrame:
        """The first node of each key, language and callability: a name that millions share is one short array."""
        lead = nodes.groupBy(key.alias("key"), "language", callable_.alias("callable")).agg(F.min(rank).alias("m"))
        return lead.groupBy("key").agg(F.collect_list(F.struct("language", "callable", "m")).alias("cands"))

    def order(c):
        other = ~F.coalesce(c["language"] == F.col("language"), F.lit(False))
        unfit = F.col("reference_kind").eqNullSafe("function_ref") & ~c["callable"]
        return F.struct(other.alias("a"), unfit.alias("b"), c["m"].alias("m"))

    # references that ask the same are one; every tier is tried and the first that answers is kept
    keys = [F.coalesce("reference_name", F.lit("")).alias("asked"), F.coalesce("language", F.lit("")).alias("language"), F.col("reference_kind").eqNullSafe("function_ref").alias("fn")]
    asked = refs.select(*keys).distinct().withColumn("reference_kind", F.when(F.col("fn"), "function_ref"))
    out = None
    for k, (key, ref_key, confidence) in enumerate([(F.col("name"), F.col("asked"), 0.9), (F.col("qualified_name"), F.col("asked"), 0.95), (F.lower("name"), F.lower("asked"), 0.85)]):
        best = F.array_min(F.transform("cands", order)).alias("b")
        got = asked.withColumn("key", ref_key).join(leaders(key), "key").select("asked", "language", "fn", F.struct(F.lit(k).alias("k"), F.lit(confidence).alias("confidence"), best).alias("m"))
        out = got if out is None else out.unionByName(got)
    first = out.groupBy("asked", "language", "fn").agg(F.min("m").alias("m"))
    return refs.select("ref_id", *keys).join(first, ["asked", "language", "fn"]).select("ref_id", F.col("m.b.m.id").alias("target"), F.col("m.b.m.kind").alias("target_kind"), F.col("m.confidence").alias("confidence"))


def resolve_exact(refs: DataFrame, nodes: DataFrame, ceiling: int = AMBIGUITY_CEILING) -> DataFrame:
    """(ref_id, target, confidence): scored match of exact names.

    Gates: references need the same language family, imports must not cross
    known families. One candidate: 0.9, across languages 0.5. Several: the
    best by file, proximity, language, fitting kind, export and line, 0.7 if
    near (proximity 30 or more), else 0.4. Names above the ceiling resolve to
    nothing.
    """
    rows = refs.withColumn("key", F.col("reference_name")).join(_candidates(nodes, F.col("name"), ceiling), "key")
    same = lambda c: F.coalesce(c["language"] == F.col("language"), F.lit(False))
    kind = F.col("reference_kind")

    def gate(c):
        return F.when(kind.isin("references", "function_ref"), scoring.same_family(c["language"], F.col("language"))).when(kind == "imports", ~scoring.crosses_families(c["language"], F.col("language"))).otherwise(True)

    rows = rows.withColumn("cands", F.filter("cands", lambda c: F.coalesce(gate(c), F.lit(False)))).where(F.size("cands") > 0)
    rows = rows.withColumn("n", F.size("cands"))
    rows = rows.withColumn("cands", F.when(F.exists("cands", same), F.filter("cands", same)).otherwise(F.col("cands")))

    def score(c):
        callable_ = c["kind"].isin("function", "method")
        fit = (
            F.when((kind == "calls") & callable_, 25)
            .when((kind == "instantiates") & c["kind"].isin("class", "struct", "interface"), 25)
            .when((kind == "decorates") & callable_, 25)
            .when((kind == "decorates") & c["kind"].isin("class", "interface"), 15)
            .otherwise(0)
        )
        here = F.coalesce(c["file_path"] == F.col("file_path"), F.lit(False))
        near = F.when(here & (c["start_line"] > 0), F.greatest(F.lit(0.0), 20 - F.abs(c["start_line"] - F.col("line")) / 10)).otherwise(0.0)
        prox = scoring.path_proximity(F.col("file_path"), c["file_path"])
        total = F.when(here, 100).otherwise(0) + prox + F.when(same(c), 50).otherwise(-80) + fit + F.when(c["is_exported"], 10).otherwise(0) + F.coalesce(near, F.lit(0.0))
        return F.struct((-total).alias("s"), c["id"].alias("id"), prox.alias("prox"), same(c).alias("same"))

    m = rows.select("ref_id", "n", F.array_min(F.transform("cands", score)).alias("m"))
    confidence = F.when(F.col("n") == 1, F.when(F.col("m.same"), 0.9).otherwise(0.5)).when(F.col("m.prox") >= 30, 0.7).otherwise(0.4)
    return m.select("ref_id", F.col("m.id").alias("target"), confidence.alias("confidence"))


def resolve_qualified(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Qualified references: 0.95 for the one exact qualified name or the one in the same file, else 0.85 for the least with that suffix."""
    q = refs.where(F.col("reference_name").rlike("[.:]")).withColumn("key", name_tail("reference_name"))
    rows = q.join(_candidates(nodes, name_tail("qualified_name"), AMBIGUITY_CEILING), "key")
    ref = F.col("reference_name")
    exact = F.filter("cands", lambda c: c["qualified_name"] == ref)
    ends = F.filter("cands", lambda c: c["qualified_name"].endswith(ref))
    here = F.filter(exact, lambda c: c["file_path"] == F.col("file_path"))
    pick = F.when(F.size(exact) == 1, exact[0]["id"]).when(F.size(here) > 0, F.array_min(F.transform(here, lambda c: c["id"])))
    suffix = F.when(F.size(ends) > 0, F.array_min(F.transform(ends, lambda c: c["id"])))
    return (
        rows.select("ref_id", F.coalesce(pick, suffix).alias("target"), F.when(pick.isNotNull(), 0.95).otherwise(0.85).alias("confidence"))
        .where("target is not null")
    )


def resolve_fuzzy(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Callables of one lower-case name: 0.5 in the same language, else 0.3; only if there is exactly one."""
    one = nodes.where("kind in ('function', 'method', 'class')").groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("target"), F.min("language").alias("lang")).where("n = 1")
    return refs.withColumn("key", F.lower("reference_name")).join(one, "key").select("ref_id", "target", F.when(F.col("lang") == F.col("language"), 0.5).otherwise(0.3).alias("confidence"))


def resolve_paths(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that look like file paths: the exact path 0.95, a path suffix 0.85, the only file of that name 0.7."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = refs.where(F.col("reference_name").rlike(r"[/.]\w+$") & F.col("reference_name").contains(".")).withColumn("key", base(F.col("reference_name")))
    files = nodes.where("kind = 'file'").groupBy(base(F.col("file_path")).alias("key")).agg(F.count("*").alias("n"), F.collect_list(F.struct("file_path", "id")).alias("cands")).where(F.col("n") <= AMBIGUITY_CEILING)
    rows = paths.join(files, "key")
    ref = F.col("reference_name")
    exact = F.filter("cands", lambda c: c["file_path"] == ref)
    ends = F.filter("cands", lambda c: c["file_path"].endswith(F.concat(F.lit("/"), ref)))
    near = F.array_min(F.transform(ends, lambda c: F.struct((-scoring.path_proximity(F.col("file_path"), c["file_path"])).alias("p"), c["id"].alias("id"))))
    target = F.when(F.size(exact) > 0, exact[0]["id"]).when(F.size(ends) > 0, near["id"]).when(F.col("n") == 1, F.col("cands")[0]["id"])
    confidence = F.when(F.size(exact) > 0, 0.95).when(F.size(ends) > 0, 0.85).otherwise(0.7)
    return rows.select("ref_id", target.alias("target"), confidence.alias("confidence")).where("target is not null")


def cascade(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, rule): the first rule that resolves a reference, in the order path, qualified, exact, fuzzy."""
    rules = [("path", resolve_paths), ("qualified", resolve_qualified), ("exact", resolve_exact), ("fuzzy", resolve_fuzzy)]
    known = without_built_ins(refs)
    out = None
    for k, (name, rule) in enumerate(rules):
        got = rule(known, nodes).select("ref_id", F.struct(F.lit(k).alias("k"), "target", "confidence", F.lit(name).alias("rule")).alias("m"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("ref_id").agg(F.min("m").alias("m")).select("ref_id", "m.target", "m.confidence", "m.rule")


def created_edges(refs: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of resolved references: extends an interface or protocol becomes implements; a call of a Python or Ruby type becomes instantiates; function_ref becomes calls."""
    kinds = nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("language").alias("target_language"))
    e = resolved.select("ref_id", "target", "confidence").join(refs, "ref_id").join(kinds, "target")
    kind = (
        F.when((F.col("reference_kind") == "extends") & F.col("target_kind").isin("interface", "protocol"), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("class", "struct") & F.col("target_language").isin("python", "ruby"), "instantiates")
        .when(F.col("reference_kind") == "function_ref", "calls")
        .otherwise(F.col("reference_kind"))
    )
    return e.select(F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line", "confidence").distinct()


def type_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, kind): extends and implements edges between types; ends that are members stand for the type that contains them."""
    types = nodes.where("kind in ('class', 'struct', 'interface')").select(F.col("id").alias("source"))
    own = edges.where("kind = 'contains'").join(types, "source", "left_semi").groupBy(F.col("target").alias("member")).agg(F.min("source").alias("owner"))
    a, b = own.select(F.col("member").alias("source"), F.col("owner").alias("o1")), own.select(F.col("member").alias("target"), F.col("owner").alias("o2"))
    e = edges.where("kind in ('extends', 'implements')").select("source", "target", "kind").join(a, "source", "left").join(b, "target", "left")
    return e.select(F.coalesce("o1", "source").alias("source"), F.coalesce("o2", "target").alias("target"), "kind").distinct()


def override_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): a member of a type and the member of that name in what it extends or implements."""
    inside = edges.where("kind = 'contains'").join(nodes.where("kind = 'method'").select(F.col("id").alias("target"), "name"), "target").select(F.col("source").alias("owner"), F.col("target").alias("member"), "name").distinct()
    up = edges.where("kind in ('extends', 'implements')").select(F.col("source").alias("sub"), F.col("target").alias("base")).distinct()
    below = inside.select(F.col("owner").alias("sub"), F.col("member").alias("source"), "name")
    above = inside.select(F.col("owner").alias("base"), F.col("member").alias("target"), "name")
    return up.join(below, "sub").join(above, ["base", "name"]).select("source", "target").distinct()


def structural_implements(nodes: DataFrame, edges: DataFrame, language: str | None = None) -> DataFrame:
    """(source, target): types whose methods include all methods of an interface.

    Owners with the same method names are one set, told by its least owner.
    The sets of interfaces meet those of types by the name that the fewest
    types have; those that fit are compared whole, and owners take the place
    of their sets in the last join, so no pair of owners is moved, grouped or
    counted. An interface with a method without name has no types.
    """
    pool = nodes if language is None else nodes.where(F.col("language") == language)
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("id")).join(pool.where("kind = 'method'").select("id", "name"), "id")
    sets = inside.groupBy("owner").agg(F.array_sort(F.collect_set("name")).alias("names"), F.bool_or(F.col("name").isNull()).alias("unnamed"))
    sets = materialise(sets.join(pool.where("kind in ('struct', 'class', 'interface')").select(F.col("id").alias("owner"), "kind"), "owner"))
    have = sets.where("kind <> 'interface'").select(F.col("owner").alias("source"), F.col("names").alias("has"))
    want = sets.where("kind = 'interface' and not unnamed").select(F.col("owner").alias("target"), F.col("names").alias("needs"))
    held = have.groupBy("has").agg(F.min("source").alias("set"), F.count("*").alias("types"))
    asked = want.groupBy("needs").agg(F.min("target").alias("face"), F.count("*").alias("faces"))

    names = held.select("types", F.explode("has").alias("name")).groupBy("name").agg(F.sum("types").alias("types"))
    rare = asked.select("face", F.size("needs").alias("n"), F.explode("needs").alias("name")).join(names, "name").groupBy("face", "n").agg(F.min(F.struct("types", "name")).alias("m"), F.count("*").alias("known")).where("known = n")
    # many types and many interfaces of one set are cut into cells, each made where its part of both sides is
    cuts = lambda n: F.ceil(F.col(n) / F.lit(CELL))
    asked = materialise(asked.join(rare, "face").select("face", "needs", F.col("m.name").alias("name"), cuts("m.types").alias("down"), cuts("faces").alias("across")))

    whole = lambda has: F.size(F.array_except("needs", has)) == 0
    few = F.when(F.size("has") <= FEW, F.col("has"))
    fits = held.select("set", F.size("has").alias("n"), few.alias("few"), F.explode("has").alias("name")).join(asked, "name").where((F.size("needs") <= F.col("n")) & (F.col("few").isNull() | whole("few")))
    types = have.join(held.select("has", "set"), "has")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = fits.select("set", "face", "needs", "down", "across").join(types, "set").where(whole("has")).select("face", part("source", "down").alias("x"), every("across").alias("y"), "source")
    right = want.join(asked, "needs").select("face", every("down").alias("x"), part("target", "across").alias("y"), "target")
    return left.join(right, ["face", "x", "y"]).select("source", "target")


def decorator_edges(nodes: DataFrame) -> DataFrame:
    """(source, target): a decorated node and the function that its decorator names; unique names only."""
    names = nodes.where("kind = 'function'").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    used = nodes.select(F.col("id").alias("source"), F.explode("decorators").alias("d")).select("source", F.regexp_extract("d", r"([A-Za-z_]\w*)(?:\(.*)?$", 1).alias("name"))
    return used.join(names, "name").select("source", "target").distinct()


def channel_pairs(emitters: DataFrame, handlers: DataFrame, key: str, cap: int = 6) -> DataFrame:
    """Emitters and handlers of one channel; channels with more than `cap` on either side are too general and make no edges."""
    small = lambda d: d.join(d.groupBy(key).count().where(F.col("count") <= cap).select(key), key, "left_semi")
    a, b = small(emitters), small(handlers)
    return a.select(key, F.col("id").alias("source")).join(b.select(key, F.col("id").alias("target")), key).where("source <> target").select("source", "target", key).distinct()


def retargeted(edges: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Incoming edges of a file that was indexed again, led to the node of the same kind and name; the greatest id of several."""
    old = old_nodes.select(F.col("id").alias("target"), "kind", "name", "file_path").withColumnRenamed("kind", "node_kind")
    new = new_nodes.groupBy(F.col("kind").alias("node_kind"), "name", "file_path").agg(F.max("id").alias("new_target"))
    return edges.join(old, "target").join(new, ["node_kind", "name", "file_path"]).select("source", F.col("new_target").alias("target"), "kind", "line", "col").distinct()


def retryable(refs: DataFrame, ceiling: int = AMBIGUITY_CEILING) -> DataFrame:
    """Failed references whose name tail at most `ceiling` failed references share."""
    failed = refs.where("status = 'failed'")
    tails = failed.groupBy("name_tail").count().where(F.col("count") <= ceiling).select("name_tail")
    return failed.join(tails, "name_tail", "left_semi")


def apply_aliases(imports: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """imports with `resolved`: the first pattern with at most one `*` that fits leads to its replacement."""
    out = F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        head, star, tail = pattern.partition("*")
        s = F.col("source")
        if star:
            fits = s.startswith(head) & s.endswith(tail) & (F.length(s) >= len(head) + len(tail))
            mid = F.substr(s, F.lit(len(head) + 1), F.length(s) - len(head) - len(tail))
            a, _, b = target.partition("*")
            out = F.when(fits, F.concat(F.lit(a), mid, F.lit(b))).otherwise(out)
        else:
            out = F.when(s == pattern, F.lit(target)).otherwise(out)
    return imports.withColumn("resolved", out)


