"""Member references: function values, method calls, inherited members, receiver types, nested scopes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions import scoring
from codeloom.functions.text import camel_words
from codeloom.runtime import materialise

TYPES = ("class", "struct", "interface")
#: Languages in which a bare name never means a method; fixed values.
BARE_FUNCTIONS = ("typescript", "javascript", "tsx", "jsx", "python", "cpp", "php", "arkts")


def owner_of(qualified: Column) -> Column:
    """The segment before the last of a qualified name with `.` or `::`; blank if there is none."""
    return F.regexp_extract(qualified, r"([^.:]+)(?:\.|::)[^.:]+$", 1)


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row per ref_id by `order`, then the least target."""
    key = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), "target")
    return rows.groupBy("ref_id").agg(F.min(F.struct(key.alias("k"), "target", "confidence", "rule")).alias("m")).select("ref_id", "m.target", "m.confidence", "m.rule")


def resolve_function_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, rule): functions named as values.

    `A::b`: a callable with that qualified name or suffix, in the same file,
    or the only one, 0.9. A bare name: in the same file 0.95 if it is the only
    one there, else 0.9 for the first by line; elsewhere 0.8 if it is the only
    one. References need one language family and never lead to their own node.
    """
    asked = refs.where("reference_kind = 'function_ref' and reference_name not like 'this.%'").select("ref_id", "from_node_id", "reference_name", "file_path", "language")
    asked = asked.withColumn("name", F.regexp_extract("reference_name", r"([^:]+)$", 1)).withColumn("scoped", F.col("reference_name").contains("::"))
    c = nodes.where("kind in ('function', 'method')").select("name", F.col("id").alias("target"), F.col("kind").alias("k"), F.col("language").alias("l"), F.col("file_path").alias("f"), F.coalesce("start_line", F.lit(0)).alias("line"), "qualified_name")
    met = asked.join(c, "name").where((F.col("target") != F.col("from_node_id")) & scoring.same_family(F.col("l"), F.col("language")))
    fits = F.when(F.col("scoped"), (F.col("qualified_name") == F.col("reference_name")) | F.col("qualified_name").endswith(F.concat(F.lit("::"), F.col("reference_name")))).otherwise(
        (F.col("k") == "function") | ~F.coalesce(F.col("language").isin(*BARE_FUNCTIONS), F.lit(False))
    )
    here = F.coalesce(F.col("f") == F.col("file_path"), F.lit(False))
    first = F.struct("line", "target")
    per = met.where(fits).groupBy("ref_id").agg(F.max("scoped").alias("scoped"), F.count("*").alias("n"), F.count_if(here).alias("h"), F.min(F.when(here, first)).alias("inside"), F.min("target").alias("only"))
    confidence = F.when(F.col("scoped"), 0.9).when(F.col("h") == 1, 0.95).when(F.col("h") > 1, 0.9).otherwise(0.8)
    return per.where("h > 0 or n = 1").select("ref_id", F.when(F.col("h") > 0, F.col("inside.target")).otherwise(F.col("only")).alias("target"), confidence.alias("confidence"), F.lit("function-ref").alias("rule"))


def supertypes(nodes: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(name, language, super, distance): type names and those they extend or implement, through at most `depth` steps."""
    n = nodes.where(F.col("kind").isin(*TYPES, "trait", "protocol")).select("id", "name", "language")
    e = edges.where("kind in ('extends', 'implements')").select("source", "target").distinct()
    up = materialise(e.join(n.withColumnRenamed("id", "source"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("super")), "target").where("name <> super").select("name", "language", "super").distinct())
    out = front = up.withColumn("distance", F.lit(1))
    for k in range(2, depth + 1):
        nxt = up.select(F.col("name").alias("super"), "language", F.col("super").alias("far"))
        front = front.join(nxt, ["super", "language"]).select("name", "language", F.col("far").alias("super")).distinct().join(out, ["name", "language", "super"], "left_anti").where("name <> super").withColumn("distance", F.lit(k))
        front = materialise(front)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def methods_on_types(wanted: DataFrame, nodes: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """(ref_id, target, confidence, rule): the method of a type, or the nearest one that it inherits.

    wanted (ref_id, type, method, file_path, language[, fqn]). Methods match by
    the suffix `type.method` of their qualified name in the same language; of
    several, that whose path ends with the fully qualified name, then one in
    the calling file, then the least id.
    """
    rows = wanted if "fqn" in wanted.columns else wanted.withColumn("fqn", F.lit(None).cast("string"))
    asked = rows.select("ref_id", "type", "method", "file_path", "language", "fqn").withColumn("distance", F.lit(0))
    if supers is not None:
        up = supers.select(F.col("name").alias("type"), "language", "super", F.col("distance").alias("d"))
        asked = asked.unionByName(asked.join(up, ["type", "language"]).select("ref_id", F.col("super").alias("type"), "method", "file_path", "language", "fqn", F.col("d").alias("distance")))
    m = nodes.where("kind = 'method'").select(owner_of(F.col("qualified_name")).alias("type"), F.col("name").alias("method"), "language", F.col("id").alias("target"), F.col("file_path").alias("f"))
    met = asked.join(m, ["type", "method", "language"])
    path = F.regexp_replace("fqn", r"\.", "/")
    far = ~F.coalesce(F.regexp_replace("f", r"\.\w+$", "").endswith(path), F.lit(False))
    met = met.withColumns({"confidence": F.lit(0.9), "rule": F.lit("instance-method")})
    return _best(met, F.col("distance"), far, F.col("f") != F.col("file_path"))


#: How a name gets its type, per language, with {r} for the name; the first group is the type. Fixed values.
RECEIVERS = {
    "typescript": [r"\b{r}\s*(?:[?!])?:\s*([A-Z][\w.]*)", r"\b{r}\s*=\s*(?:await\s+)?new\s+([A-Z][\w.]*)", r"\b{r}\s*=\s*.*\bas\s+([A-Z][\w.]*)"],
    "javascript": [r"\b{r}\s*=\s*(?:await\s+)?new\s+([A-Z][\w.]*)"],
    "python": [r"\b{r}\s*:\s*['\"]?([A-Z][\w.]*)", r"\b{r}\s*=\s*(?:await\s+)?(?:\w+\.)*([A-Z]\w*)\("],
    "java": [r"\b([A-Z][\w.]*)(?:<[^;=]*>)?\s+{r}\s*[=;,)]", r"\b{r}\s*=\s*new\s+([A-Z][\w.]*)"],
    "kotlin": [r"\b{r}\s*:\s*([A-Z][\w.]*)", r"\b{r}\s*=\s*([A-Z]\w*)\("],
    "csharp": [r"\b([A-Z][\w.]*)(?:<[^;=]*>)?\s+{r}\s*[=;,)]", r"\b{r}\s*=\s*new\s+([A-Z][\w.]*)"],
    "go": [r"\b{r}\s*:?=\s*&?(?:\w+\.)?([A-Z]\w*)\{{", r"\bvar\s+{r}\s+\*?(?:\w+\.)?([A-Z]\w*)", r"[(,]\s*{r}\s+\*?(?:\w+\.)?([A-Z]\w*)"],
    "rust": [r"\b{r}\s*:\s*&?(?:mut\s+)?([A-Z]\w*)", r"\b{r}\s*=\s*([A-Z]\w*)(?:::|\s*\{{)"],
    "cpp": [r"\b([A-Z]\w*)(?:<[^;=]*>)?\s*[*&]?\s+[*&]?{r}\s*[=;,({{)]"],
    "php": [r"\$?{r}\s*=\s*new\s+\\?(?:\w+\\)*([A-Z]\w*)", r"\b\\?(?:\w+\\)*([A-Z]\w*)\s+\$?{r}\b"],
    "swift": [r"\b{r}\s*:\s*([A-Z]\w*)", r"\b{r}\s*=\s*([A-Z]\w*)\("],
    "ruby": [r"\b{r}\s*=\s*(?:\w+::)*([A-Z]\w*)\.new\b"],
}


def infer_receivers(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """(ref_id, type): the type of the receiver of each call, read from the lines before it.

    calls (ref_id, file_path, receiver, line, scope_line, language): lines are
    searched from the call up to the start of its scope; the nearest that
    gives the receiver a type decides. A text meets the calls of its file once.
    Lines from 1; without scope the search goes up to the first.
    """
    per_file = calls.where("file_path is not null and line > 0 and receiver is not null").groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct("ref_id", "receiver", "line", F.coalesce("scope_line", F.lit(1)).alias("scope"), "language")).alias("i"))
    ready = per_file.join(texts.select("path", "text"), "path").select("text", *(F.col(f"i.{c}").alias(c) for c in ("ref_id", "receiver", "line", "scope", "language")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[tuple, list[re.Pattern]] = {}
        for b in batches:
            out = []
            for text, *calls in zip(b["text"], b["ref_id"], b["receiver"], b["line"], b["scope"], b["language"]):
                lines = text.split("\n")
                for ref, receiver, line, scope, language in zip(*calls):
                    key = (language, receiver)
                    if key not in compiled:
                        if len(compiled) > 50_000:
                            compiled.clear()
                        compiled[key] = [re.compile(p.format(r=re.escape(receiver))) for p in RECEIVERS.get(language, ())]
                    for k in range(min(int(line), len(lines)) - 1, max(int(scope), 1) - 2, -1):
                        hit = next((m for p in compiled[key] if (m := p.search(lines[k]))), None)
                        if hit:
                            out.append((ref, hit[1].rpartition(".")[2]))
                            break
            yield pd.DataFrame(out, columns=["ref_id", "type"])

    return ready.mapInPandas(scan, "ref_id string, type string")


def resolve_method_calls(refs: DataFrame, nodes: DataFrame, receivers: DataFrame | None = None, supers: DataFrame | None = None, ceiling: int = 500) -> DataFrame:
    """(ref_id, target, confidence, rule) of `receiver.method` references, the first rule that holds.

    The receiver's inferred type has or inherits the method: 0.9. The receiver
    is the name of a type with that method: 0.85; with a capital letter it is:
    0.8. Only one method of that name in the language (or at all, if it is the
    language's): 0.7. Of several, that whose qualified name shares most words
    with the receiver, one more for the language, at least two: 0.65. Names of
    more than `ceiling` nodes reach the first three rules only.
    """
    pattern = r"^([\w.]+)(?:\.|::|:|\$|->)(\w+)$"
    asked = refs.where(F.col("reference_name").rlike(pattern)).select("ref_id", "file_path", "language", F.regexp_extract("reference_name", pattern, 1).alias("receiver"), F.regexp_extract("reference_name", pattern, 2).alias("method"))
    parts = []
    if receivers is not None:
        parts.append((0, methods_on_types(asked.join(receivers, "ref_id"), nodes, supers)))
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    types = nodes.where(F.col("kind").isin(*TYPES)).select(F.col("name").alias("type"), "language", F.col("file_path").alias("f")).distinct()
    m = nodes.where("kind = 'method'").select(F.col("name").alias("method"), "language", F.col("file_path").alias("f"), F.col("id").alias("target"), "qualified_name")
    for k, (name, confidence, rule) in enumerate([(F.col("receiver"), 0.85, "qualified-name"), (capital, 0.8, "instance-method")]):
        rows = asked.where(name != F.col("receiver")) if k else asked
        met = rows.withColumn("type", name).join(types, ["type", "language"]).join(m, ["f", "method", "language"]).where(F.contains("qualified_name", F.col("type")))
        parts.append((k + 1, _best(met.withColumns({"confidence": F.lit(confidence), "rule": F.lit(rule)}), F.col("f") != F.col("file_path"))))
    few = nodes.groupBy(F.col("name").alias("method")).agg(F.count("*").alias("n")).where(F.col("n") <= ceiling)
    # one row per method name: a list of at most `ceiling` candidates
    cands = nodes.where("kind = 'method'").join(few, nodes["name"] == few["method"], "left_semi").groupBy(F.col("name").alias("method")).agg(F.collect_list(F.struct("id", F.col("language").alias("l"), F.col("file_path").alias("f"), F.transform(camel_words(F.regexp_replace("qualified_name", r"[.:]+", " ")), F.lower).alias("words"))).alias("c"))
    same = lambda x: F.coalesce(x["l"] == F.col("language"), F.lit(False))
    met = asked.join(cands, "method").withColumn("own", F.filter("c", same)).withColumn("pool", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("c")))
    one = met.where((F.size("pool") == 1) & same(F.col("pool")[0])).select("ref_id", F.col("pool")[0]["id"].alias("target"), F.lit(0.7).alias("confidence"), F.lit("instance-method").alias("rule"))
    parts.append((3, one))
    words = F.transform(camel_words(F.regexp_replace("receiver", r"[.:]+", " ")), F.lower)
    score = lambda x: F.size(F.filter(words, lambda w: F.array_contains(x["words"], w))) + F.when(same(x), 1).otherwise(0)
    best = F.array_min(F.transform("pool", lambda x: F.struct((-score(x)).alias("s"), (x["f"] != F.col("file_path")).alias("away"), x["id"].alias("id"))))
    many = met.where(F.size("pool") > 1).select("ref_id", best.alias("b")).where("b.s <= -2").select("ref_id", F.col("b.id").alias("target"), F.lit(0.65).alias("confidence"), F.lit("instance-method").alias("rule"))
    parts.append((4, many))
    out = None
    for k, p in parts:
        p = p.withColumn("k", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("ref_id").agg(F.min(F.struct("k", "target", "confidence", "rule")).alias("m")).select("ref_id", "m.target", "m.confidence", "m.rule")


def return_types(nodes: DataFrame) -> DataFrame:
    """(name, owner, language, type): what callables return, from return_type or the signature's end, without containers and pointers."""
    declared = F.coalesce(F.nullif(F.col("return_type"), F.lit("")), F.regexp_extract("signature", r"(?:->|\)\s*:)\s*([^{=;]+?)\s*[:{]?\s*$", 1))
    inner = F.regexp_extract(declared, r"(?:Promise|Awaitable|Optional|Future|Task)\s*[<\[]\s*([^>\]]+)", 1)
    bare = F.regexp_extract(F.when(inner != "", inner).otherwise(declared), r"([A-Za-z_]\w*)\s*(?:\[\])?[?!]?$", 1)
    rows = nodes.where("kind in ('function', 'method')").select("name", owner_of(F.col("qualified_name")).alias("owner"), "language", bare.alias("type"), F.col("id").alias("callable"))
    return rows.where("type <> ''")


def resolve_chains(refs: DataFrame, nodes: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """(ref_id, target, confidence, rule) of `a.b().c` and `b().c` references: the method `c` on the type that `b` returns.

    `b` is looked up on its owner `a` where that names a type, else by its
    name; of several return types the least.
    """
    pattern = r"^(?:([\w.]+)(?:\.|::|->))?(\w+)\(\)(?:\.|::|->)(\w+)$"
    part = lambda k: F.regexp_extract("reference_name", pattern, k)
    asked = refs.where(F.col("reference_name").rlike(pattern)).select("ref_id", "file_path", "language", F.regexp_extract(part(1), r"(\w+)$", 1).alias("owner"), part(2).alias("name"), part(3).alias("method"))
    given = return_types(nodes)
    exact = asked.join(given, ["owner", "name", "language"]).withColumn("p", F.lit(0))
    loose = asked.drop("owner").join(given.drop("owner"), ["name", "language"]).withColumn("p", F.lit(1))
    both = exact.drop("owner").unionByName(loose)
    one = both.groupBy("ref_id").agg(F.min(F.struct("p", "type", "method", "file_path", "language")).alias("m")).select("ref_id", "m.type", "m.method", "m.file_path", "m.language")
    return methods_on_types(one, nodes, supers).withColumns({"confidence": F.lit(0.85), "rule": F.lit("call-chain")})


def resolve_this_members(refs: DataFrame, nodes: DataFrame, supers: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, rule) of `this.x` and `self.x`: the member of the enclosing type or of what it inherits from, 0.85."""
    asked = refs.where(F.col("reference_name").rlike(r"^(?:this|self)(?:\.|->)\w+$")).select("ref_id", "from_node_id", "file_path", "language", F.regexp_extract("reference_name", r"(\w+)$", 1).alias("method"))
    at = nodes.select(F.col("id").alias("from_node_id"), owner_of(F.col("qualified_name")).alias("type"))
    return methods_on_types(asked.join(at, "from_node_id").where("type <> ''"), nodes, supers).withColumns({"confidence": F.lit(0.85), "rule": F.lit("this-member")})


def enclosing_callables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, container): the nearest function or method around each node; nodes without one, or on a cycle without one, are missing.

    Pointer doubling: a pointer that has not met a callable takes over the
    pointer it leads to; one that leads to a root ends. A round that settles
    none leaves cycles only.
    """
    up = edges.where("kind = 'contains'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("at"))
    kinds = nodes.select(F.col("id").alias("at"), F.col("kind").isin("function", "method").alias("hit"))
    state = materialise(up.join(kinds, "at").select("id", "at", "hit"))
    found, before = [state.where("hit")], None
    open_ = state.where("not hit")
    while (left := open_.count()) and left != before:
        before = left
        every = open_
        for f in found:
            every = every.unionByName(f)
        far = every.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("hit").alias("hit2"))
        state = materialise(open_.join(far, "at").select("id", F.col("at2").alias("at"), F.col("hit2").alias("hit")))
        found.append(state.where("hit"))
        open_ = state.where("not hit")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("id", F.col("at").alias("container"))


def lexically_reachable(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (source, target, ...) whose target is visible from the source.

    A function inside another function or method is visible in it alone: the
    source is that container or lies in it. Targets of other kinds and at the
    top are always visible.
    """
    around = materialise(enclosing_callables(nodes, edges))
    nested = around.join(nodes.where("kind = 'function'").select("id"), "id", "left_semi").select(F.col("id").alias("target"), "container")
    held = materialise(pairs.join(nested, "target"))
    free = pairs.join(nested.select("target"), "target", "left_anti")
    front = held.select("source", F.col("source").alias("at")).distinct()
    inside = front
    up = around.select(F.col("id").alias("at"), "container")
    while True:  # one round per level of nested callables
        front = materialise(front.join(up, "at").select("source", F.col("container").alias("at")).join(inside, ["source", "at"], "left_anti"))
        if front.isEmpty():
            break
        inside = inside.unionByName(front)
    ok = held.join(inside.select("source", F.col("at").alias("container")).distinct(), ["source", "container"]).drop("container")
    return free.select(*pairs.columns).unionByName(ok.select(*pairs.columns))
