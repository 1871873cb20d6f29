"""Edges across languages and conventions: C function pointers, selectors, closures, routes by parameter type, build members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.graph import enclosing
from codeloom.operators.resolve import channel_pairs
from codeloom.operators.synthesis import pattern_points
from codeloom.runtime import materialise

_NO_COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"


def _all(text, pattern: str, **groups: int):
    """An array of structs, one per match."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), g).alias(k) for k, g in groups.items()))


def _c_texts(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("language").isin("c", "cpp") & F.col("text").isNotNull()).select("path", F.regexp_replace("text", _NO_COMMENT, " ").alias("text"))


def pointer_types(texts: DataFrame) -> DataFrame:
    """(name): typedefs of pointers to functions."""
    return _c_texts(texts).select(F.explode(F.regexp_extract_all("text", F.lit(r"\btypedef\s+[^;(){}]*\(\s*\*\s*(\w+)\s*\)\s*\("), 1)).alias("name")).distinct()


def struct_layout(texts: DataFrame) -> DataFrame:
    """(struct, position, field, pointer): the fields of structs in order; pointer if they hold a function, by form or typedef."""
    body = _c_texts(texts).select(F.explode(F.concat(_all("text", r"\bstruct\s+(\w+)\s*\{([^{}]*)\}", s=1, b=2), _all("text", r"\btypedef\s+struct\s*\w*\s*\{([^{}]*)\}\s*(\w+)\s*;", s=2, b=1))).alias("x"))
    fields = body.select(F.col("x.s").alias("struct"), F.posexplode(F.filter(F.split("x.b", ";"), lambda f: F.btrim(f, F.lit(" \t\n\r")) != "")).alias("position", "f"))
    direct = F.regexp_extract("f", r"\(\s*\*\s*(\w+)\s*\)\s*\(", 1)
    name = F.when(direct != "", direct).otherwise(F.regexp_extract("f", r"(\w+)\s*(?:\[[^\]]*\])?\s*(?::\s*\d+)?\s*$", 1))
    rows = fields.select("struct", "position", name.alias("field"), (direct != "").alias("d"), F.regexp_extract("f", r"(\w+)\s+\*?\w+\s*(?:\[[^\]]*\])?\s*$", 1).alias("name")).where("field <> ''")
    known = pointer_types(texts).withColumn("t", F.lit(True))
    return rows.join(known, "name", "left").select("struct", "position", "field", (F.col("d") | F.coalesce("t", F.lit(False))).alias("pointer")).distinct()


def pointer_registrations(texts: DataFrame, layout: DataFrame, nodes: DataFrame) -> DataFrame:
    """(struct, field, target): functions that initialisers put into pointer fields, by name or by position.

    Only texts with a known struct before an initialiser are looked into. A
    function of the same file is preferred, else the least id of the name.
    """
    start = r"\b(?:struct\s+)?(\w+)\s+\w+\s*(?:\[[^\]]*\])?\s*=\s*\{((?:[^{};]|\{[^{}]*\})*)\}\s*;"
    inits = _c_texts(texts).select("path", F.explode(_all("text", start, s=1, b=2)).alias("x")).select("path", F.col("x.s").alias("struct"), F.col("x.b").alias("b"))
    inits = inits.join(layout.where("pointer").select("struct").distinct(), "struct", "left_semi")
    # each inner pair of braces is an element of an array of structs
    parts = F.when(F.col("b").contains("{"), F.regexp_extract_all("b", F.lit(r"\{([^{}]*)\}"), 1)).otherwise(F.array("b"))
    each = inits.select("path", "struct", F.explode(parts).alias("e"))
    items = each.select("path", "struct", F.posexplode(F.split("e", ",")).alias("position", "i")).withColumn("i", F.btrim("i", F.lit(" \t\n\r&")))
    named = items.where("i like '.%'").select("path", "struct", F.regexp_extract("i", r"^\.(\w+)", 1).alias("field"), F.regexp_extract("i", r"=\s*&?(\w+)\s*$", 1).alias("name"))
    placed = items.where("i not like '.%'").join(layout.select("struct", "position", "field"), ["struct", "position"]).select("path", "struct", "field", F.regexp_extract("i", r"^(\w+)$", 1).alias("name"))
    rows = named.unionByName(placed).where("name <> ''").join(layout.where("pointer").select("struct", "field"), ["struct", "field"], "left_semi").distinct()
    functions = nodes.where("kind in ('function', 'method')").select("name", "file_path", "id")
    met = rows.join(functions, "name").groupBy("path", "struct", "field", "name").agg(F.min(F.when(F.col("file_path") == F.col("path"), F.col("id"))).alias("here"), F.min("id").alias("any"))
    return met.select("struct", "field", F.coalesce("here", "any").alias("target")).distinct()


def propagated(registered: DataFrame, texts: DataFrame, layout: DataFrame, passes: int = 3) -> DataFrame:
    """registered with what `a.f = b.g` passes on: the targets of g reach f where both fields have one owner; at most `passes` rounds, until nothing changes."""
    pairs = _c_texts(texts).select(F.explode(_all("text", r"(?:->|\.)(\w+)\s*=\s*[\w.>\-\[\]]*?(?:->|\.)(\w+)\s*;", f=1, g=2)).alias("x")).select("x.f", "x.g").distinct()
    owner = layout.where("pointer").groupBy("field").agg(F.count_distinct("struct").alias("n"), F.min("struct").alias("struct")).where("n = 1").select("field", "struct")
    step = pairs.join(owner.select(F.col("field").alias("f"), F.col("struct").alias("to")), "f").join(owner.select(F.col("field").alias("g"), F.col("struct").alias("of")), "g")
    out = materialise(registered)
    for _ in range(passes):
        new = out.join(step, (out.struct == step.of) & (out.field == step.g)).select(F.col("to").alias("struct"), F.col("f").alias("field"), "target").distinct().join(out, ["struct", "field", "target"], "left_anti")
        new = materialise(new)
        if new.isEmpty():
            break
        out = out.unionByName(new)
    return out


def pointer_edges(nodes: DataFrame, texts: DataFrame, cap: int = 300) -> DataFrame:
    """(source, target, field): functions that call through a pointer field, and the functions registered in it.

    The receiver's declared struct decides, else the only struct with that
    field. At most `cap` edges per calling function, the least targets.
    """
    layout = materialise(struct_layout(texts))
    targets = propagated(pointer_registrations(texts, layout, nodes), texts, layout)
    lines = texts.where(F.col("language").isin("c", "cpp"))
    calls = pattern_points(lines, r"\w+(?:\[[^\]]*\])?(?:->|\.)\w+\s*\(", "l", 0)
    calls = calls.select("file_path", "line", F.regexp_extract("l", r"(\w+)(?:\[[^\]]*\])?(?:->|\.)(\w+)\s*\(", 1).alias("receiver"), F.regexp_extract("l", r"(\w+)(?:\[[^\]]*\])?(?:->|\.)(\w+)\s*\(", 2).alias("field"))
    inside = enclosing(calls.join(layout.where("pointer").select("field").distinct(), "field", "left_semi"), nodes).where("enclosing is not null")
    declared = _c_texts(texts).select(F.col("path").alias("file_path"), F.explode(_all("text", r"\b(?:const\s+)?(?:struct\s+)?(\w+)\s*\*?\s+\*?(\w+)\s*(?:\[[^\]]*\])?\s*[,;)=]", t=1, r=2)).alias("x")).select("file_path", F.col("x.t").alias("struct"), F.col("x.r").alias("receiver"))
    typed = declared.join(layout.select("struct").distinct(), "struct", "left_semi").groupBy("file_path", "receiver").agg(F.min("struct").alias("typed"))
    owner = layout.where("pointer").groupBy("field").agg(F.count_distinct("struct").alias("n"), F.min("struct").alias("only")).where("n = 1").select("field", "only")
    known = inside.join(typed, ["file_path", "receiver"], "left").join(owner, "field", "left").withColumn("struct", F.coalesce("typed", "only")).where("struct is not null")
    rows = known.join(targets, ["struct", "field"]).select(F.col("enclosing").alias("source"), "target", "field").where("source <> target").distinct()
    w = Window.partitionBy("source").orderBy("target", "field")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def table_edges(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, target, table): functions that call an entry of an array of functions, and the functions in it; the only table of the name, else that of the file."""
    c = _c_texts(texts)
    tables = c.select("path", F.explode(_all("text", r"\(?\*?\s*(\w+)\s*\[[^\]]*\]\s*\)?\s*(?:\([^)]*\))?\s*=\s*\{([\w\s,&]+)\}\s*;", t=1, b=2)).alias("x")).select("path", F.col("x.t").alias("table"), F.explode(F.split("x.b", ",")).alias("f"))
    entries = tables.withColumn("name", F.btrim("f", F.lit(" \t\n\r&"))).join(nodes.where("kind = 'function'").groupBy("name").agg(F.min("id").alias("target")), "name").select("path", "table", "target").distinct()
    counted = entries.groupBy("table").agg(F.count_distinct("path").alias("n"))
    calls = pattern_points(texts.where(F.col("language").isin("c", "cpp")), r"\b(\w+)\s*\[[^\]]+\]\s*\(", "table")
    inside = enclosing(calls, nodes).where("enclosing is not null").select("file_path", "table", F.col("enclosing").alias("source")).distinct()
    met = inside.join(entries, "table").join(counted, "table").where("n = 1 or path = file_path")
    return met.select("source", "target", "table").where("source <> target").distinct()


def selector(signature, name):
    """The Objective-C selector of a Swift method: its name and the labels of its parameters, the first with a capital; `_` has no label."""
    params = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    labels = F.transform(F.filter(F.split(params, ","), lambda p: F.btrim(p) != ""), lambda p: F.regexp_extract(F.btrim(p), r"^(\w+)", 1))
    first = F.try_element_at(labels, F.lit(1))
    head = F.when(F.size(labels) == 0, name).when(first == "_", F.concat(name, F.lit(":"))).otherwise(F.concat(name, F.initcap(F.substring(first, 1, 1)), F.expr("''"), F.substr(first, F.lit(2)), F.lit(":")))
    rest = F.array_join(F.transform(F.slice(labels, 2, 1000), lambda x: F.concat(F.when(x == "_", F.lit("")).otherwise(x), F.lit(":"))), "")
    return F.concat(head, F.coalesce(rest, F.lit("")))


def selector_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence): Objective-C messages and the Swift methods they reach.

    The whole selector 0.95 (0.6 if several methods have it), else the Swift
    base name by the first part of the selector, with or without a preposition
    and what follows, if only one method fits: 0.5.
    """
    swift = nodes.where("language = 'swift' and kind in ('method', 'function')").select(F.col("id").alias("target"), "name", selector(F.col("signature"), F.col("name")).alias("selector"))
    asked = refs.where("language = 'objc'").select("ref_id", F.col("reference_name").alias("selector"))
    per = swift.groupBy("selector").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    exact = asked.join(per, "selector").select("ref_id", "target", F.when(F.col("n") == 1, 0.95).otherwise(0.6).alias("confidence"))
    base = F.regexp_replace(F.split_part("selector", F.lit(":"), F.lit(1)), r"(?:With|For|From|At|In|By|To|Of|On)[A-Z]\w*$", "")
    names = swift.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    loose = asked.join(exact.select("ref_id"), "ref_id", "left_anti").withColumn("name", base).join(names, "name").select("ref_id", "target", F.lit(0.5).alias("confidence"))
    return exact.unionByName(loose)


def closure_edges(nodes: DataFrame, texts: DataFrame, cap: int = 8) -> DataFrame:
    """(source, target, field): in Swift and Kotlin, functions that run the closures of a collection and those that add to it; fields with more than `cap` on either side make none."""
    t = texts.where(F.col("language").isin("swift", "kotlin"))
    around = lambda p: enclosing(pattern_points(t, p, "field"), nodes).where("enclosing is not null").select(F.col("enclosing").alias("id"), "field").distinct()
    runs = around(r"\bfor\s*\(?\s*\w+\s+in\s+(?:self\.|this\.)?(\w+)").unionByName(around(r"\b(?:self\.|this\.)?(\w+)\.forEach\b")).distinct()
    adds = around(r"\b(?:self\.|this\.)?(\w+)(?:\.(?:append|add)\s*[({]|\s*\+=\s*\{)")
    return channel_pairs(runs, adds, "field", cap)


def parameter_routes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, target, method, route): Go request types that carry their route, and the handlers that take them; the qualified type first, then the bare name if it is the only one."""
    go = texts.where("language = 'go' and text is not null").withColumn("package", F.regexp_extract("text", r"(?m)^package\s+(\w+)", 1))
    marker = r"type\s+(\w+)\s+struct\s*\{\s*g\.Meta\s+`([^`]*)`"
    tags = go.select("path", "package", F.explode(_all("text", marker, t=1, tag=2)).alias("x")).select("path", "package", F.col("x.t").alias("type"), F.regexp_extract("x.tag", r"path:\"([^\"]*)\"", 1).alias("route"), F.regexp_extract("x.tag", r"method:\"([^\"]*)\"", 1).alias("method")).where("route <> ''")
    takes = r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\([^)]*\*(?:(\w+)\.)?(\w+)\s*[,)]"
    handlers = go.select(F.col("path").alias("file_path"), F.col("package").alias("own"), F.explode(_all("text", takes, name=1, q=2, t=3)).alias("x")).select("file_path", F.col("x.name").alias("name"), F.when(F.col("x.q") != "", F.col("x.q")).otherwise(F.col("own")).alias("package"), F.col("x.t").alias("type"))
    handlers = handlers.join(nodes.where("kind in ('function', 'method')").select("file_path", "name", F.col("id").alias("target")), ["file_path", "name"]).select("package", "type", "target")
    types = nodes.where("kind = 'struct'").select(F.col("file_path").alias("path"), F.col("name").alias("type"), F.col("id").alias("source"))
    marked = tags.join(types, ["path", "type"])
    exact = marked.join(handlers, ["package", "type"]).select("source", "target", "method", "route")
    one = handlers.groupBy("type").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    bare = marked.join(exact.select("source").distinct(), "source", "left_anti").join(one, "type").select("source", "target", "method", "route")
    return exact.unionByName(bare).distinct()


def cargo_members(texts: DataFrame) -> DataFrame:
    """(path, member): members of Cargo workspaces (path, text)."""
    listed = F.regexp_extract("text", r"(?s)\[workspace\].*?members\s*=\s*\[([^\]]*)\]", 1)
    return texts.select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"\"([^\"]+)\""), 1)).alias("member"))
