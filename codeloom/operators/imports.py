"""Imports: mappings of local names, re-exports, the files they lead to, and references resolved through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions import scoring
from codeloom.runtime import materialise

_NAME = r"[A-Za-z_$][\w$]*"
_ES = (r"(?m)^\s*import\s+([^'\";]*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]", 1, 2, "es")
_BARE = (r"(?m)^\s*import\s+()['\"]([^'\"]+)['\"]", 1, 2, "bare")
_CJS = (r"(?m)^\s*(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, 2, "cjs")
_JVM = (r"(?m)^\s*import\s+(?:static\s+)?[\w.]+?\.(\w+|\*)(?:\s+as\s+\w+)?\s*;?\s*$", 1, 0, "jvm")
#: Per language: pattern of a statement, group of its clause, group of its source (0: the whole statement), style of the clause.
STATEMENTS: dict[str, list[tuple[str, int, int, str]]] = {
    "typescript": [_ES, _BARE, _CJS],
    "javascript": [_ES, _BARE, _CJS],
    "tsx": [_ES, _BARE, _CJS],
    "jsx": [_ES, _BARE, _CJS],
    "python": [(r"(?m)^\s*from\s+[\w.]+\s+import\s+(\([^)]*\)|[^\n#;]+)", 1, 0, "py"), (r"(?m)^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)\s*(?:#.*)?$", 1, 0, "pymod")],
    "java": [_JVM],
    "kotlin": [_JVM],
    "scala": [_JVM],
    "go": [(r"(?m)^(?:import\s+|\s+)((?:[\w.]+\s+)?)\"([\w./-]+)\"\s*(?://.*)?$", 1, 2, "go")],
    "rust": [(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", 1, 1, "rust")],
    "csharp": [(r"(?m)^\s*using\s+(?:static\s+)?((?:\w+\s*=\s*)?)([\w.]+)\s*;", 1, 2, "using")],
    "php": [(r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\s+as\s+\w+)?)\s*;", 1, 1, "php")],
    "c": [(r"(?m)^\s*#\s*include\s*([<\"])([^>\"]+)[>\"]", 1, 2, "bare")],
    "cpp": [(r"(?m)^\s*#\s*include\s*([<\"])([^>\"]+)[>\"]", 1, 2, "bare")],
    "ruby": [(r"(?m)^\s*require(?:_relative)?\s+()['\"]([^'\"]+)['\"]", 1, 2, "bare")],
    "lua": [(r"(?m)^\s*local\s+(\w+)\s*=\s*require\s*\(?\s*['\"]([^'\"]+)['\"]", 1, 2, "cjs")],
}


def _entry(local: Column, exported: Column, source: Column, default: bool | Column = False, namespace: bool | Column = False) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(local.alias("local_name"), exported.alias("exported_name"), source.alias("source"), col(default).alias("is_default"), col(namespace).alias("is_namespace"))


def _listed(clause: Column) -> Column:
    """The items of a comma list without brackets and comments."""
    bare = F.regexp_replace(F.regexp_replace(clause, r"#[^\n]*|//[^\n]*", " "), r"[(){}\\]", " ")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _tail(c: Column, sep: str) -> Column:
    return F.regexp_extract(c, rf"([^{sep}]*)$", 1)


def _renamed(items: Column, source: Column, mark: str) -> Column:
    """`a`, `a as b` (or `a: b`) as entries."""

    def one(x):
        pattern = rf"^(?:type )?(\*|default|{_NAME}){mark}({_NAME})$"
        name = F.regexp_replace(x, "^type ", "")
        renamed = x.rlike(pattern)
        exported = F.when(renamed, F.regexp_extract(x, pattern, 1)).otherwise(name)
        return _entry(F.when(renamed, F.regexp_extract(x, pattern, 2)).otherwise(name), exported, source, exported == "default", exported == "*")

    return F.transform(items, one)


def _entries(style: Column, clause: Column, source: Column, statement: Column) -> Column:
    none = F.array().cast("array<struct<local_name:string,exported_name:string,source:string,is_default:boolean,is_namespace:boolean>>")
    some = lambda found, entry: F.when(found != "", F.array(entry)).otherwise(none)
    braces = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    default = F.regexp_extract(clause, rf"^(?:type\s+)?({_NAME})\s*(?:,|$)", 1)
    star = F.regexp_extract(clause, rf"\*\s*as\s+({_NAME})", 1)
    es = F.concat(some(default, _entry(default, F.lit("default"), source, True)), some(star, _entry(star, F.lit("*"), source, False, True)), _renamed(_listed(braces), source, " as "))
    cjs = F.when(clause.startswith("{"), _renamed(_listed(braces), source, " ?: ?")).otherwise(F.array(_entry(clause, F.lit("default"), source, True)))
    py_from = F.regexp_extract(statement, r"from\s+([\w.]+)\s+import", 1)

    def module(x):
        name, alias = F.regexp_extract(x, r"^([\w.]+)", 1), F.regexp_extract(x, r" as (\w+)$", 1)
        return _entry(F.when(alias != "", alias).otherwise(F.split_part(name, F.lit("."), F.lit(1))), F.lit("*"), name, False, True)

    pymod = F.transform(_listed(clause), module)
    jvm_source = F.regexp_extract(statement, r"import\s+(?:static\s+)?([\w.]+?)\.(?:\w+|\*)(?:\s+as\s+\w+)?\s*;?\s*$", 1)
    jvm_alias = F.regexp_extract(statement, r"\sas\s+(\w+)", 1)
    jvm = F.array(_entry(F.when(jvm_alias != "", jvm_alias).otherwise(clause), clause, jvm_source, False, clause == "*"))
    alias = F.btrim(clause)
    go = F.array(_entry(F.when(alias != "", alias).otherwise(_tail(source, "/")), F.lit("*"), source, False, True))
    using_alias = F.btrim(F.regexp_replace(clause, "=", ""))
    using = F.array(_entry(F.when(using_alias != "", using_alias).otherwise(F.lit("*")), F.lit("*"), source, False, True))
    php_name = F.regexp_extract(clause, r"^([\w\\]+)", 1)
    php_alias = F.regexp_extract(clause, r"\sas\s+(\w+)$", 1)
    php = F.array(_entry(F.when(php_alias != "", php_alias).otherwise(_tail(php_name, r"\\")), _tail(php_name, r"\\"), php_name))
    rust_head = F.regexp_replace(F.regexp_extract(clause, r"^([^{]*?)(?:::)?(?:\{|$)", 1), r"\s+as\s+\w+$", "")
    one_path = F.regexp_replace(rust_head, r"::[^:]*$", "")
    rust = F.when(clause.contains("{"), _renamed(_listed(F.regexp_extract(clause, r"\{([^}]*)\}", 1)), rust_head, " as ")).otherwise(
        _renamed(F.array(F.regexp_extract(clause, r"([^:]*)$", 1)), one_path, " as ")
    )
    bare = F.array(_entry(F.lit(""), F.lit(""), source))
    table = {"es": es, "cjs": cjs, "py": _renamed(_listed(clause), py_from, " as "), "pymod": pymod, "jvm": jvm, "go": go, "using": using, "php": php, "rust": rust, "bare": bare}
    out = none
    for k, v in table.items():
        out = F.when(style == k, v).otherwise(out)
    return out


def import_mappings(texts: DataFrame) -> DataFrame:
    """(path, local_name, exported_name, source, is_default, is_namespace) of the import statements of texts (path, language, text).

    Lists give one row per name, with aliases; `default` and `*` stand for a
    default export and a whole module. Imports for their effect alone and
    includes have empty names. Statements are found where the text is read and
    only they leave the row. Null texts and other languages give no rows.
    """
    found = []
    for language, rules in STATEMENTS.items():
        for pattern, clause, source, style in rules:
            p = F.lit(pattern)
            whole = F.regexp_extract_all("text", p, 0)
            parts = F.arrays_zip(whole.alias("s"), F.regexp_extract_all("text", p, clause).alias("c"), F.regexp_extract_all("text", p, source).alias("f"))
            tag = F.lit(style).alias("style")
            found.append(F.when(F.col("language") == language, F.transform(parts, lambda x: F.struct(tag, x["s"].alias("s"), F.btrim(x["c"]).alias("c"), x["f"].alias("f")))))  # noqa: B023 - called at once
    rows = texts.where(F.col("language").isin(*STATEMENTS)).select("path", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x")).select("path", "x.*")
    return rows.select("path", F.explode(_entries(F.col("style"), F.col("c"), F.col("f"), F.btrim("s"))).alias("m")).select("path", "m.*").distinct()


def reexports(texts: DataFrame) -> DataFrame:
    """(path, local_name, exported_name, source): what a script module passes on; `*` for all of it. local_name is the name it is known by from here."""
    p = F.lit(r"(?m)^\s*export\s+(?:type\s+)?(\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?)\s*from\s*['\"]([^'\"]+)['\"]")
    pairs = F.arrays_zip(F.regexp_extract_all("text", p, 1).alias("c"), F.regexp_extract_all("text", p, 2).alias("source"))
    rows = texts.where(F.col("language").isin("typescript", "javascript", "tsx", "jsx")).select("path", F.explode(pairs).alias("x")).select("path", F.btrim("x.c").alias("c"), "x.source")
    star = F.regexp_extract("c", r"^\*\s*as\s+([\w$]+)", 1)
    whole = F.array(_entry(F.when(star != "", star).otherwise(F.lit("*")), F.lit("*"), F.col("source"), False, True))
    return rows.select("path", F.explode(F.when(F.col("c").startswith("*"), whole).otherwise(_renamed(_listed(F.col("c")), F.col("source"), " as "))).alias("m")).select("path", "m.local_name", "m.exported_name", "m.source").distinct()


#: What is tried after the stem of an import, in order, per language of the importing file; fixed values.
PROBES = {
    "typescript": ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
    "javascript": ("", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts"),
    "python": (".py", "/__init__.py", ".pyi"),
    "java": (".java",),
    "kotlin": (".kt", ".java"),
    "rust": (".rs", "/mod.rs"),
    "lua": (".lua", "/init.lua"),
    "ruby": (".rb",),
    "c": ("", ".h"),
    "cpp": ("", ".h", ".hpp"),
    "php": (".php",),
}


def _normal(base: Column, source: Column) -> Column:
    """Path of a relative source seen from a folder (array of names); a step up cancels the name before it."""
    step = lambda acc, s: F.when(s.isin(".", ""), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(source, "/"), base, step), "/")


def resolve_imports(mappings: DataFrame, files: DataFrame, include_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(path, source, target_path): the file each import source leads to, the first of its probes that exists.

    Relative sources start at the importing file's folder; dotted modules of
    Python, Java, Kotlin, Lua and Rust are looked up from the folder of the
    importing file and every folder above it, the nearest first; includes
    beside the file, then in the include folders. Go imports lead to a folder
    whose path ends with theirs, its least file stands for it. Unknown sources
    give no row.
    """
    from codeloom.sources.scan import detect_language

    rows = mappings.where("source is not null and source <> ''").select("path", "source").distinct().withColumn("language", detect_language(F.col("path")))
    rows = rows.withColumn("language", F.when(F.col("language").isin("tsx"), "typescript").when(F.col("language").isin("jsx"), "javascript").otherwise(F.col("language")))
    base = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    s = F.col("source")
    script = F.col("language").isin("typescript", "javascript", "ruby") & s.rlike(r"^\.\.?(/|$)")
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    dotted = F.regexp_replace(F.regexp_replace(s, r"^\.+", ""), r"\.|::|\\", "/")
    module = F.col("language").isin("python", "java", "kotlin", "lua", "rust", "php")
    ups = F.transform(F.sequence(F.lit(0), F.size(base)), lambda k: F.concat_ws("/", F.array_join(F.slice(base, F.lit(1), F.size(base) - k), "/"), dotted))
    own = F.concat_ws("/", F.array_join(F.slice(base, F.lit(1), F.greatest(F.size(base) - dots + 1, F.lit(0))), "/"), dotted)
    stems = (
        F.when(script, F.array(_normal(base, s)))
        .when((F.col("language") == "python") & (dots > 0), F.array(own))
        .when(module, ups)
        .when(F.col("language").isin("c", "cpp"), F.array(_normal(base, s), *(F.concat(F.lit(d.rstrip("/") + "/"), s) for d in include_dirs)))
    )
    probes = F.lit(None).cast("array<string>")
    for language, tries in PROBES.items():
        probes = F.when(F.col("language") == language, F.array(*map(F.lit, tries))).otherwise(probes)
    at = rows.where(stems.isNotNull()).select("path", "source", F.posexplode(stems).alias("a", "stem"), probes.alias("probes")).select("path", "source", "a", "stem", F.posexplode("probes").alias("b", "ext"))
    known = files.select(F.col("path").alias("target_path")).distinct()
    hit = at.select("path", "source", "a", "b", F.regexp_replace(F.concat("stem", "ext"), "^/", "").alias("target_path")).join(known, "target_path")
    found = hit.groupBy("path", "source").agg(F.min_by("target_path", F.struct("a", "b")).alias("target_path"))
    # Go: the last two folders make the key, the whole suffix decides
    folder = F.regexp_replace("target_path", "/[^/]*$", "")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    packages = known.where("target_path like '%.go'").groupBy(folder.alias("folder")).agg(F.min("target_path").alias("target_path")).withColumn("key", last(F.col("folder")))
    go = rows.where("language = 'go'").withColumn("key", last(s)).join(packages, "key").where(F.concat(F.lit("/"), F.col("folder")).endswith(F.concat(F.lit("/"), s)))
    near = go.groupBy("path", "source").agg(F.min_by("target_path", F.struct((-scoring.path_proximity(F.col("path"), F.col("target_path"))).alias("p"), "target_path")).alias("target_path"))
    return found.unionByName(near)


def export_index(nodes: DataFrame) -> DataFrame:
    """(file_path, name, id): the first exported symbol of each name in a file by line and id."""
    shown = nodes.where("is_exported and kind not in ('file', 'module', 'namespace')")
    return shown.groupBy("file_path", "name").agg(F.min_by("id", F.struct(F.coalesce("start_line", F.lit(0)), "id")).alias("id"))


def reexport_walk(passed: DataFrame, targets: DataFrame, max_depth: int = 8) -> DataFrame:
    """(file_path, name, origin_path, origin_name, depth): where a name asked of a file comes from, through at most max_depth re-exports.

    passed: reexports(); targets: resolve_imports() of their sources. A `*`
    stands for every name (name `*`). Cycles end because a pair that was seen
    at a smaller depth is not walked again.
    """
    step = materialise(passed.join(targets, ["path", "source"]).select(F.col("path").alias("file_path"), F.col("local_name").alias("name"), F.col("target_path").alias("origin_path"), F.col("exported_name").alias("origin_name")).distinct())
    out = step.withColumn("depth", F.lit(1))
    front = out
    for depth in range(2, max_depth + 1):
        nxt = step.select(F.col("file_path").alias("origin_path"), F.col("name").alias("asked"), F.col("origin_path").alias("p2"), F.col("origin_name").alias("n2"))
        met = front.join(nxt, "origin_path").where("origin_name = asked or asked = '*' or origin_name = '*'")
        name = F.when((F.col("name") == "*") & (F.col("asked") != "*"), F.col("asked")).otherwise(F.col("name"))
        origin = F.when(F.col("asked") == "*", F.when(F.col("origin_name") == "*", F.col("n2")).otherwise(F.col("origin_name"))).otherwise(F.col("n2"))
        far = met.select("file_path", name.alias("name"), F.col("p2").alias("origin_path"), origin.alias("origin_name")).distinct()
        front = materialise(far.join(out, ["file_path", "name", "origin_path", "origin_name"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.groupBy("file_path", "name", "origin_path", "origin_name").agg(F.min("depth").alias("depth"))


def resolve_via_imports(refs: DataFrame, mappings: DataFrame, targets: DataFrame, exports: DataFrame, walk: DataFrame | None = None) -> DataFrame:
    """(ref_id, target, confidence, rule): references whose name an import of their file brings in.

    `a` or `a.b` is looked up by its head; the imported file's exports hold
    the name (or, for a whole module, the tail): 0.9. Else, with a walk, the
    file passes it on: 0.85. The least id of several.
    """
    head, tail = F.regexp_extract("reference_name", r"^([\w$]+)", 1), F.regexp_extract("reference_name", r"([\w$]+)$", 1)
    asked = refs.select("ref_id", "file_path", head.alias("local_name"), tail.alias("tail"), F.col("reference_name"))
    brought = mappings.where("local_name <> ''").join(targets, ["path", "source"]).select(F.col("path").alias("file_path"), "local_name", "exported_name", "is_namespace", "is_default", "target_path")
    met = asked.join(brought, ["file_path", "local_name"]).withColumn("want", F.when(F.col("is_namespace") | F.col("is_default"), F.col("tail")).when(F.col("exported_name") == "*", F.col("tail")).otherwise(F.col("exported_name")))
    ex = exports.select(F.col("file_path").alias("target_path"), F.col("name").alias("want"), F.col("id").alias("target"))
    out = met.join(ex, ["target_path", "want"]).select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("rule"))
    if walk is not None:
        via = met.join(walk.select(F.col("file_path").alias("target_path"), "name", "origin_path", "origin_name"), "target_path").where("name = want or name = '*'")
        via = via.select("ref_id", F.col("origin_path").alias("target_path"), F.when(F.col("origin_name") == "*", F.col("want")).otherwise(F.col("origin_name")).alias("want"))
        out = out.unionByName(via.join(ex, ["target_path", "want"]).select("ref_id", "target", F.lit(0.85).alias("confidence"), F.lit("re-export").alias("rule")))
    best = out.groupBy("ref_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "target", "confidence", "rule")).alias("m"))
    return best.select("ref_id", "m.target", "m.confidence", "m.rule")


def workspace_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (…, source) with `target`: the package with the longest name that begins the source; its entry file for the bare name, else the rest under its folder.

    packages (name, folder, entry). A source is cut into its prefixes, so it
    meets a package by equality.
    """
    parts = F.split("source", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("name"), k.alias("k")))
    each = imports.select("source").distinct().select("source", F.explode(prefixes).alias("p")).select("source", "p.name", "p.k")
    met = each.join(packages, "name").groupBy("source").agg(F.max_by(F.struct("name", "folder", "entry"), "k").alias("m"))
    rest = F.substr("source", F.length("m.name") + 2)
    target = F.when(F.col("source") == F.col("m.name"), F.concat_ws("/", "m.folder", "m.entry")).otherwise(F.concat_ws("/", F.col("m.folder"), rest))
    return imports.join(met.select("source", target.alias("target")), "source", "left")


def include_dirs(build: DataFrame) -> DataFrame:
    """(path, folder): include folders named by the commands of build files (path, text), `-I`, `-isystem` and `/I`."""
    pattern = F.lit(r"(?:^|[\s\"',])(?:-I|-isystem\s+|/I)\s*([^\s\"',]+)")
    return build.select("path", F.explode(F.regexp_extract_all("text", pattern, 1)).alias("folder")).distinct()


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """(name, folder, entry) of package manifests (path, text) in JSON; the entry falls back to index.js, manifests without name are left out."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    read = lambda key: F.get_json_object("text", f"$.{key}")
    return manifests.select(read("name").alias("name"), folder.alias("folder"), F.coalesce(read("main"), read("module"), F.lit("index.js")).alias("entry")).where("name is not null")


def workspace_members(manifests: DataFrame) -> DataFrame:
    """(path, pattern): the folders that a root manifest lists as workspaces, in either form."""
    lists = F.coalesce(F.get_json_object("text", "$.workspaces.packages"), F.get_json_object("text", "$.workspaces"))
    return manifests.select("path", F.explode(F.from_json(lists, "array<string>")).alias("pattern"))


def path_aliases(configs: DataFrame) -> DataFrame:
    """(path, pattern, target, position) of the path aliases in compiler configurations (path, text); targets under the base folder."""
    base = F.coalesce(F.get_json_object("text", "$.compilerOptions.baseUrl"), F.lit("."))
    table = F.from_json(F.get_json_object("text", "$.compilerOptions.paths"), "map<string,array<string>>")
    rows = configs.select("path", base.alias("base"), F.explode(table).alias("pattern", "targets")).select("path", "base", "pattern", F.posexplode("targets").alias("position", "t"))
    return rows.select("path", "pattern", F.regexp_replace(F.concat_ws("/", "base", "t"), r"^\./", "").alias("target"), "position")


def go_module(configs: DataFrame) -> DataFrame:
    """(folder, module) of Go module files (path, text)."""
    return configs.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''")
