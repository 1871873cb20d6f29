"""Catalogue: lookups, bookkeeping, imports and member resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph, imports, lookups, methods, resolve, search
from codeloom.plans.base import E0, FILES, LIFT, N, R, W, edges, files, nodes, texts
from codeloom.plans.base import graph as load
from codeloom.runtime import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {N} select id, name, kind from n where id in (select id from node_deletions)")
def nodes_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return lookups.by_ids(nodes(spark, d), table(spark, d, "node_deletions")).select("id", "name", "kind")


@query(f"with {N}, a as (select min(id) i from n where kind = 'class') select id, name from n, a where id > i order by id limit 100")
def nodes_page(spark, d):
    n = nodes(spark, d)
    after = n.where("kind = 'class'").agg(F.min("id")).first()[0]
    return lookups.page_after(n, "id", after, 100).select("id", "name")


@query(f"with {N}, {E0} select kind, count(*) as \"left\" from e0 where source not in (select id from n where kind = 'class') and target not in (select id from n where kind = 'interface') group by 1")
def edges_after_deletes(spark, d):
    n = nodes(spark, d)
    rest = lookups.without_edges(lookups.without_edges(edges(spark, d), n.where("kind = 'class'"), "source"), n.where("kind = 'interface'"), "target")
    return rest.groupBy("kind").agg(F.count("*").alias("left"))


@query("select max(indexed_at) last, strftime(make_timestamp(max(indexed_at) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as at from files")
def last_indexed(spark, d):
    return table(spark, d, "files").agg(F.max("indexed_at").alias("last")).select("last", lookups.iso_time(F.col("last")).alias("at"))


@query(f"with {N} select 'name' what, count(distinct name) n from n union all select 'language', count(distinct language) from n union all select 'names in go files', count(distinct name) from n where language = 'go'")
def distinct_counts(spark, d):
    n = nodes(spark, d)
    one = lambda rows, c, what: rows.agg(F.countDistinct(c).alias("n")).select(F.lit(what).alias("what"), "n")
    return one(n, "name", "name").unionByName(one(n, "language", "language")).unionByName(one(n.where("language = 'go'"), "name", "names in go files"))


@query(f"with {N} select id, cast(to_json(decorators) as varchar) decorators, len(decorators) n from n where len(decorators) > 0")
def decorators_as_json(spark, d):
    rows = lookups.encoded(nodes(spark, d).where("size(decorators) > 0").select("id", "decorators"), ["decorators"])
    n = lookups.decoded(rows.withColumnRenamed("decorators", "back"), {"back": "array<string>"})
    return rows.join(n, "id").select("id", "decorators", F.size("back").alias("n"))


@query(f"with {N} select id, greatest(1, least(end_line - start_line, 50)) span, (coalesce(strlen(name), 0) + coalesce(strlen(signature), 0) + coalesce(strlen(docstring), 0))::int bytes from n where end_line >= start_line")
def clamped_spans(spark, d):
    return nodes(spark, d).where("end_line >= start_line").select("id", lookups.clamp(F.col("end_line") - F.col("start_line"), 1, 50).alias("span"), lookups.row_size("name", "signature", "docstring").cast("int").alias("bytes"))


@query(f"""with {N} select id, signature from n where signature = 'export class' or starts_with(signature, 'export class ') or starts_with(signature, 'async get')""")
def command_pattern(spark, d):
    s = F.col("signature")
    return nodes(spark, d).where(lookups.command_matches(s, F.lit("export class")) | lookups.command_matches(s, F.lit("async get*"))).select("id", "signature")


@query(f"with {FILES}, {N} select language, count(*) filter (kind = 'constant' and lower(language) in ('yaml', 'properties')) leaves, count(*) nodes from n where language is not null group by 1")
def config_leaves(spark, d):
    leaf = lookups.is_config_leaf(F.col("kind"), F.col("language"))
    return nodes(spark, d).where("language is not null").groupBy("language").agg(F.count_if(leaf).alias("leaves"), F.count("*").alias("nodes"))


_REF0 = "refs as (select e0.source from_node_id, n.file_path, n.language, e0.target reference_name, case when e0.target in (select id from n) then 'resolved' when e0.kind = 'calls' then 'failed' else 'pending' end status, e0.kind reference_kind from e0 join n on n.id = e0.source)"


def _refs(spark, d):
    n = nodes(spark, d)
    known = n.select(F.col("id").alias("target"), F.lit(1).alias("known"))
    e = edges(spark, d).join(n.select(F.col("id").alias("source"), "file_path", "language"), "source").join(known, "target", "left")
    status = F.when(F.col("known") == 1, "resolved").when(F.col("kind") == "calls", "failed").otherwise("pending")
    return e.select(F.col("source").alias("from_node_id"), "file_path", "language", F.col("target").alias("reference_name"), F.col("kind").alias("reference_kind"), status.alias("status")), n


@query(f"with {N}, {E0}, {_REF0} select reference_kind, count(*) pending from refs where status = 'pending' group by 1")
def pending_refs(spark, d):
    refs, _ = _refs(spark, d)
    return lookups.pending(refs).groupBy("reference_kind").agg(F.count("*").alias("pending"))


@query(f"""with {N}, {E0}, {_REF0}, top as (select reference_name from refs where status <> 'resolved' group by 1 having count(*) > 1), f as (select distinct file_path from refs where language = 'python')
  select file_path, count(*) refs from refs where reference_name in (from top) and file_path in (from f) group by 1""")
def refs_by_name_and_file(spark, d):
    refs, _ = _refs(spark, d)
    refs = materialise(refs)
    names = refs.where("status <> 'resolved'").groupBy("reference_name").count().where("count > 1")
    return lookups.refs_of(refs, names, refs.where("language = 'python'")).groupBy("file_path").agg(F.count("*").alias("refs"))


@query(f"with {N}, {E0}, {_REF0} select language, count(*) refs from refs where from_node_id not in (select id from n where kind = 'method') group by 1")
def refs_after_node_deletes(spark, d):
    refs, n = _refs(spark, d)
    return lookups.without_refs(refs, n.where("kind = 'method'")).groupBy("language").agg(F.count("*").alias("refs"))


@query(f"""{W}, refs as (select b.qualified_name reference_name, count(*) c from e join n b on b.id = target group by 1), m as (select distinct name from n where kind = 'method')
  select reference_name, c refs from refs where regexp_extract(reference_name, '([^.:/]+)$', 1) in (from m)""")
def known_name_refs(spark, d):
    n = nodes(spark, d)
    e = graph.attached(edges(spark, d), n)
    refs = e.join(n.select(F.col("id").alias("target"), F.col("qualified_name").alias("reference_name")), "target").groupBy("reference_name").agg(F.count("*").alias("refs"))
    return lookups.with_known_names(refs, n.where("kind = 'method'")).select("reference_name", "refs")


@query(f"""with {N} select file_path, count(*) definitions, string_agg(name, ', ' order by coalesce(start_line, 0), id) as names from n where kind in ('function', 'method', 'class', 'interface', 'struct') group by 1""")
def definitions_by_file(spark, d):
    return lookups.definitions_by_file(nodes(spark, d))


@query("select limit_name, capacity, overlap from size_limits where unit = 'tokens'")
def settings_map(spark, d):
    rows = table(spark, d, "size_limits").where("unit = 'tokens'")
    both = rows.select(F.concat("limit_name", F.lit("/c")).alias("key"), F.col("capacity").cast("string").alias("value")).unionByName(rows.select(F.concat("limit_name", F.lit("/o")).alias("key"), F.col("overlap").cast("string").alias("value")))
    m = lookups.metadata(both)
    return m.select(F.explode(F.filter(F.map_keys("metadata"), lambda k: k.endswith("/c"))).alias("k"), "metadata").select(
        F.split_part("k", F.lit("/"), F.lit(1)).alias("limit_name"), F.col("metadata")[F.col("k")].cast("int").alias("capacity"), F.col("metadata")[F.concat(F.split_part("k", F.lit("/"), F.lit(1)), F.lit("/o"))].cast("int").alias("overlap")
    )


@query(f"with {N} select kind, count(*) nodes from n where id not in (select id from node_deletions) group by 1")
def compacted_store(spark, d):
    return lookups.live(nodes(spark, d), table(spark, d, "node_deletions"), "id").groupBy("kind").agg(F.count("*").alias("nodes"))


@query(f"with {N}, x as (select id, id in (select id from node_deletions) gone from n) select count(*) entries, count(*) filter (gone) deleted, round(count(*) filter (gone) / count(*), 6) dead_share from x")
def store_stats(spark, d):
    return lookups.store_stats(nodes(spark, d).select("id"), table(spark, d, "node_deletions"), "id")


_STEP = "walk(id, depth) as (select id, 0 from n where kind = 'struct' union select s.there, w.depth + 1 from walk w join (select distinct source here, target there from e) s on s.here = w.id and w.depth < 2)"


@query(f"{R}, {_STEP}, m as (select id, min(depth) depth from walk group by id) select id, name, file_path, case when depth = 0 then 0.9 else 0.5 end::double score from m join n using (id)")
def graph_search_results(spark, d):
    n, e = load(spark, d, "kind", "name", "file_path")
    return lookups.subgraph_results(graph.levels(n.where("kind = 'struct'").select("id"), graph.links(e, "out"), 2), n)


@query(f"""{R}, {_STEP.replace('depth < 2', 'depth < 3')}, m as (select id, min(depth) depth from walk group by id),
  c as (select e.target, case e.kind when 'contains' then 0 when 'calls' then 1 else 2 end r, e.source, e.kind from e join m a on a.id = e.target join m b on b.id = e.source where a.depth = b.depth + 1)
  select target, source, kind from (select *, row_number() over (partition by target order by r, source, kind) k from c) where k = 1""")
def dfs_tree(spark, d):
    n, e = load(spark, d, "kind")
    reached = materialise(graph.levels(n.where("kind = 'struct'").select("id"), graph.links(e, "out"), 3))
    return graph.tree_edges(reached, e)


@query(f"""{R}, s as (select id from n where kind = 'interface'),
  up(id, depth) as (select id, 0 from s union select x.there, w.depth + 1 from up w join (select distinct target here, source there from e where kind in ('calls', 'references', 'imports', 'instantiates')) x on x.here = w.id and w.depth < 2),
  down(id, depth) as (select id, 0 from s union select x.there, w.depth + 1 from down w join (select distinct source here, target there from e where kind in ('calls', 'references', 'imports', 'instantiates')) x on x.here = w.id and w.depth < 2)
  select 'caller' side, depth, name, count(*) n from (select id, min(depth)::int as depth from up group by id) join n using (id) where depth > 0 group by 2, 3
  union all select 'callee', depth, name, count(*) from (select id, min(depth)::int as depth from down group by id) join n using (id) where depth > 0 group by 2, 3""")
def impact_tool(spark, d):
    n, e = load(spark, d, "kind", "name")
    return graph.call_graph(n.where("kind = 'interface'").select("id"), e, 2).join(n.select("id", "name"), "id").groupBy("side", "depth", "name").agg(F.count("*").alias("n"))


_MSG = "m as (select repo, doc_id, source from documents where source <> 'file' and repo is not null)"


def _messages(spark, d):
    return table(spark, d, "documents").where("source <> 'file' and repo is not null").select("repo", "doc_id", "source", "text")


@query(f"with {_MSG} select repo, doc_id from (select *, row_number() over (partition by repo, source = 'readme' order by doc_id desc) r from m) where source = 'readme' or r <= 4")
def pinned_memory(spark, d):
    return lookups.short_term(_messages(spark, d), "repo", "doc_id", F.col("source") == "readme", 4).select("repo", "doc_id")


@query("""with m as (select repo, sum(ceil(length(text) * 0.25))::bigint tokens from documents where source <> 'file' and repo is not null group by 1) select repo, tokens, tokens > 4096 * 0.8 as compact from m""")
def conversation_totals(spark, d):
    return lookups.token_total(_messages(spark, d).withColumn("text", F.coalesce("text", F.lit(""))), "repo", "text", 4096)


@query("""with o as (select path, content_hash h, min(indexed_at) t from files group by 1, 2), a as (select path, arg_min(h, (t, h)) h from o group by 1), b as (select path, arg_max(h, (t, h)) h from o where path not like '%3%' group by 1), a2 as (from a where path not like '%5%')
  select path, case when a2.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change from a2 full join b using (path) where a2.h is distinct from b.h""".replace("a2.path is null", "a2.h is null").replace("b.path is null", "b.h is null"))
def snapshot_diff(spark, d):
    o = table(spark, d, "files").groupBy("path", F.col("content_hash").alias("h")).agg(F.min("indexed_at").alias("t"))
    a = o.where("path not like '%5%'").groupBy("path").agg(F.min_by("h", F.struct("t", "h")).alias("h"))
    b = o.where("path not like '%3%'").groupBy("path").agg(F.max_by("h", F.struct("t", "h")).alias("h"))
    return lookups.snapshot_diff(a, b, "path", "h")


_SKILLS = [("graph", 3, ["node", "edge"]), ("cache", 5, ["cache", "stale"]), ("search", 2, ["index", "search"]), ("io", 2, ["file", "folder"]), ("merge", 1, ["merge"]), ("log", 4, ["log", "journal"]), ("token", 0, ["token"])]


@query("""with s(skill, priority, t) as (values ('graph', 3, 'node'), ('graph', 3, 'edge'), ('cache', 5, 'cache'), ('cache', 5, 'stale'), ('search', 2, 'index'), ('search', 2, 'search'), ('io', 2, 'file'), ('io', 2, 'folder'), ('merge', 1, 'merge'), ('log', 4, 'log'), ('log', 4, 'journal'), ('token', 0, 'token')),
  h as (select distinct doc_id, skill, priority from documents, s where source <> 'file' and repo is not null and contains(lower(text), t))
  select doc_id, skill, priority from (select *, row_number() over (partition by doc_id order by priority desc, skill) r from h) where r <= 5""")
def triggered_skills(spark, d):
    skills = spark.createDataFrame(_SKILLS, "skill string, priority int, triggers array<string>")
    return lookups.triggered(_messages(spark, d), "doc_id", "text", skills, 5)


@query("""with s as (select repo plan, run_id step, case when status = 'ok' then 'done' else 'pending' end status, lag(run_id) over (partition by repo order by run_id) need from index_runs)
  select s.plan, s.step from s left join s p on p.plan = s.plan and p.step = s.need where s.status = 'pending' and (s.need is null or p.status = 'done')""")
def ready_steps(spark, d):
    from pyspark.sql import Window

    runs = table(spark, d, "index_runs")
    need = F.lag("run_id").over(Window.partitionBy("repo").orderBy("run_id"))
    steps = runs.select(F.col("repo").alias("plan"), F.col("run_id").alias("step"), F.when(F.col("status") == "ok", "done").otherwise("pending").alias("status"), F.array_compact(F.array(need)).alias("needs"))
    return lookups.ready_steps(steps)


@query("""with e as (select regexp_replace(regexp_replace(trim(path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') path, max(ts) l from tree_scan group by 1), s as (select min(ts) + interval '1 second' * floor(epoch(max(ts) - min(ts)) / 2) m from tree_scan)
  select path from e, s where l > m""")
def pending_after_sync(spark, d):
    from codeloom.operators.changed import clean_path

    e = table(spark, d, "tree_scan").select(clean_path("path").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return lookups.evicted(e, F.timestamp_micros(F.lit(lo + (hi - lo) // 2_000_000 * 1_000_000))).select("path")


@query("""with s as (select distinct regexp_replace(regexp_replace(trim(path), '[\\\\/]+', '/', 'g'), '^(\\./)+', '') path from tree_scan), t as (select distinct path from files)
  select path from t union select path from s where not regexp_matches(path, '(^|/)(pkg|vendor)/') and path not in (from t)""")
def visible_files(spark, d):
    from codeloom.operators.changed import clean_path
    from codeloom.sources import scan

    found = table(spark, d, "tree_scan").select(clean_path("path").alias("path")).distinct()
    tracked = table(spark, d, "files").select("path").distinct()
    return lookups.visible_files(tracked, found.join(tracked, "path", "left_anti"), scan.is_ignored(F.col("path"), scan.ignore_rules("pkg/\nvendor/\n")))


@query(f"""with tok as (select id, file_path, unnest(list_filter(string_split_regex(lower(name), '[^a-z0-9_]+'), lambda x: x <> '')) term from (select distinct id, name, file_path from nodes)),
  {N}, fresh as (select id, file_path, unnest(list_filter(string_split_regex(lower(name), '[^a-z0-9_]+'), lambda x: x <> '')) term from n), f as (select distinct file_path from n where language = 'go')
  select term, count(*) postings from (select distinct * from tok where file_path not in (from f) union all select distinct * from fresh where file_path in (from f)) group by 1""")
def reindexed_postings(spark, d):
    from codeloom.functions.text import fts_tokens

    cut = lambda rows: rows.select("id", "file_path", F.explode(fts_tokens(F.col("name"))).alias("term")).distinct()
    n = nodes(spark, d)
    return lookups.reindexed_postings(cut(table(spark, d, "nodes")), cut(n), n.where("language = 'go'")).groupBy("term").agg(F.count("*").alias("postings"))


# imports: each `imports` edge between files is written as the relative import it stands for

_IMPORTED = f"""{W}, pair as (select distinct a.file_path path, b.file_path target from e join n a on a.id = source join n b on b.id = target where e.kind = 'imports' and a.file_path <> b.file_path
    and regexp_matches(a.file_path, '\\.(ts|js)$') and regexp_matches(b.file_path, '\\.(ts|js)$')),
  m as (select path, './' || repeat('../', len(string_split(path, '/')) - 1) || regexp_replace(target, '\\.\\w+$', '') source, regexp_replace(target, '\\.\\w+$', '') stem from pair)"""


def _imported(spark, d):
    n = nodes(spark, d)
    a, b = n.select(F.col("id").alias("source"), F.col("file_path").alias("path")), n.select(F.col("id").alias("target"), F.col("file_path").alias("to"))
    script = r"\.(ts|js)$"
    p = graph.attached(edges(spark, d).where("kind = 'imports'"), n).join(a, "source").join(b, "target").where(F.col("path").rlike(script) & F.col("to").rlike(script) & (F.col("path") != F.col("to"))).select("path", "to").distinct()
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    return p.select("path", "to", F.concat(F.lit("./"), up, F.regexp_replace("to", r"\.\w+$", "")).alias("source"))


@query(f"""{_IMPORTED}, f as (select distinct path from files), probe(lang, ext, k) as (values ('ts', '', 0), ('ts', '.ts', 1), ('ts', '.tsx', 2), ('ts', '.d.ts', 3), ('ts', '.js', 4), ('js', '', 0), ('js', '.js', 1), ('js', '.jsx', 2), ('js', '.mjs', 3), ('js', '.cjs', 4), ('js', '.ts', 5)),
  hit as (select m.path, source, stem || ext target_path, k from m join probe on lang = regexp_extract(m.path, '\\.(\\w+)$', 1) join f on f.path = stem || ext)
  select path, source, arg_min(target_path, k) target_path from hit group by 1, 2""")
def import_targets(spark, d):
    return imports.resolve_imports(_imported(spark, d), files(spark, d))


@query("""with t as (select path, regexp_extract(path, '\\.(\\w+)$', 1) x, text from documents where source = 'file' and path is not null and text is not null),
  es as (select path, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+\\{([^}]*)\\}\\s*from\\s*[''"]([^''"]+)[''"]', 1)) names, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+\\{([^}]*)\\}\\s*from\\s*[''"]([^''"]+)[''"]', 2)) source from t where x in ('ts', 'js')),
  cjs as (select path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:const|let|var)\\s+([\\w$]+)\\s*=\\s*require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)) local_name, unnest(regexp_extract_all(text, '(?m)^\\s*(?:const|let|var)\\s+([\\w$]+)\\s*=\\s*require\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 2)) source from t where x in ('ts', 'js')),
  py as (select path, unnest(regexp_extract_all(text, '(?m)^\\s*from\\s+([\\w.]+)\\s+import\\s+([\\w, ]+)$', 1)) source, unnest(regexp_extract_all(text, '(?m)^\\s*from\\s+([\\w.]+)\\s+import\\s+([\\w, ]+)$', 2)) names from t where x = 'py'),
  jv as (select path, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+([\\w.]+)\\.(\\w+)\\s*;\\s*$', 1)) source, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+([\\w.]+)\\.(\\w+)\\s*;\\s*$', 2)) local_name from t where x = 'java'),
  go as (select path, unnest(regexp_extract_all(text, '(?m)^(?:import\\s+|\\s+)"([\\w./-]+)"\\s*$', 1)) source from t where x = 'go')
  select distinct path, local_name, exported_name, source, is_default, is_namespace from (
    select path, trim(unnest(string_split(names, ','))) local_name, local_name exported_name, source, false is_default, false is_namespace from es
    union all select path, local_name, 'default', source, true, false from cjs
    union all select path, trim(unnest(string_split(names, ','))), trim(unnest(string_split(names, ','))), source, false, false from py
    union all select path, local_name, local_name, source, false, false from jv
    union all select path, regexp_extract(source, '([^/]*)$', 1), '*', source, false, true from go)""")
def import_mappings(spark, d):
    return imports.import_mappings(texts(spark, d))


@query(f"with {N} select file_path, name, arg_min(id, (coalesce(start_line, 0), id)) id from n where is_exported and kind not in ('file', 'module', 'namespace') group by 1, 2")
def export_index(spark, d):
    return imports.export_index(nodes(spark, d))


# member references: calls of methods are written as Owner.method, functions named as values by their name

_OWNER = "regexp_extract({q}, '([^.:]+)(?:\\.|::)[^.:]+$', 1)"
_METHOD_REFS = f"""{W}, refs as (select sha256(concat_ws(':', source, target, e.kind, e.line, e.col)) ref_id, source from_node_id, {_OWNER.format(q='b.qualified_name')} || '.' || b.name reference_name, {_OWNER.format(q='b.qualified_name')} receiver, b.name as method, a.file_path, a.language
  from e join n a on a.id = source join n b on b.id = target where e.kind = 'calls' and b.kind = 'method' and {_OWNER.format(q='b.qualified_name')} <> '')"""


def _method_refs(spark, d):
    n = nodes(spark, d)
    b = n.where("kind = 'method'").select(F.col("id").alias("target"), methods.owner_of(F.col("qualified_name")).alias("owner"), F.col("name").alias("method"))
    e = edges(spark, d).where("kind = 'calls'").join(n.select(F.col("id").alias("source"), "file_path", "language"), "source").join(b, "target").where("owner <> ''")
    ref = F.sha2(F.concat_ws(":", "source", "target", "kind", "line", "col"), 256).alias("ref_id")
    return materialise(e.select(ref, F.col("source").alias("from_node_id"), F.concat("owner", F.lit("."), "method").alias("reference_name"), F.col("owner").alias("type"), "method", "file_path", "language")), n


@query(f"""{_METHOD_REFS}, m as (select id target, {_OWNER.format(q='qualified_name')} own, name as method, language, file_path f from n where kind = 'method')
  select ref_id, arg_min(m.target, (m.f <> refs.file_path, m.target)) target from refs join m on m.own = refs.receiver and m.method = refs.method and m.language = refs.language group by 1""")
def methods_on_types(spark, d):
    refs, n = _method_refs(spark, d)
    return methods.methods_on_types(refs, n).select("ref_id", "target")


@query(f"""{_METHOD_REFS}, ty as (select distinct name t, language, file_path f from n where kind in ('class', 'struct', 'interface')), m as (select id target, name as method, language, file_path f, qualified_name q from n where kind = 'method'),
  a as (select ref_id, 0 k, m.target, m.f <> refs.file_path away from refs join ty on ty.t = receiver and ty.language = refs.language join m on m.f = ty.f and m.method = refs.method and m.language = refs.language where contains(m.q, ty.t)),
  c as (select name as method, count(*) c from n group by 1),
  pool as (select ref_id, m.target, m.language = refs.language same, max(m.language = refs.language) over (partition by ref_id) has_own from refs join m on m.method = refs.method join c on c.method = refs.method where c.c <= 500),
  b as (select ref_id, min(target) target from pool where same = has_own or not has_own group by 1 having count(*) = 1 and bool_and(coalesce(same, false)))
  select ref_id, coalesce(x.target, b.target) target, case when x.target is null then 0.7 else 0.85 end::double confidence from (select ref_id, arg_min(target, (away, target)) target from a group by 1) x full join b using (ref_id)""")
def resolve_method_calls(spark, d):
    refs, n = _method_refs(spark, d)
    return methods.resolve_method_calls(refs, n).where("confidence in (0.85, 0.7)").select("ref_id", "target", "confidence")


@query(f"""{W}, refs as (select sha256(concat_ws(':', source, target, e.kind, e.line, e.col)) ref_id, source from_node_id, b.name reference_name, a.file_path, a.language from e join n a on a.id = source join n b on b.id = target where e.kind = 'references'),
  fam(l, f) as (values ('typescript', 'web'), ('javascript', 'web'), ('tsx', 'web'), ('jsx', 'web'), ('java', 'jvm')),
  c as (select ref_id, n.id target, n.file_path = refs.file_path here, coalesce(n.start_line, 0) as line from refs join n on n.name = refs.reference_name and n.kind in ('function', 'method') and n.id <> from_node_id
      and coalesce((select f from fam where l = n.language), n.language) = coalesce((select f from fam where l = refs.language), refs.language)
    where n.kind = 'function' or refs.language not in ('typescript', 'javascript', 'tsx', 'jsx', 'python', 'cpp', 'php', 'arkts')),
  g as (select ref_id, count(*) n, count(*) filter (here) h, arg_min(target, (line, target)) filter (here) inside, min(target) one from c group by 1)
  select ref_id, case when h > 0 then inside else one end target, case when h = 1 then 0.95 when h > 1 then 0.9 else 0.8 end::double confidence from g where h > 0 or n = 1""")
def function_refs(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where("kind = 'references'").join(n.select(F.col("id").alias("source"), "file_path", "language"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("reference_name")), "target")
    refs = e.select(F.sha2(F.concat_ws(":", "source", "target", "kind", "line", "col"), 256).alias("ref_id"), F.col("source").alias("from_node_id"), "reference_name", F.lit("function_ref").alias("reference_kind"), "file_path", "language")
    return methods.resolve_function_refs(refs, n).select("ref_id", "target", "confidence")


@query(f"""{R}, {LIFT}, t as (select id, name, language from n where kind in ('class', 'struct', 'interface', 'trait', 'protocol')),
  up as (select distinct a.name, a.language, b.name super from lift join t a on a.id = source join t b on b.id = target where a.name <> b.name),
  walk(name, language, super, distance) as (select *, 1 from up union select w.name, w.language, up.super, w.distance + 1 from walk w join up on up.name = w.super and up.language is not distinct from w.language and w.distance < 4 and w.language is not null)
  select name, language, super, min(distance)::int as distance from walk where name <> super group by 1, 2, 3""")
def supertypes(spark, d):
    n, e = load(spark, d, "kind", "name", "language")
    return methods.supertypes(n, resolve.type_links(n, e))


@query(f"""with {N}, r as (select id callable, name, language, {_OWNER.format(q='qualified_name')} as "owner", regexp_extract(signature, '(?:->|\\)\\s*:)\\s*([^{{=;]+?)\\s*[:{{]?\\s*$', 1) d from n where kind in ('function', 'method')),
  i as (select *, regexp_extract(d, '(?:Promise|Awaitable|Optional|Future|Task)\\s*[<\\[]\\s*([^>\\]]+)', 1) inner_ from r)
  select callable, name, "owner", language, regexp_extract(case when inner_ <> '' then inner_ else d end, '([A-Za-z_]\\w*)\\s*(?:\\[\\])?[?!]?$', 1) as type from i where regexp_extract(case when inner_ <> '' then inner_ else d end, '([A-Za-z_]\\w*)\\s*(?:\\[\\])?[?!]?$', 1) <> ''""")
def return_types(spark, d):
    return methods.return_types(nodes(spark, d).withColumn("return_type", F.lit(None).cast("string")))


@query(f"""{R}, up as (select target id, min(source) up from e where kind = 'contains' group by 1),
  walk(id, pos, k) as (select id, up, 1 from up union all select w.id, up.up, k + 1 from walk w join up on up.id = w.pos join n on n.id = w.pos where n.kind not in ('function', 'method') and k < 64)
  select walk.id, walk.pos container from walk join n on n.id = walk.pos where n.kind in ('function', 'method')""")
def enclosing_callables(spark, d):
    n, e = load(spark, d, "kind")
    return methods.enclosing_callables(n, e)


@query(f"""{R}, up as (select target id, min(source) up from e where kind = 'contains' group by 1),
  walk(id, pos, k) as (select id, up, 1 from up union all select w.id, up.up, k + 1 from walk w join up on up.id = w.pos join n on n.id = w.pos where n.kind not in ('function', 'method') and k < 64),
  box as (select walk.id, walk.pos box from walk join n on n.id = walk.pos where n.kind in ('function', 'method')),
  inn(id, pos) as (select distinct source, source from e where kind = 'calls' union select i.id, box.box from inn i join box on box.id = i.pos),
  p as (select distinct source, target from e where kind = 'calls')
  select source, target from p left join (select box.id, box.box from box join n using (id) where n.kind = 'function') b on b.id = p.target where b.id is null or exists (select 1 from inn where inn.id = p.source and inn.pos = b.box)""")
def reachable_calls(spark, d):
    n, e = load(spark, d, "kind")
    return methods.lexically_reachable(e.where("kind = 'calls'").select("source", "target").distinct(), n, e).select("source", "target")


@query()
def search_tool(spark, d):
    return search.search_tool(nodes(spark, d), "snapshot cache", "keyword", 20)
