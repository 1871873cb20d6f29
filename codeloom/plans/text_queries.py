"""Catalogue: files, languages, lines, chunks, windows over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scoring, text
from codeloom.functions.constants import GENERATED_FILE, LOW_VALUE_PATH
from codeloom.operators import aggregates, imports
from codeloom.plans.base import FILES, TEXTS, N, files, nodes, texts
from codeloom.runtime import materialise, table
from codeloom.sources import extract, scan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {FILES} select path, case regexp_extract(path, '\\.([^./]+)$', 1) when 'ts' then 'typescript' when 'js' then 'javascript' when 'py' then 'python' when 'go' then 'go' when 'java' then 'java' when 'json' then 'json' else 'unknown' end as language,
  regexp_matches(lower(path), '{LOW_VALUE_PATH}') or regexp_matches(path, '{GENERATED_FILE}') low_value, regexp_matches(path, '{GENERATED_FILE}') as generated from f""")
def file_classes(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", scan.detect_language(p).alias("language"), scoring.is_low_value(p).alias("low_value"), scoring.is_generated(p).alias("generated"))


@query(f"with {FILES} select path from f where regexp_matches(path, '^(?:.*/)?(?:pkg|lib)/[^/]*\\.go$') and not regexp_matches(path, '(^|/)vendor/')")
def glob_files(spark, d):
    f = files(spark, d)
    ignored = scan.is_ignored(F.col("path"), scan.ignore_rules("# third party\nvendor/\n"))
    return f.where(F.col("path").rlike(scan.glob_regex("**/{pkg,lib}/*.go")) & ~ignored).select("path")


@query(f"with {TEXTS}, l as (select path, unnest(string_split(text, chr(10))) content, generate_subscripts(string_split(text, chr(10)), 1) line from t) select path, line, left(content, 200) as content from l where regexp_matches(content, 'TODO|FIXME')")
def grep_lines(spark, d):
    return aggregates.grep(texts(spark, d), "path", "TODO|FIXME")


@query(f"""with {TEXTS}, l as (select path, string_split(text, chr(10)) a from t), c as (select path, a, unnest(range(0, case when len(a) <= 81 then 1 else ceil((len(a) - 5) / 76)::int end)) k from l)
  select path, k::int as chunk, (k * 76 + 1)::int start_line, least(k * 76 + 81, len(a))::int end_line, md5(array_to_string(a[k * 76 + 1:k * 76 + 81], chr(10))) digest from c""")
def line_chunks(spark, d):
    return aggregates.line_chunks(texts(spark, d), "path").select("path", "chunk", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"with {N} select id, coalesce(signature, name) as content, kind node_kind, name symbol_name from n where kind not in ('file', 'import', 'export', 'parameter', 'module', 'namespace')")
def node_chunks(spark, d):
    return aggregates.node_chunks(nodes(spark, d))


@query(f"""with {TEXTS}, l as (select path, unnest(string_split(text, chr(10))[3:22]) content, generate_subscripts(string_split(text, chr(10))[3:22], 1) k from t),
  s as (select path, k, content, sum(strlen(content) + 1) over (partition by path order by k) b from l) select path, (k + 2)::int as line, content from s where b <= 600""")
def read_lines(spark, d):
    return aggregates.read_lines(texts(spark, d), "path", 3, 20, 600)


_MSG = "m as (select repo, doc_id, ceil(n_chars * 0.25)::bigint cost from documents where source <> 'file' and repo is not null)"


def _messages(spark, d):
    return table(spark, d, "documents").where("source <> 'file' and repo is not null").select("repo", "doc_id", "source", F.ceil(F.col("n_chars") * 0.25).alias("cost"))


@query(f"with {_MSG}, r as (select *, sum(cost) over (partition by repo order by doc_id desc) running from m) select repo, doc_id, running::bigint as running from r where running <= 2000")
def token_budget_recent(spark, d):
    return aggregates.running_budget(_messages(spark, d), "repo", "doc_id", F.col("cost"), 2000).select("repo", "doc_id", "running")


@query("""with m as (select repo, doc_id, source, sum(ceil(n_chars * 0.25)) over (partition by repo order by doc_id desc) running from documents where source <> 'file' and repo is not null)
  select repo, min(doc_id) split from m where running <= 2000 and source = 'issue' group by 1""")
def compaction_split(spark, d):
    return aggregates.split_point(_messages(spark, d), "repo", "doc_id", F.col("cost"), 2000, F.col("source") == "issue")


@query("""with m as (select repo, doc_id, source, row_number() over (partition by repo order by doc_id desc) r from documents where source <> 'file' and repo is not null)
  select repo, doc_id, case when r > 6 and source = 'chat' then '[pruned]' else source end as body from m""")
def prune_old(spark, d):
    rows = _messages(spark, d).withColumn("body", F.col("source"))
    return aggregates.pruned(rows, "repo", "doc_id", "body", F.col("source") == "chat").select("repo", "doc_id", "body")


@query(f"""with {TEXTS}, a as (select path, unnest(regexp_extract_all(text, 'from\\s+[''"]([^''"]+)[''"]', 1)) source from t where path like '%.ts') select path, source, count(*) times from a group by all""")
def import_sources(spark, d):
    t = texts(spark, d).where("language = 'typescript'")
    rows = t.select("path", F.explode(F.regexp_extract_all("text", F.lit("from\\s+['\"]([^'\"]+)['\"]"), 1)).alias("source"))
    return rows.groupBy("path", "source").agg(F.count("*").alias("times"))


@query()
def resolved_imports(spark, d):
    maps = materialise(imports.import_mappings(texts(spark, d)))
    return imports.resolve_imports(maps, files(spark, d))


@query()
def extracted_rows(spark, d):
    rows = extract.extract(texts(spark, d))
    return rows.groupBy("language", "tag", "kind").agg(F.count("*").alias("rows"))


@query()
def code_chunks(spark, d):
    return extract.code_chunks(texts(spark, d)).select("id", "symbol_name", "node_kind", "start_line", "end_line")


@query(f"""with {TEXTS}, e as (select path, regexp_replace(text, '\\b(\\w+)\\.(\\w+)\\(', 'app.get(''/\\2'', \\1', 'g') x from t where regexp_matches(path, '\\.(js|ts)$')),
  m as (select path, unnest(regexp_extract_all(x, '\\b(?:app|router)\\.(get|post|put|patch|delete|all|use)\\(\\s*[''"`]([^''"`]+)[''"`]\\s*,\\s*(?:[\\w.]+\\s*,\\s*)*([\\w.]+)', 1)) "method", unnest(regexp_extract_all(x, '\\b(?:app|router)\\.(get|post|put|patch|delete|all|use)\\(\\s*[''"`]([^''"`]+)[''"`]\\s*,\\s*(?:[\\w.]+\\s*,\\s*)*([\\w.]+)', 2)) route, unnest(regexp_extract_all(x, '\\b(?:app|router)\\.(get|post|put|patch|delete|all|use)\\(\\s*[''"`]([^''"`]+)[''"`]\\s*,\\s*(?:[\\w.]+\\s*,\\s*)*([\\w.]+)', 3)) as handler from e)
  select 'express' framework, path, "method", route, handler, count(*) times from m group by all""")
def framework_routes(spark, d):
    """Calls of the script texts written as routes, as they have none."""
    t = texts(spark, d).where(F.col("path").rlike(r"\.(js|ts)$")).withColumn("text", F.regexp_replace("text", r"\b(\w+)\.(\w+)\(", "app.get('/$2', $1"))
    return extract.framework_routes(t).where("framework = 'express'").groupBy("framework", "path", "method", "route", "handler").agg(F.count("*").alias("times"))


@query()
def comment_free(spark, d):
    t = texts(spark, d)
    return t.select("path", F.md5(text.without_comments("text", "language")).alias("digest"))


@query("""select doc_id, least(coalesce(ceil(length(text) * 0.25), 0), 27000)::bigint tokens, left(text, 40) as head from documents where text is not null""")
def token_estimates(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.least(text.token_estimate("text"), F.lit(27000)).cast("bigint").alias("tokens"), F.left("text", F.lit(40)).alias("head"))


@query()
def prose_terms(spark, d):
    t = table(spark, d, "documents").where("source <> 'file' and text is not null")
    return t.select("doc_id", F.array_join(text.prose_candidates("text"), " ").alias("terms"), F.array_join(text.query_symbols("text"), " ").alias("symbols"))


@query("""with p as (select doc_id, '<html><head><title> Doc ' || doc_id || ' </title><script>var a = 1 < 2;</script></head><body><p>' || replace(replace(text, '<', ' '), '&', ' ') || '</p></body></html>' html from documents where text is not null)
  select doc_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)) title from p""")
def html_title(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    html = F.concat(F.lit("<html><head><title> Doc "), F.col("doc_id").cast("string"), F.lit(" </title><script>var a = 1 < 2;</script></head><body><p>"), F.translate("text", "<&", "  "), F.lit("</p></body></html>"))
    return t.select("doc_id", text.html_title(html).alias("title"))


@query()
def html_to_text(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    html = F.concat(F.lit("<h1>Title</h1><p>"), F.translate("text", "<&", "  "), F.lit("</p><style>p {}</style>&lt;end&gt;"))
    return t.select("doc_id", text.html_to_text(html).alias("content"))
