"""Point lookups, pages, deletes, bookkeeping of references, memory and plans: small relational operators of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions.text import token_estimate


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among the ids, each once however often it is asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows behind a key, in its order; `after` None begins. A page costs a top-k, not an offset."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def without_edges(edges: DataFrame, ends: DataFrame, side: str) -> DataFrame:
    """Edges left after those with an end among the ids are deleted; side: source or target."""
    return edges.join(ends.select(F.col("id").alias(side)).distinct(), side, "left_anti")


def iso_time(ms: Column) -> Column:
    """Epoch milliseconds as ISO text in UTC with milliseconds."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text; nulls stay null."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def decoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON text as nested columns; text that is not JSON gives null."""
    return rows.withColumns({c: F.from_json(c, k) for c, k in kinds.items()})


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def row_size(*columns: str) -> Column:
    """Bytes of the text columns of a row; null counts nothing."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))


def command_matches(command: Column, pattern: Column) -> Column:
    """A command pattern: exact, or the beginning up to a word boundary; a trailing `*` takes any rest."""
    p = F.btrim(pattern)
    star = p.endswith("*")
    head = F.btrim(F.regexp_replace(p, r"\*$", ""))
    return F.when(star, command.startswith(head)).otherwise((command == p) | command.startswith(F.concat(p, F.lit(" "))))


def is_config_leaf(kind: Column, language: Column) -> Column:
    return F.coalesce((kind == "constant") & F.lower(language).isin("yaml", "properties"), F.lit(False))


def pending(refs: DataFrame) -> DataFrame:
    """References still to be resolved."""
    return refs.where("coalesce(status, 'pending') = 'pending'")


def refs_of(refs: DataFrame, names: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """References by their name or by their file."""
    if names is not None:
        refs = refs.join(names.select("reference_name").distinct(), "reference_name", "left_semi")
    return refs if files is None else refs.join(files.select("file_path").distinct(), "file_path", "left_semi")


def without_refs(refs: DataFrame, from_nodes: DataFrame) -> DataFrame:
    """References left after those made by the nodes are deleted."""
    return refs.join(from_nodes.select(F.col("id").alias("from_node_id")).distinct(), "from_node_id", "left_anti")


def with_known_names(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose name, or its last segment, some node has: the others need not be tried."""
    names = nodes.select(F.col("name").alias("_name")).distinct()
    asked = refs.withColumn("_name", F.regexp_extract("reference_name", r"([^.:/]+)$", 1))
    return asked.join(names, "_name", "left_semi").drop("_name")


def definitions_by_file(nodes: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class", "interface", "struct")) -> DataFrame:
    """(file_path, definitions, names): definitions of each file, names joined in order of lines."""
    d = nodes.where(F.col("kind").isin(*kinds))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "id", "name")))
    return d.groupBy("file_path").agg(F.count("*").alias("definitions"), F.array_join(F.transform(listed, lambda x: x["name"]), ", ").alias("names"))


def metadata(rows: DataFrame) -> DataFrame:
    """One row with all (key, value) rows as a map, for tables of settings."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("metadata"))


def live(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """What a compaction keeps: rows without a tombstone."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def store_stats(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """(entries, deleted, dead_share) of a store that marks deletions."""
    gone = tombstones.select(key).distinct().withColumn("_gone", F.lit(1))
    return rows.join(gone, key, "left").agg(F.count("*").alias("entries"), F.count("_gone").alias("deleted"), F.round(F.count("_gone") / F.greatest(F.count("*"), F.lit(1)), 6).alias("dead_share"))


def subgraph_results(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, file_path, score) of a walk as search results: roots 0.9, others 0.5."""
    return reached.join(nodes.select("id", "name", "file_path"), "id").select("id", "name", "file_path", F.when(F.col("depth") == 0, 0.9).otherwise(0.5).alias("score"))


def short_term(messages: DataFrame, conversation: str, order: str, pinned: Column, size: int) -> DataFrame:
    """The pinned messages and the last `size` of the others of each conversation."""
    w = Window.partitionBy(conversation, pinned).orderBy(F.desc(order))
    return messages.withColumn("_r", F.row_number().over(w)).where(pinned | (F.col("_r") <= size)).drop("_r")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) between two revisions of a keyed context: added, removed or changed."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in")), after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_out"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_in").isNull(), "added").when(F.col("_out").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def triggered(texts: DataFrame, key: str, text: str, skills: DataFrame, top: int = 5) -> DataFrame:
    """(key, skill, priority): the first skills by priority with a trigger word in the text; skills (skill, priority, triggers) are a table of settings."""
    rules = skills.select("skill", "priority", F.explode("triggers").alias("t"))
    one = F.collect_list(F.struct("skill", "priority", F.lower("t").alias("t")))
    met = texts.select(key, F.lower(text).alias("_t")).crossJoin(F.broadcast(rules.agg(one.alias("_s"))))  # one row
    hits = F.array_distinct(F.transform(F.filter("_s", lambda s: F.contains(F.col("_t"), s["t"])), lambda s: F.struct((-s["priority"]).alias("p"), s["skill"].alias("skill"))))
    first = F.slice(F.array_sort(hits), 1, top)
    return met.select(key, F.explode(first).alias("h")).select(key, "h.skill", (-F.col("h.p")).alias("priority"))


def ready_steps(steps: DataFrame) -> DataFrame:
    """Steps (plan, step, status, needs) that wait and whose needs are all done; a need without a step is never done."""
    done = steps.where("status = 'done'").select("plan", F.col("step").alias("need")).distinct().withColumn("_done", F.lit(1))
    waiting = steps.where("status = 'pending'")
    each = waiting.select("plan", "step", F.explode(F.array_distinct("needs")).alias("need")).join(done, ["plan", "need"], "left").where("_done is null")
    return waiting.join(each.select("plan", "step").distinct(), ["plan", "step"], "left_anti").select("plan", "step")


def evicted(events: DataFrame, started: Column) -> DataFrame:
    """Pending paths left when a sync that began at `started` ends: those with a later event."""
    return events.groupBy("path").agg(F.max("ts").alias("last")).where(F.col("last") > started)


def visible_files(tracked: DataFrame, untracked: DataFrame, ignored: Column) -> DataFrame:
    """Paths under version control and those beside it that no rule ignores, each once."""
    return tracked.select("path").unionByName(untracked.where(~F.coalesce(ignored, F.lit(False))).select("path")).where("path is not null").distinct()


def embedded_repositories(paths: DataFrame) -> DataFrame:
    """(folder): folders that hold a repository of their own below the root, by their marker; the marker may be a file."""
    folder = F.regexp_extract("path", r"^(.+?)/\.git(?:/|$)", 1)
    return paths.select(folder.alias("folder")).where("folder <> ''").distinct()


def reindexed_postings(postings: DataFrame, fresh: DataFrame, files: DataFrame, file: str = "file_path") -> DataFrame:
    """A term index after some files were indexed again or removed: their old postings leave, the new ones come in."""
    return postings.join(files.select(file).distinct(), file, "left_anti").unionByName(fresh.join(files.select(file).distinct(), file, "left_semi"))


def token_total(messages: DataFrame, conversation: str, text: str, limit: int, threshold: float = 0.8) -> DataFrame:
    """(conversation, tokens, compact): estimated tokens and whether they pass the threshold of the limit."""
    return messages.groupBy(conversation).agg(F.sum(token_estimate(text)).cast("bigint").alias("tokens")).withColumn("compact", F.col("tokens") > F.lit(limit * threshold))
