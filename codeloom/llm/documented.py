"""Functions paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.llm.docs_words import says_something
from codeloom.llm.invalid_files import file_texts
from codeloom.runtime import likely_in, materialise, spread

_ANNOTATION = re.compile(r"\s*@[\w.]+(?:\(.*\))?\s*$")
_DEF = re.compile(r"\s*(?:async\s+)?(?:def|class)\b")
_PY_QUOTES = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|''')")


def comment_spans(text: str, python: bool) -> list[tuple[int, int, str]]:
    """(end, barrier, comment) of each comment span, lines from 1: its last line and the line of the first statement after it.

    What starts in [end, barrier] has no statement between itself and the
    comment. Annotations and decorators are no statements; a blank line after
    the comment detaches it. In Python the string that opens a block belongs
    to its def or class: it ends at the first decorator, the barrier is the
    line of the def.
    """
    lines, out, pending, inside, k = text.split("\n"), [], [], False, 0
    n, end, head = len(lines), 0, 0
    while k < n:
        line = lines[k]
        bare = line.strip()
        if inside:
            pending.append(line)
            end, inside = k + 1, "*/" not in bare
        elif bare.startswith("/*") and not python:
            pending, head = [line], 0
            end, inside = k + 1, "*/" not in bare[2:]
        elif bare.startswith("#" if python else "//"):
            pending.append(line)
            end, head = k + 1, 0
        elif not bare:
            pending, head = [], 0
        elif _ANNOTATION.match(line):
            head = head or k + 1
        else:
            if pending:
                out.append((end, k + 1, "\n".join(pending)))
                pending = []
            if python and _DEF.match(line):
                j, at = k, k + 1  # a signature may take several lines
                while j + 1 < n and not lines[j].rstrip().endswith(":"):
                    j += 1
                q = _PY_QUOTES.match(lines[j + 1]) if j + 1 < n else None
                if q:
                    first = lines[j + 1][q.end() :]
                    body, e = [first], j + 1
                    if q[1] not in first:
                        while e + 1 < n:
                            e += 1
                            body.append(lines[e])
                            if q[1] in lines[e]:
                                break
                    out.append((head or at, at, "\n".join(body).split(q[1])[0]))
                    k = e
            head = 0
        k += 1
    return out


def _comments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, *span) for p, t in zip(b["path"], b["text"]) for span in comment_spans(t, p.endswith((".py", ".pyi")))]
        yield pd.DataFrame(rows, columns=["file_path", "at", "barrier", "comment"])


def _squeezed(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def origin(attached: str | None, recorded: str | None, name: str | None) -> str | None:
    """Where a function's documentation stands; None if it has none that says something.

    `confirmed`: in the attached comment, and the record holds the same words.
    `attached`: in the attached comment alone, nothing is recorded. `recorded`:
    in the record alone, as the text is missing or says otherwise.
    """
    if recorded is None:
        return "attached" if says_something(attached, name) else None
    if not says_something(recorded, name):
        return None
    return "confirmed" if says_something(attached, name) and _squeezed(recorded) in _squeezed(attached) else "recorded"


@F.pandas_udf(StringType())
def origin_udf(attached: pd.Series, recorded: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([origin(*x) for x in zip(attached, recorded, name)], dtype=object)


def newest_functions(nodes: DataFrame, *more: str) -> DataFrame:
    """(node_id, file_path, name, kind, docstring, first, last and the columns asked for): newest rows of functions and methods; interchanged ends put right."""
    cols = ["updated_at", "kind", "name", "file_path", "start_line", "end_line", "docstring", *more]
    m = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct(*cols)).alias("m")).select(F.col("id").alias("node_id"), "m.*")
    return m.where("kind in ('function', 'method')").select(
        "node_id",
        "file_path",
        "name",
        "kind",
        "docstring",
        F.least("start_line", "end_line").alias("first"),
        F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.greatest("start_line", "end_line")).alias("last"),
        *more,
    )


def attach_comments(functions: DataFrame, documents: DataFrame) -> DataFrame:
    """functions with `attached`: the nearest comment span that ends at or before their first line, if no statement stands between.

    As-of interval join: comment spans come from the texts, function spans
    from the nodes, neither knows of the other. Both are sorted together by
    file and line, each function looks at the last span before it, and the
    span's barrier tells whether a statement intervenes. A file's rows are
    sorted once and none is paired with all spans. Without line, text or span
    `attached` is null.
    """
    spans = spread(file_texts(documents, "text")).mapInPandas(_comments, "file_path string, at int, barrier int, comment string")
    events = functions.withColumns({"at": F.col("first"), "barrier": F.lit(None).cast("int"), "comment": F.lit(None).cast("string"), "order": F.lit(1)}).unionByName(
        spans.withColumn("order", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy("file_path").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("order") == 0, F.struct("barrier", "comment")), ignorenulls=True).over(w)
    return (
        events.where("file_path is not null and at is not null")
        .withColumn("near", near)
        .where("order = 1")
        .withColumn("attached", F.when(F.col("near.barrier") >= F.col("first"), F.col("near.comment")))
        .drop("at", "barrier", "comment", "order", "near")
        .unionByName(functions.where("file_path is null or first is null").withColumn("attached", F.lit(None).cast("string")))
    )


def documented_functions(nodes: DataFrame, documents: DataFrame, *more: str) -> DataFrame:
    """Functions and methods whose documentation says something, with `description` and its `origin` (see origin()).

    The description is the attached comment; the recorded docstring checks it,
    and stands in where the text is missing or says otherwise. Dropped: null
    or blank text, marks and ornaments, placeholders, bare tags and
    directives, words that only repeat the name.
    """
    rows = attach_comments(newest_functions(nodes, *more), documents).withColumn("origin", origin_udf("attached", "docstring", "name")).where("origin is not null")
    return rows.withColumn("description", F.when(F.col("origin") == "recorded", F.col("docstring")).otherwise(F.col("attached"))).drop("attached", "docstring")


def pairs(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id, qualified_name, kind, signature, origin, description, code); code is null where the lines are unknown or the text is missing.

    Only texts of files with documented functions are moved, once each, to the
    functions of their file; a text is cut into lines once.
    """
    out = ["node_id", "qualified_name", "kind", "signature", "origin", "description"]
    rows = materialise(documented_functions(nodes, documents, "qualified_name", "signature").withColumn("qualified_name", F.coalesce("qualified_name", "name")).select(*out, "file_path", "first", "last"))
    known = rows.where("file_path is not null")
    per_file = known.groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct(*out, "first", "last")).alias("items"))
    texts = likely_in(file_texts(documents, "text"), F.col("path"), known, F.col("file_path")).groupBy("path").agg(F.max("text").alias("text"))

    def code(lines, i):
        return F.when(i["first"] >= 1, F.array_join(F.slice(lines, i["first"], i["last"] - i["first"] + 1), "\n"))

    # the lines are bound by the outer transform, so that they are cut once and not per function
    cut = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in out), code(lines, i).alias("code"))))[0]
    found = per_file.join(texts, "path", "left").select(F.explode(cut).alias("x")).select("x.*")
    return found.unionByName(rows.where("file_path is null").select(*out, F.lit(None).cast("string").alias("code")))
