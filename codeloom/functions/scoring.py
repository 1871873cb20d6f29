"""Scores of names, kinds and paths as columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from codeloom.functions.constants import GENERATED_FILE, KIND_BONUS, LANGUAGE_FAMILY, LOW_VALUE_PATH, OTHER_KIND_BONUS, TEST_PATH
from codeloom.functions.text import mapped


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(mapped(kind, KIND_BONUS), F.lit(OTHER_KIND_BONUS))


def name_match_bonus(query: str, name: Column) -> Column:
    q, n = query.lower(), F.lower(name)
    terms = q.split()
    every = F.lit(len(terms) > 1)
    for t in terms:
        every = every & n.contains(t)
    return F.when(n == q, 30).when(n.startswith(q), 20).when(n.contains(q), 10).when(every, 15).otherwise(0)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED_FILE)


def is_low_value(path: Column) -> Column:
    return F.lower(path).rlike(LOW_VALUE_PATH) | is_generated(path)


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def path_relevance(path: Column, query: str, project_words: frozenset[str] = frozenset()) -> Column:
    """+5 for each query term in the path, project words apart; -10 for tests and generated files."""
    p, score = F.lower(path), F.lit(0)
    for t in query.lower().split():
        if t not in project_words:
            score = score + F.when(p.contains(t), 5).otherwise(0)
    return score - F.when(is_low_value(path), 10).otherwise(0)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def path_proximity(a: Column, b: Column) -> Column:
    """15 for each leading directory that both share, 80 at most."""
    same = F.zip_with(directories(a), directories(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    shared = F.when(first_other > 0, first_other - 1).otherwise(F.size(same))
    return F.least(F.lit(80), shared * 15).cast("int")


def rescored(score: Column, query: str, kind: Column, name: Column, path: Column) -> Column:
    total = score + kind_bonus(kind) + path_relevance(path, query) + name_match_bonus(query, name)
    return F.when(is_generated(path), total * 0.1).otherwise(total)


def language_family(language: Column) -> Column:
    low = F.lower(language)
    return F.coalesce(mapped(low, LANGUAGE_FAMILY), low)


def same_family(a: Column, b: Column) -> Column:
    return (a == b) | (language_family(a) == language_family(b))


def crosses_families(a: Column, b: Column) -> Column:
    """Two different families, both known."""
    known = lambda x: F.lower(x).isin(list(LANGUAGE_FAMILY))
    return known(a) & known(b) & ~same_family(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda e: e.cast("double") * e.cast("double"))))
    return F.when((norm(x) == 0) | (norm(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


def explore_budget(files: Column) -> Column:
    """Calls that an exploration may take, by the number of files."""
    return F.when(files < 500, 1).when(files < 5000, 2).when(files < 15000, 3).when(files < 25000, 4).otherwise(5)
