"""Scalar text functions as Spark columns; Python only where no built-in can say it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import ArrayType, StringType

from codeloom.functions.constants import PROSE_STOP_WORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(c: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def identifier_segments(c: Column | str) -> Column:
    """Lower-case words of an identifier: camel case, acronyms, any other sign separates; 2 to 32 characters, no plain numbers, at most 12."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    parts = F.flatten(F.transform(runs, lambda r: F.split(r, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")))
    low = F.transform(parts, F.lower)
    fit = F.filter(low, lambda s: (F.length(s) >= 2) & (F.length(s) <= 32) & ~s.rlike(r"^\p{N}+$"))
    return F.slice(F.array_distinct(fit), 1, 12)


@F.pandas_udf(StringType())
def without_marks(c: pd.Series) -> pd.Series:
    """NFD form without combining marks, lower case."""
    return c.map(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.category(x).startswith("M")).lower())


def prose_candidates(c: Column | str) -> Column:
    """The first 16 distinct words of 4 to 24 characters that are neither numbers nor stop words."""
    words = F.transform(F.regexp_extract_all(_col(c), F.lit(r"([\p{L}\p{N}]+)"), 1), F.lower)
    fit = F.filter(words, lambda w: (F.length(w) >= 4) & (F.length(w) <= 24) & ~w.rlike(r"^\p{N}+$"))
    return F.slice(F.array_except(fit, F.array(*map(F.lit, PROSE_STOP_WORDS))), 1, 16)


def lookup_variants(c: Column | str) -> Column:
    """A word and its forms without plural endings."""
    w = _col(c)
    n = F.length(w)
    cut = lambda k: F.when(n >= 4 + k, F.substr(w, F.lit(1), n - k))
    a = w.rlike("(x|sh|ss|zz)es$")
    b = w.rlike("(ch|s|z|o)es$")
    s = w.rlike("[^s]s$")
    return F.array_compact(F.array(w, F.when(a | b, cut(2)), F.when(~a & b | ~a & ~b & s, cut(1))))


def stem_variants(c: Column | str) -> Column:
    """A term and its forms without one of eight endings; `ies` also becomes `y`."""
    t = _col(c)
    forms = [F.when(t.endswith(e) & (F.length(t) - len(e) >= 2), F.substr(t, F.lit(1), F.length(t) - len(e))) for e in "ing tion ment ies es s ed er".split()]
    y = F.when(t.endswith("ies") & (F.length(t) >= 5), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y")))
    return F.array_distinct(F.array_compact(F.array(t, *forms, y)))


def search_terms(c: Column | str) -> Column:
    """Lower-case terms of a query with their stems: dots separate, snake case or else camel case is cut."""
    parts = F.filter(F.split(F.replace(_col(c), F.lit("."), F.lit(" ")), r"\s+"), lambda p: p != "")
    snake = lambda p: F.filter(F.split(p, "_+"), lambda x: x != "")
    camel = lambda p: F.filter(F.split(p, "(?=[A-Z])"), lambda x: x != "")
    one = lambda p: F.when(F.size(snake(p)) > 1, F.transform(snake(p), F.lower)).otherwise(F.filter(F.transform(camel(p), F.lower), lambda x: F.length(x) >= 2))
    base = F.array_distinct(F.flatten(F.transform(parts, one)))
    stems = F.filter(F.flatten(F.transform(base, stem_variants)), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.concat(base, stems))


def camel_words(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(s, r"[\s._:/\\]+"), lambda w: F.length(w) > 1)


def query_symbols(c: Column | str) -> Column:
    """Symbols named in prose: dotted paths, SCREAMING, snake and camel case, in that order, distinct."""
    s = _col(c)
    take = lambda p: F.regexp_extract_all(s, F.lit(p), 1)
    return F.array_distinct(
        F.concat(
            take(r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b"),
            take(r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"),
            take(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"),
            take(r"\b([A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+)\b"),
        )
    )


def is_distinctive(c: Column | str) -> Column:
    s = _col(c)
    return s.contains("_") | s.rlike("[0-9]") | s.rlike("^.+[A-Z]")


def edit_distance_within(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 beyond the bound."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def name_token(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def unquoted(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r'(?s)^"(.*)"$', "$1")


def name_tail(c: Column | str) -> Column:
    """What follows the last `.` or `:`."""
    return F.regexp_extract(_col(c), r"([^.:]*)$", 1)


def fts_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9_]+", " "), " "), lambda t: t != "")


def occurrences(c: Column | str, token: Column | str) -> Column:
    """Times that a token occurs without overlap."""
    s, t = _col(c), _col(token)
    return F.when(F.length(t) > 0, (F.length(s) - F.length(F.replace(s, t, F.lit("")))) / F.length(t)).otherwise(0).cast("int")


def html_to_text(c: Column | str) -> Column:
    s = _col(c)
    for pattern, by in (
        (r"(?is)<script[^>]*>.*?</script>", ""),
        (r"(?is)<style[^>]*>.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|h[1-6]|li|tr)>", "\n"),
        (r"<[^>]+>", ""),
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ):
        s = F.regexp_replace(s, pattern, by)
    return s


def html_title(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(_col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(c: Column | str, most: int = 10) -> Column:
    """(url, title) of the first links; redirect wrappers are undone."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?is)(<a\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), 1)
    href = lambda a: F.regexp_extract(a, r'(?is)href="([^"]*)"', 1)
    real = lambda u: F.when(u.rlike("[?&]uddg="), F.try_url_decode(F.regexp_extract(u, "[?&]uddg=([^&]*)", 1))).otherwise(u)
    return F.slice(F.transform(found, lambda a: F.struct(real(href(a)).alias("url"), html_to_text(F.regexp_replace(a, "(?is)^<a[^>]*>|</a>$", "")).alias("title"))), 1, most)


def is_private_host(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike(r"^(localhost|.*\.local|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*)$")


def without_fences(c: Column | str) -> Column:
    """Without an enclosing code fence and outer quotes."""
    s = F.regexp_replace(F.trim(_col(c)), r"(?s)^```[\w-]*\n(.*?)\n?```$", "$1")
    return F.regexp_replace(F.trim(s), r"(?s)^(\"|')(.*)\1$", "$2")


def truncated(c: Column | str, head: int = 24000, tail: int = 3000) -> Column:
    s = _col(c)
    n = F.length(s)
    cut = F.concat(F.left(s, F.lit(head)), F.lit("\n... ["), (n - head - tail).cast("string"), F.lit(" characters left out] ...\n"), F.right(s, F.lit(tail)))
    return F.when(n <= head + tail, s).otherwise(cut)


def numbered_lines(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(c), "\n"), lambda l, k: F.concat((k + 1).cast("string"), F.lit("\t"), l)), "\n")


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) * 0.25)


def find_json_blocks(text: str) -> list[str]:
    """Balanced top-level {} spans; braces in strings do not count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for k, c in enumerate(text):
        if quoted:
            escaped, quoted = (False, quoted) if escaped else (c == "\\", c != '"')
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (k, 1) if depth == 0 else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : k + 1])
    return out


@F.pandas_udf(ArrayType(StringType()))
def json_blocks(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else find_json_blocks(s))


def blanked_comments(text: str, language: str) -> str:
    """Comments replaced by blanks, so that offsets and lines stay; strings are kept."""
    import re

    hash_only = language in ("python", "ruby", "shell", "yaml", "erlang")
    mark = "%" if language == "erlang" else "#"
    strings = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
    comment = mark + r"[^\n]*" if hash_only else r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)" + (r"|#[^\n]*" if language == "php" else "")
    return re.sub(f"({strings})|({comment})", lambda m: m[1] if m[1] is not None else re.sub(r"[^\n]", " ", m[2]), text)


@F.pandas_udf(StringType())
def without_comments(c: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else blanked_comments(s, g or "") for s, g in zip(c, language)])
