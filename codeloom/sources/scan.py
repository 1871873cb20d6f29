"""Listing and choosing source files: languages, ignore rules, globs, guards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import BooleanType

from codeloom.functions import scoring
from codeloom.functions.constants import DISPLAY_LANGUAGE, IGNORED_DIRS, LANGUAGE_BY_EXTENSION
from codeloom.functions.text import mapped

MAX_FILE_BYTES = 1_048_576


def binary_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files below a root on any file system."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def detect_language(path: Column, content: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Language by the last extension (letter case counts), then by a Python shebang, else `unknown`; overrides come first."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    table = LANGUAGE_BY_EXTENSION | (overrides or {})
    shebang = F.when(content.rlike(r"^#!.*\bpython"), "python") if content is not None else F.lit(None).cast("string")
    return F.coalesce(mapped(ext, table), shebang, F.lit("unknown"))


def display_language(path: Column) -> Column:
    """Language for display by the lower-cased extension, or the bare extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(mapped(ext, DISPLAY_LANGUAGE), ext)


def should_index(path: Column, dirs: list[str] = IGNORED_DIRS, parts: tuple[str, ...] = ()) -> Column:
    bad = F.arrays_overlap(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.array(*map(F.lit, dirs)))
    for p in parts:
        bad = bad | path.contains(p)
    return ~bad


def is_source(path: Column) -> Column:
    return (detect_language(path) != "unknown") & ~scoring.is_generated(path) & ~path.rlike(r"\.bundle\.m?js$")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: `**/` any directories, `*` and `?` within one, [sets], {a,b}."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and "]" in pattern[k + 2 :]:
            e = pattern.index("]", k + 2)
            body = pattern[k + 1 : e]
            out, k = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", e + 1
            continue
        if c == "{" and "}" in pattern[k:]:
            e = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(map(re.escape, pattern[k + 1 : e].split(","))) + ")", e + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regex, negated) of the lines of an ignore file, in order; comments and blank lines left out."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:].lstrip("\\") if line.startswith("\\#") else line[negated:]
        only_dir, anchored = body.endswith("/"), "/" in body.rstrip("/")
        inner = glob_regex(body.strip("/"))[1:-1]
        out.append(("^" + ("" if anchored else "(?:.*/)?") + inner + ("/.*$" if only_dir else "(?:/.*)?$"), negated))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


@F.pandas_udf(BooleanType())
def is_binary(content: pd.Series) -> pd.Series:
    """A NUL byte, or over 30 % control bytes."""

    def one(b) -> bool:
        if not b:
            return False
        return b"\0" in b or sum(map(bytes(b).count, (bytes([k]) for k in range(32) if k not in (9, 10, 13)))) / len(b) > 0.3

    return content.map(one)


def guarded(files: DataFrame) -> DataFrame:
    """files (path, length, content) with `reject`: size_exceeded, binary, ignored, unknown_language or null."""
    return files.withColumn(
        "reject",
        F.when(F.col("length") > MAX_FILE_BYTES, "size_exceeded")
        .when(is_binary("content"), "binary")
        .when(~should_index(F.col("path")), "ignored")
        .when(detect_language(F.col("path"), F.col("content").cast("string")) == "unknown", "unknown_language"),
    )


def find_files(files: DataFrame, pattern: str | None = None, language: str | None = None, name: str | None = None) -> DataFrame:
    out = files
    if pattern:
        out = out.where(F.col("path").rlike(f"(?i){pattern}"))
    if language:
        out = out.where(F.col("language") == language)
    if name:
        out = out.where(F.element_at(F.split("path", "/"), -1) == name)
    return out


def inside(path: Column, root: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return (clean == root.rstrip("/")) | clean.startswith(root.rstrip("/") + "/")
