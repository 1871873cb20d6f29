"""Generated, minified, vendored files and data saved as source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.invalid_files import file_texts, newest_files
from codeloom.runtime import materialise, skewed_join, spread

#: Banners that a generator writes at the top of a file; fixed values.
GENERATED_BANNER = re.compile(
    r"(?i)<auto-?generated\b|(?<![\w`'\"])@generated\b|\bcode generated by\b.*\bdo not (?:edit|modify)|\bauto-?generated (?:file|by|from|code)\b|\bgenerated (?:automatically )?(?:by|from|with|using)\b"
    r"|\b(?:produced|created|generated|emitted|written) automatically\b|\bautomatically (?:generated|produced|created)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|自动生成|自動生成|(?:создан|сгенерирован)[аоы]? автоматически|автоматически (?:создан|сгенерирован)|\bgenerad[oa] autom[aá]ticamente\b|\bgénéré automatiquement\b"
)
#: Banners of copies from elsewhere; fixed values.
VENDORED_BANNER = re.compile(r"(?im)\bvendored (?:at|from)\b|\breleased under the (?:terms|\w+ licen[sc]e)|^\W*!\s*\S+ v?\d+\.\d+[\w.]* \||^\W*\S+ v\d+\.\d+[\w.]* - \(c\)|\(c\) (?:\d{4} )?the \S+ contributors|\bcopied (?:verbatim )?from https?://")
#: Folders that hold third-party code, and names that generators give; fixed values.
VENDORED_DIR = r"(?i)(^|/)(vendor|vendored|third_party|third-party|thirdparty|node_modules|bower_components|jspm_packages|external|deps|site-packages)/"
GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|ts|js)|(_grpc)?_pb\.(d\.)?[jt]s|Grpc\.java|OuterClass\.java|\.generated\.\w+|\.gen\.\w+|\.g\.\w+|\.designer\.\w+|_generated\.go)$|(^|/)zz_generated\.[^/]*$"
MINIFIED_NAME = r"[.-]min\.[cm]?js$|\.bundle\.js$"
#: Layout limits per language, set between what hand-written and other files of that language show: minified text passes
#: three of longest line, mean line, share of white space (below) and of alphanumeric among visible characters (below);
#: data passes the share of number literals, of digits or of encoded runs.
LIMITS = ("longest", "mean", "blanks", "alnum", "numbers", "digits", "encoded")
PROFILES = {
    "javascript": (500, 130, 0.11, 0.73, 0.35, 0.45, 0.40),
    "typescript": (400, 110, 0.11, 0.74, 0.35, 0.45, 0.40),
    "python": (450, 120, 0.09, 0.75, 0.40, 0.50, 0.40),
    "java": (400, 100, 0.13, 0.76, 0.35, 0.45, 0.40),
    "go": (400, 110, 0.13, 0.78, 0.35, 0.45, 0.40),
}
_HEADER = re.compile(r"\s*(?://|#(?!!)|/\*|\*|\"\"\"|<!--|--|;)")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}){10,}|(?:0x[0-9a-fA-F]{1,8},\s*){10,}")
_NUMBERS = re.compile(r"(?:-?\d[\d.]*\s*,\s*){5,}")
_VISIBLE, _DIGITS = re.compile(r"[\W_]+"), re.compile(r"\D+")
_FEATURES = "path string, generated boolean, vendored boolean, longest int, mean double, blanks double, alnum double, numbers double, digits double, encoded double, body_chars bigint, body binary"


def split_header(text: str) -> tuple[str, str]:
    """The leading comment lines and the rest."""
    at, inside = 0, False
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if inside:
            inside = "*/" not in bare
        elif bare.startswith("/*"):
            inside = "*/" not in bare
        elif bare and not bare.startswith(("//", "#", "*", "<!--")):
            break
        at += len(line)
    return text[:at], text[at:]


def layout(text: str) -> tuple:
    """Layout statistics of a whole text: see _FEATURES."""
    n = max(1, len(text))
    lines = text.split("\n")
    solid = "".join(text.split())
    visible = max(1, len(solid))
    word = _VISIBLE.sub("", solid)
    head, body = split_header(text)
    core = body.strip()
    return (
        bool(GENERATED_BANNER.search(head)),
        bool(VENDORED_BANNER.search(head)),
        max(map(len, lines)),
        n / len(lines),
        1 - len(solid) / n,
        len(word) / visible,
        sum(len(m) for m in _NUMBERS.findall(text)) / n,
        len(_DIGITS.sub("", word)) / visible,
        sum(len(m) for m in _RUN.findall(text)) / n,
        len(core),
        blake2b(core.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
    )


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for b in batches:
        yield pd.DataFrame([(p, *layout(t)) for p, t in zip(b["path"], b["text"])], columns=names)


def copied_paths(rows: DataFrame, least_copy: int = 40) -> DataFrame:
    """(path): files whose text without leading comments came from elsewhere.

    rows (path, repo, stamp, first_seen, body, body_chars): a text that a
    stamped file holds is a copy wherever it stands; one that stands in several
    repositories without stamp is a copy but for the file that was indexed
    first. Texts below least_copy characters are no copies. Copies are counted
    before they are joined, so a text that a third of all files share is cut.
    """
    long = rows.where(F.col("body_chars") >= least_copy)
    known = long.groupBy("body").agg(F.max("stamp").alias("known"), F.min("repo").alias("r1"), F.max("repo").alias("r2"), F.min_by("path", F.struct("first_seen", "path")).alias("original"), F.count("*").alias("n"))
    copies = known.where("n > 1 and (known or r1 <> r2)").select("body", "n", F.when(~F.col("known"), F.col("original")).alias("original"))
    return skewed_join(long.select("path", "body"), copies, "body", "n", ["path"]).where("original is null or path <> original").select("path").distinct()


def classify_files(documents: DataFrame, files: DataFrame, least_copy: int = 40) -> DataFrame:
    """(path, repo, language, size, reason, score) of every file; reason null for hand-written source.

    First the layout: `data` (number literals, digits or encoded runs make up
    most of it), `minified` (three of four statistics beyond the limits of the
    language; `score` counts them). Text that a tool or a third party wrote
    in ordinary layout shows no such sign and is told by evidence: `generated`
    (a generator's banner among the leading comments, or its file name),
    `vendored` (third-party folder, a vendoring banner, or copied_paths()).
    JSON is configuration and never a case, nor are languages without a
    profile unless path or banner says so. Names and banners that only mention
    such files do not count. Paths without files row are left out.

    Statistics are taken where a text is read; only they are shuffled.
    """
    stats = materialise(spread(file_texts(documents, "text")).mapInPandas(_layouts, _FEATURES))  # the copies are found in it and joined to it
    rows = stats.join(newest_files(files), "path").withColumn("repo", F.split_part("path", F.lit("/"), F.lit(1)))
    rows = rows.withColumn("stamp", F.col("vendored") | F.col("path").rlike(VENDORED_DIR))
    rows = rows.join(copied_paths(rows, least_copy).withColumn("copied", F.lit(True)), "path", "left")
    by = {c: F.create_map(*(x for name, v in PROFILES.items() for x in (F.lit(name), F.lit(float(v[k])))))[F.col("language")] for k, c in enumerate(LIMITS)}
    beyond = [F.col("longest") >= by["longest"], F.col("mean") >= by["mean"], F.col("blanks") < by["blanks"], F.col("alnum") < by["alnum"]]
    rows = rows.withColumn("score", sum((F.coalesce(b, F.lit(False)).cast("int") for b in beyond), F.lit(0)))
    reason = (
        F.when(F.col("language") == "json", None)
        .when((F.col("numbers") >= by["numbers"]) | (F.col("digits") >= by["digits"]) | (F.col("encoded") >= by["encoded"]), "data")
        .when((F.col("score") >= 3) | F.col("path").rlike(MINIFIED_NAME), "minified")
        .when(F.col("generated") | F.col("path").rlike(GENERATED_NAME), "generated")
        .when(F.col("stamp") | F.col("copied"), "vendored")
    )
    return rows.select("path", "repo", "language", "size", reason.alias("reason"), "score")
