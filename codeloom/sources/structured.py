"""Structured files as nodes: properties, YAML, mapper XML, forms, infrastructure blocks, components with embedded script."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.extract import REGISTRY, node_id, register

ROW = "file_path string, kind string, name string, qualified_name string, value string, line int"


def properties(texts: DataFrame) -> DataFrame:
    """(file_path, kind, name, qualified_name, value, line): one constant per key of property files (path, text); comments and lines without key are left out."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("k", "l"))
    pattern = r"^\s*([^#!\s=:][^=:\s]*)\s*[=:]\s*(.*?)\s*$"
    key = F.regexp_extract("l", pattern, 1)
    return lines.where(key != "").select(F.col("path").alias("file_path"), F.lit("constant").alias("kind"), key.alias("name"), key.alias("qualified_name"), F.regexp_extract("l", pattern, 2).alias("value"), (F.col("k") + 1).alias("line"))


_YAML = re.compile(r"^(\s*)(?:-\s+)?([\w.$/-]+|\"[^\"]+\"|'[^']+')\s*:(?:\s+(.*?))?\s*$")


def yaml_keys(text: str) -> Iterator[tuple[str, str, str, str | None, int]]:
    """(kind, name, qualified, value, line) of the keys of a document by their indentation: leaves are constants, others modules; block scalars are values."""
    stack: list[tuple[int, str]] = []
    block: int | None = None
    for k, line in enumerate(text.split("\n")):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if block is not None:
            if indent > block:
                continue
            block = None
        if line.startswith("---"):
            stack = []
            continue
        m = _YAML.match(line)
        if not m:
            continue
        column = m.start(2)  # behind the mark of a list item
        while stack and stack[-1][0] >= column:
            stack.pop()
        name = m[2].strip("\"'")
        value = m[3]
        stack.append((column, name))
        if value and re.fullmatch(r"[|>][+-]?\d*", value):
            block = indent
        leaf = value is not None and not value.startswith("#") and value != ""
        yield ("constant" if leaf else "module"), name, ".".join(n for _, n in stack), value if leaf else None, k + 1


def yaml(texts: DataFrame) -> DataFrame:
    """ROW of YAML texts (path, text); a leaf is a constant, other keys are modules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(b["path"], b["text"]) for r in yaml_keys(t)], columns=[c.split()[0] for c in ROW.split(", ")], dtype=object)

    return texts.where("text is not null").select("path", "text").mapInPandas(run, ROW)


def mapper_statements(texts: DataFrame) -> DataFrame:
    """(file_path, namespace, kind, name, qualified_name, uses): statements and fragments of SQL mapper files (path, text), with the fragments they include."""
    namespace = F.regexp_extract("text", r"<mapper\b[^>]*\bnamespace\s*=\s*\"([^\"]+)\"", 1)
    body = F.regexp_extract_all("text", F.lit(r"(?s)<(select|insert|update|delete|sql)\b[^>]*\bid\s*=\s*\"([^\"]+)\"[^>]*>(.*?)</\1>"), 0)
    rows = texts.where(namespace != "").select("path", namespace.alias("namespace"), F.explode(body).alias("b"))
    name = F.regexp_extract("b", r"^<\w+\b[^>]*\bid\s*=\s*\"([^\"]+)\"", 1)
    return rows.select(F.col("path").alias("file_path"), "namespace", F.regexp_extract("b", r"^<(\w+)", 1).alias("kind"), name.alias("name"), F.concat_ws("::", "namespace", name).alias("qualified_name"), F.regexp_extract_all("b", F.lit(r"<include\b[^>]*\brefid\s*=\s*\"([^\"]+)\""), 1).alias("uses"))


def form_components(text: str) -> Iterator[tuple[str, str, str, str | None, int]]:
    """(kind, name, qualified, value, line) of a form: its objects with their class, and the handlers its events name."""
    stack: list[str] = []
    for k, line in enumerate(text.split("\n")):
        bare = line.strip()
        if m := re.match(r"(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", bare):
            stack.append(m[1])
            yield "component", m[1], ".".join(stack), m[2], k + 1
        elif bare.lower() == "end" and stack:
            stack.pop()
        elif stack and (m := re.match(r"(On\w+)\s*=\s*(\w+)$", bare)):
            yield "event", m[1], ".".join([*stack, m[1]]), m[2], k + 1


def forms(texts: DataFrame) -> DataFrame:
    """ROW of form files (path, text); value is the class of a component, the handler of an event."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(b["path"], b["text"]) for r in form_components(t)], columns=[c.split()[0] for c in ROW.split(", ")], dtype=object)

    return texts.where("text is not null").select("path", "text").mapInPandas(run, ROW)


def infrastructure(texts: DataFrame) -> DataFrame:
    """(file_path, kind, name, references): blocks of infrastructure files (path, text): resources and data by type and name, variables, outputs, modules; what each refers to."""
    block = F.regexp_extract_all("text", F.lit(r"(?ms)^(resource|data|variable|output|module|provider|locals)\b([^{\n]*)\{(.*?)^\}"), 0)
    rows = texts.select("path", F.explode(block).alias("b"))
    labels = F.regexp_extract_all(F.regexp_extract("b", r"^\w+([^{\n]*)", 1), F.lit(r"\"([^\"]+)\""), 1)
    refs = F.array_distinct(F.regexp_extract_all("b", F.lit(r"\b((?:var|local|module|data\.\w+|aws_\w+|google_\w+|azurerm_\w+)\.\w+)"), 1))
    return rows.select(F.col("path").alias("file_path"), F.regexp_extract("b", r"^(\w+)", 1).alias("kind"), F.array_join(labels, ".").alias("name"), refs.alias("references"))


_SCRIPT = re.compile(r"(?s)<script\b([^>]*)>(.*?)</script>")
_FRONT = re.compile(r"(?s)\A---\s*\n(.*?)\n---")
_CODE = re.compile(r"(?s)@(?:code|functions)\s*\{(.*)\}")


def component_script(text: str, language: str) -> tuple[str, int, str]:
    """(script, lines before it, its language) of a component file; blank if it holds none."""
    m = _FRONT.match(text) if language == "astro" else _CODE.search(text) if language == "razor" else None
    if m:
        return m[1], text[: m.start(1)].count("\n"), "csharp" if language == "razor" else "typescript"
    m = _SCRIPT.search(text)
    if not m:
        return "", 0, "javascript"
    return m[2], text[: m.start(2)].count("\n"), "typescript" if re.search(r"lang=['\"]ts", m[1]) else "javascript"


def _component(language: str):
    def extract(path: str, text: str) -> Iterator[dict]:
        name = path.rsplit("/", 1)[-1].split(".")[0]
        i = node_id(path, "component", name, 1)
        script, offset, inner = component_script(text, language)
        yield {"tag": "node", "id": i, "kind": "component", "name": name, "qualified_name": name, "file_path": path, "language": language, "start_line": 1, "end_line": text.count("\n") + 1}
        moved: dict[str, str] = {}
        for r in REGISTRY[inner](path, script) if script else ():
            if r["tag"] == "node" and r["kind"] == "file":
                moved[r["id"]] = i
                continue
            if r["tag"] == "node":
                line = r["start_line"] + offset
                moved[r["id"]] = node_id(path, r["kind"], r["name"], line)
                r = r | {"id": moved[r["id"]], "language": language, "start_line": line, "end_line": r["end_line"] + offset}
            else:
                r = r | {k: moved.get(r[k], r[k]) for k in ("source", "target") if r.get(k)} | {"line": r["line"] + offset}
            yield r
        bare = _SCRIPT.sub(lambda m: "\n" * m[0].count("\n"), text)
        for m in re.finditer(r"<([A-Z]\w*)\b", bare):
            yield {"tag": "ref", "kind": "references", "name": m[1], "source": i, "line": bare[: m.start()].count("\n") + 1, "file_path": path, "language": language}
        for m in re.finditer(r"\{%-?\s*(?:render|include|section)\s+['\"]([\w/-]+)['\"]", text if language == "liquid" else ""):
            yield {"tag": "ref", "kind": "imports", "name": m[1], "source": i, "line": text[: m.start()].count("\n") + 1, "file_path": path, "language": language}

    return extract


for _l in ("vue", "svelte", "astro", "liquid", "razor"):
    register(_l, _component(_l))
