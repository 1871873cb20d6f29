"""Extractors: source text to nodes, edges and references; frameworks to routes.

An extractor is a function (path, text) -> rows (tag, ...). These read lines
with patterns and indentation or braces; they are no compilers. The registry
is open: register(language, function).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "tag string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, source string, target string, line int"
Extractor = Callable[[str, str], Iterator[dict]]
REGISTRY: dict[str, Extractor] = {}

_DEFS = {
    "python": [("class", r"^(?P<in>\s*)class\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)(?:async\s+)?def\s+(?P<n>\w+)")],
    "typescript": [
        ("class", r"^(?P<in>\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>\w+)"),
        ("interface", r"^(?P<in>\s*)(?:export\s+)?interface\s+(?P<n>\w+)"),
        ("enum", r"^(?P<in>\s*)(?:export\s+)?(?:const\s+)?enum\s+(?P<n>\w+)"),
        ("type_alias", r"^(?P<in>\s*)(?:export\s+)?type\s+(?P<n>\w+)[^=]*="),
        ("function", r"^(?P<in>\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)"),
        ("function", r"^(?P<in>\s*)(?:export\s+)?const\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("method", r"^(?P<in>\s+)(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^{;]+)?\{\s*$"),
    ],
    "java": [
        ("class", r"^(?P<in>\s*)(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*class\s+(?P<n>\w+)"),
        ("interface", r"^(?P<in>\s*)(?:public\s+)?interface\s+(?P<n>\w+)"),
        ("enum", r"^(?P<in>\s*)(?:public\s+)?enum\s+(?P<n>\w+)"),
        ("method", r"^(?P<in>\s+)(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)+[\w<>\[\], ?]+\s+(?P<n>\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{"),
    ],
    "go": [
        ("struct", r"^(?P<in>)type\s+(?P<n>\w+)\s+struct"),
        ("interface", r"^(?P<in>)type\s+(?P<n>\w+)\s+interface"),
        ("method", r"^(?P<in>)func\s+\(\w+\s+\*?(?P<o>\w+)[^)]*\)\s+(?P<n>\w+)"),
        ("function", r"^(?P<in>)func\s+(?P<n>\w+)"),
    ],
}
_DEFS["javascript"] = _DEFS["tsx"] = _DEFS["jsx"] = _DEFS["typescript"]
_C_FUNCTION = ("function", r"^(?P<in>)(?!\s*(?:return|else|typedef|using|namespace)\b)(?:[\w:<>,*&~]+\s+)+[*&]*(?:(?P<o>\w+)::)?(?P<n>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{")
_DEFS["c"] = [("struct", r"^(?P<in>\s*)(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{?\s*$"), ("enum", r"^(?P<in>\s*)(?:typedef\s+)?enum\s+(?P<n>\w+)"), _C_FUNCTION]
_DEFS["cpp"] = [
    ("namespace", r"^(?P<in>\s*)namespace\s+(?P<n>\w+)\s*\{"),
    ("class", r"^(?P<in>\s*)(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)[^;]*$"),
    ("struct", r"^(?P<in>\s*)struct\s+(?P<n>\w+)[^;]*$"),
    ("enum", r"^(?P<in>\s*)enum\s+(?:class\s+)?(?P<n>\w+)"),
    ("method", r"^(?P<in>\s+)(?!return\b|else\b|if\b|for\b|while\b|switch\b)(?:(?:virtual|static|inline|explicit)\s+)*(?:[\w:<>,*&]+\s+)*[*&]*(?P<n>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{"),
    _C_FUNCTION,
]
_DEFS["rust"] = [
    ("struct", r"^(?P<in>\s*)(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"),
    ("enum", r"^(?P<in>\s*)(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"),
    ("trait", r"^(?P<in>\s*)(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
    ("impl", r"^(?P<in>\s*)impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)"),
    ("module", r"^(?P<in>\s*)(?:pub\s+)?mod\s+(?P<n>\w+)\s*\{"),
    ("function", r"^(?P<in>\s*)(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"C\"\s+)*fn\s+(?P<n>\w+)"),
]
_DEFS["kotlin"] = [
    ("interface", r"^(?P<in>\s*)(?:\w+\s+)*?interface\s+(?P<n>\w+)"),
    ("class", r"^(?P<in>\s*)(?:\w+\s+)*?(?:class|object)\s+(?P<n>\w+)"),
    ("function", r"^(?P<in>\s*)(?:\w+\s+)*?fun\s+(?:<[^>]*>\s*)?(?:(?P<o>\w+)\.)?(?P<n>\w+)\s*\("),
]
_DEFS["csharp"] = [
    ("namespace", r"^(?P<in>\s*)namespace\s+(?P<n>[\w.]+)"),
    ("interface", r"^(?P<in>\s*)(?:(?:public|internal|private|protected|partial)\s+)*interface\s+(?P<n>\w+)"),
    ("class", r"^(?P<in>\s*)(?:(?:public|internal|private|protected|static|sealed|abstract|partial)\s+)*(?:class|record)\s+(?P<n>\w+)"),
    ("struct", r"^(?P<in>\s*)(?:(?:public|internal|private|readonly)\s+)*struct\s+(?P<n>\w+)"),
    ("enum", r"^(?P<in>\s*)(?:(?:public|internal|private)\s+)*enum\s+(?P<n>\w+)"),
    ("method", r"^(?P<in>\s+)(?:(?:public|internal|private|protected|static|virtual|override|async|abstract|sealed)\s+)+[\w<>\[\],.? ]+\s+(?P<n>\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?:\{|=>|$)"),
]
_DEFS["swift"] = [
    ("protocol", r"^(?P<in>\s*)(?:\w+\s+)*?protocol\s+(?P<n>\w+)"),
    ("class", r"^(?P<in>\s*)(?:(?:public|open|final|private|internal|fileprivate)\s+)*(?:class|actor|extension)\s+(?P<n>\w+)"),
    ("struct", r"^(?P<in>\s*)(?:\w+\s+)*?struct\s+(?P<n>\w+)"),
    ("enum", r"^(?P<in>\s*)(?:\w+\s+)*?enum\s+(?P<n>\w+)"),
    ("function", r"^(?P<in>\s*)(?:@\w+\s+)*(?:\w+\s+)*?func\s+(?P<n>\w+)"),
]
_DEFS["php"] = [
    ("interface", r"^(?P<in>\s*)interface\s+(?P<n>\w+)"),
    ("trait", r"^(?P<in>\s*)trait\s+(?P<n>\w+)"),
    ("class", r"^(?P<in>\s*)(?:abstract\s+|final\s+)*class\s+(?P<n>\w+)"),
    ("function", r"^(?P<in>\s*)(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<n>\w+)"),
]
_DEFS["ruby"] = [("module", r"^(?P<in>\s*)module\s+(?P<n>[\w:]+)"), ("class", r"^(?P<in>\s*)class\s+(?P<n>[\w:]+)"), ("function", r"^(?P<in>\s*)def\s+(?:self\.)?(?P<n>\w+[?!]?)")]
_DEFS["scala"] = [("trait", r"^(?P<in>\s*)(?:sealed\s+)?trait\s+(?P<n>\w+)"), ("class", r"^(?P<in>\s*)(?:(?:final|sealed|abstract|case|implicit)\s+)*(?:class|object)\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)(?:(?:override|private|protected|final|implicit|inline)\s+)*def\s+(?P<n>\w+)")]
_DEFS["dart"] = [("class", r"^(?P<in>\s*)(?:abstract\s+)?(?:class|mixin|extension)\s+(?P<n>\w+)"), ("enum", r"^(?P<in>\s*)enum\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)(?:static\s+)?[\w<>?,\[\] ]+\s+(?P<n>\w+)\s*\([^;]*\)\s*(?:async\s*)?\{")]
_DEFS["lua"] = _DEFS["luau"] = [("function", r"^(?P<in>\s*)(?:local\s+)?function\s+(?:(?P<o>\w+)[.:])?(?P<n>\w+)")]
_DEFS["elixir"] = [("module", r"^(?P<in>\s*)defmodule\s+(?P<n>[\w.]+)"), ("function", r"^(?P<in>\s*)defp?\s+(?P<n>\w+[?!]?)")]
_DEFS["solidity"] = [("class", r"^(?P<in>\s*)(?:abstract\s+)?(?:contract|library)\s+(?P<n>\w+)"), ("interface", r"^(?P<in>\s*)interface\s+(?P<n>\w+)"), ("struct", r"^(?P<in>\s*)struct\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)(?:function|modifier)\s+(?P<n>\w+)")]
_DEFS["zig"] = [("struct", r"^(?P<in>\s*)(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*(?:extern\s+|packed\s+)?struct"), ("function", r"^(?P<in>\s*)(?:pub\s+)?(?:export\s+)?(?:inline\s+)?fn\s+(?P<n>\w+)")]
_DEFS["shell"] = _DEFS["bash"] = [("function", r"^(?P<in>\s*)(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{")]
_DEFS["objc"] = [("class", r"^(?P<in>\s*)@(?:interface|implementation)\s+(?P<n>\w+)"), ("protocol", r"^(?P<in>\s*)@protocol\s+(?P<n>\w+)[^;]*$"), ("function", r"^(?P<in>)[-+]\s*\([^)]*\)\s*(?P<n>\w+)")]
_DEFS["ocaml"] = [("module", r"^(?P<in>\s*)module\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)let\s+(?:rec\s+)?(?P<n>[a-z_]\w*)\s+[\w(~?]")]
_DEFS["rescript"] = [("module", r"^(?P<in>\s*)module\s+(?P<n>\w+)"), ("function", r"^(?P<in>\s*)let\s+(?:rec\s+)?(?P<n>\w+)\s*=\s*\(?[\w~,= ]*\)?\s*=>")]
_DEFS["cfml"] = _DEFS["cfscript"] = [("class", r"(?i)^(?P<in>\s*)(?:<cf)?component\b[^>{]*?(?:\bdisplayname\s*=\s*\"(?P<n>\w+)\")"), ("function", r"(?i)^(?P<in>\s*)(?:<cffunction\s+[^>]*?name\s*=\s*\"|(?:(?:public|private|remote|package)\s+)?(?:\w+\s+)?function\s+)(?P<n>\w+)")]
_DEFS["css"] = [("class", r"^(?P<in>\s*)\.(?P<n>[\w-]+)[^{};]*\{")]
_DEFS["toml"] = [("namespace", r"^(?P<in>)\[+(?P<n>[\w.\"-]+)\]+"), ("constant", r"^(?P<in>)(?P<n>[\w-]+)\s*=")]
#: Languages whose blocks are told by their indentation; fixed values.
_INDENTED = frozenset("python ruby lua luau elixir ocaml".split())
#: What a type is derived from, per language, in the line of its definition; fixed values.
_BASES = {
    "python": [("extends", r"class\s+\w+\s*\(([^)]*)\)")],
    "java": [("extends", r"\bextends\s+([\w.<>, ]+?)(?=\s+implements|\s*\{|$)"), ("implements", r"\bimplements\s+([\w.<>, ]+?)\s*(?:\{|$)")],
    "kotlin": [("extends", r"(?:class|object|interface)\s+\w+[^:{]*:\s*([^{]+)")],
    "csharp": [("extends", r"(?:class|record|struct|interface)\s+\w+[^:{]*:\s*([^{]+)")],
    "swift": [("extends", r"(?:class|struct|enum|extension|protocol|actor)\s+\w+[^:{]*:\s*([^{]+)")],
    "cpp": [("extends", r"(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*([^{]+)")],
    "ruby": [("extends", r"class\s+[\w:]+\s*<\s*([\w:]+)")],
    "rust": [("implements", r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b")],
    "solidity": [("extends", r"\bis\s+([\w, ]+)")],
}
for _l in ("typescript", "javascript", "tsx", "jsx", "php", "scala", "dart"):
    _BASES[_l] = _BASES["java"] if _l != "scala" else [("extends", r"\bextends\s+(\w+(?:\s+with\s+\w+)*)")]
_NEW = re.compile(r"\bnew\s+([A-Z]\w*(?:\.[A-Z]\w*)*)")
_DECORATOR = re.compile(r"^\s*@([A-Za-z_][\w.]*)")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function def class print super new await typeof sizeof func defer go elif with assert except lambda not and or in is".split())


def register(language: str, extractor: Extractor) -> None:
    REGISTRY[language] = extractor


def node_id(path: str, kind: str, name: str, line: int) -> str:
    return sha256(f"{path}:{kind}:{name}:{line}".encode()).hexdigest()


def _block_end(lines: list[str], k: int, language: str, indent: int) -> int:
    if language in _INDENTED:
        e = k
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                e = j
        return e
    depth, seen = 0, False
    for j in range(k, len(lines)):
        bare = re.sub(r"//.*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", "", lines[j])
        depth += bare.count("{") - bare.count("}")
        seen |= "{" in bare
        if seen and depth <= 0:
            return j
        if not seen and bare.rstrip().endswith(";"):
            return j
    return len(lines) - 1


def by_patterns(language: str) -> Extractor:
    rules = [(kind, re.compile(p)) for kind, p in _DEFS[language]]
    bases = [(kind, re.compile(p)) for kind, p in _BASES.get(language, [])]
    types = ("class", "interface", "struct", "trait", "protocol", "impl", "object")

    def extract(path: str, text: str) -> Iterator[dict]:
        lines = text.split("\n")
        file_id = node_id(path, "file", path, 1)
        yield {"tag": "node", "id": file_id, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "file_path": path, "language": language, "start_line": 1, "end_line": len(lines)}
        stack: list[tuple[int, str, str, str]] = []  # last line, id, name, kind
        spans = []
        for k, line in enumerate(lines):
            while stack and k > stack[-1][0]:
                stack.pop()
            for kind, rule in rules:
                m = rule.match(line)
                if not m or not m["n"] or m["n"] in _KEYWORDS:
                    continue
                owner = stack[-1] if stack else None
                if kind == "function" and (owner and owner[3] in types or m.groupdict().get("o")):
                    kind = "method"
                if kind == "method" and not owner and language not in ("go", "cpp", "lua", "luau", "kotlin"):
                    continue
                if kind == "impl":  # opens the scope of a type that is defined elsewhere
                    end = _block_end(lines, k, language, len(m["in"]))
                    for what, rule2 in bases:
                        if b := rule2.search(line):
                            yield {"tag": "ref", "kind": what, "name": b[1], "source": node_id(path, "file", path, 1), "line": k + 1, "file_path": path, "language": language}
                    stack.append((end, file_id, m["n"], kind))
                    break
                prefix = m.groupdict().get("o") or (owner[2] if owner else "")
                qualified = f"{prefix}::{m['n']}" if prefix else m["n"]
                end = _block_end(lines, k, language, len(m["in"]))
                i = node_id(path, kind, m["n"], k + 1)
                yield {"tag": "node", "id": i, "kind": kind, "name": m["n"], "qualified_name": qualified, "file_path": path, "language": language, "start_line": k + 1, "end_line": end + 1, "signature": line.strip().rstrip("{").strip()}
                yield {"tag": "edge", "kind": "contains", "source": owner[1] if owner else file_id, "target": i, "line": k + 1, "file_path": path}
                if kind in types:
                    head = line if language == "python" else re.sub(r"\([^()]*\)", "", line)
                    for what, rule2 in bases:
                        if b := rule2.search(head):
                            for name in re.split(r",|\bwith\b", re.sub(r"<[^>]*>|\([^)]*\)|\b(?:public|private|protected|virtual)\b|\w+\s*=[^,]*", "", b[1])):
                                if re.fullmatch(r"[\w.:]+", name.strip()):
                                    yield {"tag": "ref", "kind": what, "name": name.strip(), "source": i, "line": k + 1, "file_path": path, "language": language}
                j = k - 1
                while j >= 0 and (d := _DECORATOR.match(lines[j])):
                    yield {"tag": "ref", "kind": "decorates", "name": d[1], "source": i, "line": j + 1, "file_path": path, "language": language}
                    j -= 1
                spans.append((k, end, i))
                if end > k:
                    stack.append((end, i, qualified, kind))
                break
        for first, last, i in spans:
            inner = [(a, b) for a, b, _ in spans if first < a and b <= last]
            for k in range(first + 1, last + 1):
                if any(a <= k <= b for a, b in inner):
                    continue
                bare = re.sub(r"(?:#|//).*", "", lines[k])
                for m in _NEW.finditer(bare):
                    yield {"tag": "ref", "kind": "instantiates", "name": m[1], "source": i, "line": k + 1, "file_path": path, "language": language}
                for m in _CALL.finditer(bare):
                    if m[1] not in _KEYWORDS:
                        yield {"tag": "ref", "kind": "calls", "name": m[1], "source": i, "line": k + 1, "file_path": path, "language": language}

    return extract


for _language in _DEFS:
    register(_language, by_patterns(_language))


def extract(texts: DataFrame) -> DataFrame:
    """Tagged rows (node, edge, ref, error) of texts (path, language, text); languages without extractor give a file node only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows: list[dict] = []
            for p, g, t in zip(b["path"], b["language"], b["text"]):
                try:
                    if g in REGISTRY:
                        rows += REGISTRY[g](p, t)
                    else:
                        rows.append({"tag": "node", "id": node_id(p, "file", p, 1), "kind": "file", "name": p.rsplit("/", 1)[-1], "qualified_name": p, "file_path": p, "language": g, "start_line": 1, "end_line": t.count("\n") + 1})
                except Exception as e:
                    rows.append({"tag": "error", "name": type(e).__name__, "file_path": p})
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.where(out.notna(), None)

    return texts.where("text is not null").select("path", "language", "text").mapInPandas(run, SCHEMA)


#: Framework rules: (framework, languages, pattern, method group, route group, handler group); a route node and a reference to its handler for each match.
FRAMEWORKS = [
    ("express", ("javascript", "typescript"), r"\b(?:app|router)\.(get|post|put|patch|delete|all|use)\(\s*['\"`]([^'\"`]+)['\"`]\s*,\s*(?:[\w.]+\s*,\s*)*([\w.]+)", 1, 2, 3),
    ("nestjs", ("typescript",), r"@(Get|Post|Put|Patch|Delete)\(\s*['\"]?([^'\")]*)['\"]?\s*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?(\w+)\s*\(", 1, 2, 3),
    ("react-router", ("javascript", "typescript", "tsx", "jsx"), r"<(Route)\b[^>]*\bpath=['\"]([^'\"]+)['\"][^>]*\b(?:element=\{<|component=\{)(\w+)", 1, 2, 3),
    ("flask", ("python",), r"@\w+\.(route)\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?def\s+(\w+)", 1, 2, 3),
    ("fastapi", ("python",), r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*(?:@[^\n]*\s*)*(?:async\s+)?def\s+(\w+)", 1, 2, 3),
    ("django", ("python",), r"\b(path|re_path|url)\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*([\w.]+)", 1, 2, 3),
    ("spring", ("java", "kotlin"), r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"][^)]*\)\s*(?:@[^\n]*\s*)*(?:public\s+)?[\w<>\[\], ]+\s+(\w+)\s*\(", 1, 2, 3),
    ("go-web", ("go",), r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc|Handle)\(\s*\"([^\"]+)\"\s*,\s*(?:[\w.]+\s*,\s*)*([\w.]+)", 1, 2, 3),
    ("laravel", ("php",), r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?['\"]?([\w\\@:]+)", 1, 2, 3),
    ("rails", ("ruby",), r"\b(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]\s*(?:,\s*to:|=>)\s*['\"]([\w/#]+)", 1, 2, 3),
    ("aspnet", ("csharp",), r"\[Http(Get|Post|Put|Patch|Delete)\(?\"?([^\"\])]*)\"?\)?\]\s*(?:\[[^\n]*\]\s*)*public\s+[\w<>\[\], ]+\s+(\w+)\s*\(", 1, 2, 3),
    ("rust-web", ("rust",), r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]+)\"[^)]*\)\]\s*(?:pub\s+)?async\s+fn\s+(\w+)", 1, 2, 3),
    ("axum", ("rust",), r"\.(route)\(\s*\"([^\"]+)\"\s*,\s*\w+\(\s*([\w:]+)", 1, 2, 3),
    ("vue-router", ("javascript", "typescript"), r"\{\s*(path):\s*['\"]([^'\"]+)['\"][^}]*?\bcomponent:\s*(?:\(\)\s*=>\s*import\(['\"])?([\w./@-]+)", 1, 2, 3),
    ("react-hooks", ("javascript", "typescript", "tsx", "jsx"), r"\{\s*(path):\s*['\"]([^'\"]+)['\"]\s*,\s*element:\s*<(\w+)", 1, 2, 3),
    ("drupal", ("yaml", "unknown"), r"(?m)^\s+(path):\s*['\"]([^'\"]+)['\"]\s*\n\s+defaults:\s*\n(?:\s+[\w_]+:[^\n]*\n)*?\s+_(?:controller|form):\s*['\"]?([\w\\\\:]+)", 1, 2, 3),
    ("goframe", ("go",), r"\bgroup\.(GET|POST|PUT|PATCH|DELETE|ALL|Bind)\(\s*\"?([^\",)]*)\"?\s*,?\s*([\w.]*)", 1, 2, 3),
    ("swiftui", ("swift",), r"(NavigationLink|Tab)\((?:\"([^\"]*)\")?[^)]*?destination:\s*(\w+)", 1, 2, 3),
    ("react-native", ("javascript", "typescript", "tsx", "jsx"), r"<(?:\w+\.)(Screen)\b[^>]*\bname=['\"]([^'\"]+)['\"][^>]*\bcomponent=\{(\w+)", 1, 2, 3),
    ("fabric", ("typescript", "tsx"), r"(codegenNativeComponent|TurboModuleRegistry\.\w+)(?:<[^>]*>)?\(\s*['\"](\w+)['\"]\s*()", 1, 2, 3),
    ("nest-messages", ("typescript",), r"@(MessagePattern|EventPattern|SubscribeMessage|Query|Mutation)\(\s*['\"]?([^'\")]*)['\"]?[^)]*\)\s*(?:async\s+)?(\w+)\s*\(", 1, 2, 3),
    ("play", ("scala", "properties", "unknown"), r"(?m)^(GET|POST|PUT|PATCH|DELETE)\s+(/\S*)\s+([\w.]+)", 1, 2, 3),
]


def framework_routes(texts: DataFrame) -> DataFrame:
    """(framework, path, method, route, handler): routes that the framework rules find in texts (path, language, text); all in the JVM."""

    def routes(name: str, pattern: str, *groups: int):
        method, route, handler = (F.regexp_extract_all("text", F.lit(pattern), g).alias(k) for g, k in zip(groups, ("method", "route", "handler")))
        return F.transform(F.arrays_zip(method, route, handler), lambda x: F.struct(F.lit(name).alias("framework"), x["method"].alias("method"), x["route"].alias("route"), x["handler"].alias("handler")))

    found = [F.when(F.col("language").isin(*languages), routes(name, pattern, *groups)) for name, languages, pattern, *groups in FRAMEWORKS]
    return texts.select("path", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("m")).select("m.framework", "path", "m.method", "m.route", "m.handler")


#: Folders whose files are pages, with the endings that count, per framework; fixed values.
PAGES = [("nuxt", r"(?:^|/)pages/(.+)\.vue$"), ("sveltekit", r"(?:^|/)src/routes/(.*?)/?\+(?:page|server)\.(?:svelte|ts|js)$"), ("astro", r"(?:^|/)src/pages/(.+)\.(?:astro|md|mdx)$"), ("next", r"(?:^|/)(?:src/)?pages/(.+)\.(?:tsx|jsx)$")]


def page_routes(paths: DataFrame) -> DataFrame:
    """(framework, path, route) of files that are pages by their place; `index` is the folder, `[x]` a parameter."""
    out = F.lit(None).cast("struct<framework:string,route:string>")
    for name, pattern in reversed(PAGES):
        out = F.when(F.col("path").rlike(pattern), F.struct(F.lit(name).alias("framework"), F.regexp_extract("path", pattern, 1).alias("route"))).otherwise(out)
    route = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("m.route"), r"(^|/)\([^)]*\)", "$1"), r"(^|/)index$", "$1"), r"\[(?:\.\.\.)?(\w+)\]", ":$1")
    return paths.withColumn("m", out).where("m is not null").select("m.framework", "path", F.concat(F.lit("/"), F.regexp_replace(route, "^/+|/+$", "")).alias("route"))


def code_chunks(texts: DataFrame, size: int = 81, overlap: int = 5, max_bytes: int = 256_000) -> DataFrame:
    """(id, path, symbol_name, node_kind, parent_name, start_line, end_line, content, signature) of texts (path, language, text).

    One chunk for every definition; files without definitions are cut into
    overlapping windows of lines. Texts over max_bytes are skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "path", "symbol_name", "node_kind", "parent_name", "start_line", "end_line", "content", "signature"]
        for b in batches:
            rows = []
            for p, g, t in zip(b["path"], b["language"], b["text"]):
                lines = t.split("\n")
                defs = [r for r in REGISTRY[g](p, t) if r["tag"] == "node" and r["kind"] != "file"] if g in REGISTRY else []
                for k, r in enumerate(defs):
                    owner = r["qualified_name"].rpartition("::")[0] or None
                    rows.append((f"{p}::{k}", p, r["name"], r["kind"], owner, r["start_line"], r["end_line"], "\n".join(lines[r["start_line"] - 1 : r["end_line"]]), r["signature"]))
                if not defs:
                    at, k = 0, 0
                    while True:
                        end = min(at + size, len(lines))
                        rows.append((f"{p}::{k}", p, None, "window", None, at + 1, end, "\n".join(lines[at:end]), None))
                        if end == len(lines):
                            break
                        at, k = end - overlap, k + 1
            yield pd.DataFrame(rows, columns=names, dtype=object)

    kinds = "id string, path string, symbol_name string, node_kind string, parent_name string, start_line int, end_line int, content string, signature string"
    return texts.where(f"text is not null and octet_length(text) <= {max_bytes}").select("path", "language", "text").mapInPandas(run, kinds)
