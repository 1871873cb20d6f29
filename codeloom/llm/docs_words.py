"""Does a documentation comment say anything?"""

from __future__ import annotations

import re

#: Marks of comments and ornaments at either end of a line.
_MARKS = re.compile(r"^[\s/*#;!\-=~_+.<>|`'\"]+|[\s/*#\-=~_+<>|`'\"]+$")
#: Tags after whose name a description may follow; fixed values.
_NAMED_TAGS = re.compile(r"^[@\\:](?:param|parameter|arg|argument|keyword|key|var|ivar|cvar|attr|attribute|property|prop|throws|exception|raises?|template|typeparam|tparam|field)\b(?:\s*\{[^}]*\})?\s*\[?[\w.$*&=]*\]?\s*:?\s*[-:]?\s*")
_TAGS = re.compile(r"^[@\\:](?:returns?|rtype|return|yields?|deprecated|summary|brief|details?|description|desc|note|remarks?|todo|example)\b:?(?:\s*\{[^}]*\})?\s*[-:]?\s*")
_EMPTY_TAGS = re.compile(r"^(?:\{?[@\\][\w-]+\}?|:\w+:).*$")
_MARKUP = re.compile(r"\{@\w+[^}]*\}|</?[a-zA-Z][^>]*>")
#: Directives to tools; fixed values.
_DIRECTIVE = re.compile(
    r"(?i)^(?:nolint\b.*|noqa\b.*|nosonar|nosec\b.*|pragma:?\s.*|eslint-(?:disable|enable)\S*.*|istanbul ignore.*|c8 ignore.*|v8 ignore.*|coverage:ignore.*|prettier-ignore.*|tslint:.*|jshint .*|jslint .*|type:\s*ignore.*|ts-(?:ignore|nocheck|expect-error).*|pylint:.*|mypy:.*|flake8:.*|isort:.*|fmt:\s*(?:on|off|skip)|yapf:.*|ruff:.*|pyright:.*|black:.*|go:\w+.*|\+build.*|checkstyle:.*|suppress\w*.*|noinspection.*|cspell:.*|spell-?checker:.*|lint:.*|clang-format (?:on|off)|region\b.*|endregion\b.*|vim?:.*|-\*-.*-\*-)$"
)
#: Notes that documentation is missing, in the languages of the texts; fixed values.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(?:todo|fixme|xxx|hack|tbd|tba|wip)(?:\s*\([^)]*\))?(?:\s*[:\-]?\s*(?:add|write|fill in|complete|improve|insert|document|update|need|needs|missing)?\s*(?:the|a|some)?\s*(?:docs?|docstrings?|documentation|descriptions?|comments?|javadoc|jsdoc|this|me|it|here)?)?"
    r"|(?:add|insert|enter|write|put|missing|no|empty|your|method|function|class|short|brief|the|a|undocumented)?\s*(?:a|the|your|method|function|class)?\s*(?:descriptions?|documentation|docs?|docstrings?|comments?|summary|javadoc)(?:\s*(?:goes|go)\s*here|\s*here|\s*(?:is\s*)?missing|\s*needed|\s*pending|\s*to be (?:added|written|done)|\s*to do|\s*to come|\s*available|\s*provided)?"
    r"|undocumented|not documented(?: yet)?|to be (?:documented|done|written)|placeholder|stub|auto-?generated (?:method|function|constructor|class)? ?(?:stub|documentation|docs?|comment)?|lorem ipsum.*|n/?a|none|null|nil|foo|bar|asdf|blah"
    r"|(?:die |eine )?(?:beschreibung|dokumentation|kommentar)(?: fehlt| folgt| hier| einfügen| ergänzen)?|(?:noch )?(?:keine|ohne) (?:beschreibung|dokumentation)|platzhalter|nicht dokumentiert"
    r"|(?:нет |добавить |без |отсутствует |здесь )?(?:описани[ея]|документаци[яи]|комментари[йя])(?: отсутствует| позже| здесь)?|заглушка|не документировано|сделать"
    r"|(?:sin |falta |faltan |agregar |añadir |pendiente de )?(?:la )?(?:descripción|documentación|documentar|comentario)(?: pendiente| aquí)?|pendiente|por documentar|por hacer"
    r"|未记录|待补充|待完善|待写|无描述|暂无(?:描述|说明|文档|注释)?|没有(?:描述|说明|文档|注释)|无(?:说明|文档|注释)|(?:在此)?(?:添加|补充)(?:描述|说明|文档|注释)|描述|说明|占位(?:符)?"
    r"|未記載|説明(?:なし|文|未記入)?|(?:ドキュメント|説明|コメント)(?:を(?:追加|書く|記入)|は?ありません|なし)|後で(?:書く|追加)|要説明|未定|仮"
    r"|कोई विवरण नहीं|विवरण(?: नहीं| जोड़ें| लंबित)?|टिप्पणी|ไม่มีคำอธิบาย|(?:ใส่|เพิ่ม|รอ)?คำอธิบาย(?:ที่นี่)?)[\s.!?…。:]*$"
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
#: Words that add nothing to a name; fixed values.
_STOP = frozenset(
    "a an the this that these those of to for in on at by with from and or is are be it its as into up out function functions method methods class constructor helper procedure routine operation implementation implements does do performs perform executes execute runs run called calls der die das ein eine den dem des und".split()
)


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    w = w[:-1] + "i" if w.endswith("y") and len(w) > 3 else w
    if w.endswith("e") and len(w) > 3:
        w = w[:-1]
    if len(w) > 4 and w[-1] == w[-2]:
        w = w[:-1]
    return w


def clean(doc: str) -> list[str]:
    """The lines of a comment without marks, ornaments, tags, directives and placeholders."""
    out = []
    for line in doc.splitlines():
        line = _MARKS.sub("", line.strip())
        if not line:
            continue
        if line[0] in "@\\:{":
            line = re.sub(r"^\{(@\w+)\}$", r"\1", line)
            for tag in (_NAMED_TAGS, _TAGS):
                if m := tag.match(line):
                    line = line[m.end() :]
                    break
            else:
                line = _EMPTY_TAGS.sub("", line)
        line = _MARKUP.sub(" ", line).strip()
        line = _MARKS.sub("", line)
        if not line or _DIRECTIVE.match(line) or _PLACEHOLDER.match(line):
            continue
        out.append(line)
    return out


def says_something(doc: str | None, name: str | None) -> bool:
    """False for null or blank text, marks only, placeholders, bare tags and directives, and words that only repeat the name."""
    if not doc:
        return False
    lines = clean(doc)
    words = _WORD.findall(" ".join(lines))
    if not words:
        return False
    if _PLACEHOLDER.match(" ".join(lines)):
        return False
    own = {_stem(p) for p in _CAMEL.findall(name or "")}
    whole = _stem((name or "").replace("_", ""))
    for w in words:
        parts = _CAMEL.findall(w) or [w]
        if w.lower() in _STOP or _stem(w) == whole or all(p.lower() in _STOP or _stem(p) in own for p in parts):
            continue
        return True
    return False
