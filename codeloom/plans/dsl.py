"""The search query language: kind:, lang:/language:, path:, name:, quotes and free text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.functions.constants import LANGUAGE_BY_EXTENSION, NODE_KINDS

LANGUAGES = frozenset(LANGUAGE_BY_EXTENSION.values())


@dataclass
class Query:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse(raw: str, strict: bool = False) -> Query:
    """Filters and text of a query.

    Fields are `field:value`, values may be quoted and, unless strict, comma
    lists. Unknown kinds (strict: unknown languages as well) stay text; so do
    unknown fields.
    """
    q, words = Query(), []
    for m in re.finditer(r'(\w+):"([^"]*)"|"([^"]*)"?|(\S+)', raw):
        name, quoted, plain, token = m.groups()
        if plain is not None:
            words.append(plain)
            continue
        if name is None:
            name, colon, quoted = token.partition(":")
            if not colon or not quoted:
                words.append(token)
                continue
        values = [quoted] if strict else [v for v in quoted.split(",") if v]
        target = {"kind": q.kinds, "lang": q.languages, "language": q.languages, "path": q.paths, "name": q.names}.get(name.lower())
        if target is None:
            words.append(m[0])
            continue
        for v in values:
            if target is q.kinds and v not in NODE_KINDS or strict and target is q.languages and v not in LANGUAGES:
                words.append(v)
            else:
                target.append(v)
    q.text = " ".join(w for w in words if w).strip()
    return q
