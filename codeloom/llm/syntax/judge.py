"""Which grammars take a text."""

from __future__ import annotations

import ast
import json
import logging
import re
import symtable
import sys
import warnings
from collections import Counter

from codeloom.llm.syntax.golang import check_go
from codeloom.llm.syntax.java import check_java
from codeloom.llm.syntax.lexing import Bad
from codeloom.llm.syntax.script import check_javascript, check_typescript


_LOG = logging.getLogger(__name__)


class Undecided(Exception):
    """A limit of the parser, not the grammar, stopped it."""


#: How the interpreter's parser reports limits of its own; fixed values.
_LIMITS = ("too many nested parentheses", "too many levels of indentation", "too many statically nested blocks")


def check_python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(text, "<text>", "exec")  # parses without making a tree of Python objects
        except SyntaxError as e:
            if str(e.msg).startswith(_LIMITS):
                raise Undecided(e.msg) from None
            ast.parse(text)  # scoping rules are no matter of syntax
        except RecursionError:
            pass  # the parser took it; only the walk over its very deep tree failed
        except MemoryError:
            raise Undecided("parser stack") from None


def _no_constant(name: str):
    raise ValueError(name)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[{])|([\]}])|(,)|(:)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|((?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))|($))')


def check_deep_json(text: str) -> None:
    """JSON with a stack of its own, for any depth of nesting."""
    stack: list[str] = []
    at, want = 0, "value"  # or: first (value or end), key, first key, colon, next (comma or end), end
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ValueError("token")
        at, kind = m.end(), m.lastindex
        if kind == 7:
            if want == "end":
                return
            raise ValueError("end")
        if kind == 2:
            if not stack or stack.pop() != ("[" if m[2] == "]" else "{") or want not in ("first", "first key", "next"):
                raise ValueError("bracket")
            want = "next" if stack else "end"
        elif kind == 3:
            if want != "next":
                raise ValueError("comma")
            want = "value" if stack[-1] == "[" else "key"
        elif kind == 4:
            if want != "colon":
                raise ValueError("colon")
            want = "value"
        elif want in ("key", "first key"):
            if kind != 5:
                raise ValueError("key")
            want = "colon"
        elif want not in ("value", "first"):
            raise ValueError("value")
        elif kind == 1:
            stack.append(m[1])
            want = "first" if m[1] == "[" else "first key"
        else:
            want = "next" if stack else "end"


def check_json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        check_deep_json(text)


GRAMMARS = {
    "python": check_python,
    "javascript": check_javascript,
    "typescript": check_typescript,
    "java": check_java,
    "go": check_go,
    "json": check_json,
}
#: Words and signs that speak for a language; fixed values.
_SIGNS = {
    "python": "def class elif with from import async self None True False pass lambda",
    "javascript": "const let var function require module => === async class",
    "typescript": "interface export readonly implements import string number boolean void any const let function => === class",
    "java": "public private protected final void String package import class new",
    "go": "func package defer chan range type struct := nil",
    "json": "true false null \":",
}
_SPEAKS: dict[str, list[str]] = {}
for _language, _words in _SIGNS.items():
    for _w in _words.split():
        _SPEAKS.setdefault(_w, []).append(_language)
_SIGN = re.compile(r"\b(?:" + "|".join(w for w in _SPEAKS if w.isalpha()) + r")\b|:=|=>|===|\":")


#: Frames that a parser may use: calls between Python functions take heap, no C stack.
_FRAMES = 3_000_000


def valid(text: str, language: str) -> bool | None:
    """Whether the language's grammar takes the whole text; None for a language without grammar and where a limit or fault of the parser leaves it open.

    Blank text is valid but in JSON and Go. Depth of nesting is no limit: a parser
    that runs out of frames is run again with as many as memory holds.
    """
    check = GRAMMARS.get(language)
    if check is None:
        return None
    try:
        check(text)
        return True
    except (Bad, SyntaxError, ValueError):
        return False
    except RecursionError:
        limit = sys.getrecursionlimit()
        if limit >= _FRAMES:
            return None
        sys.setrecursionlimit(_FRAMES)
        try:
            return valid(text, language)
        finally:
            sys.setrecursionlimit(limit)
    except (Undecided, MemoryError, OverflowError):
        return None
    except Exception as e:  # a fault of ours must not call a file broken, nor end the run
        _LOG.warning("%s parser: %s", language, type(e).__name__)
        return None


def rank(text: str) -> list[str]:
    """Languages by how often their signs occur, a sign of several counting less for each; the likeliest first."""
    score = dict.fromkeys(GRAMMARS, 0.0)
    for sign, n in Counter(_SIGN.findall(text)).items():
        own = _SPEAKS[sign]
        for k in own:
            score[k] += n / len(own)
    return sorted(score, key=lambda k: (-score[k], k))


def readings(text: str) -> tuple[list[str], list[str]]:
    """(languages whose grammar takes the text, languages left open), the likeliest by its tokens first.

    Every text is parsed against every grammar. None takes it: it is corrupt;
    another than its own takes it: it has the wrong extension.
    """
    takes, unsure = [], []
    for k in rank(text):
        v = valid(text, k)
        if v:
            takes.append(k)
        elif v is None:
            unsure.append(k)
    return takes, unsure


def diagnose(text: str, language: str) -> tuple[bool | None, str | None]:
    """(valid in its language, the likeliest other language that takes it where its own does not)."""
    if language not in GRAMMARS:
        return None, None
    takes, unsure = readings(text)
    ok = True if language in takes else None if language in unsure else False
    return ok, (takes[0] if takes and ok is False and text.strip() else None)
