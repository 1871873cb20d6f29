"""From source text to a string with one character per token, and the parser base that walks it.

A token string keeps single-character punctuators as they are; words,
literals and longer operators get one character each. Line starts are kept
beside it, for languages in which a line break can end a statement.
"""

from __future__ import annotations

from bisect import bisect_left

import re

END = "\0"
ID, NUM, STR, TPL, RGX = "i", "n", "s", "t", "r"
_OPEN = {")": "(", "]": "[", "}": "{"}
_BRACKETS = re.compile(r"[()\[\]{}]")


WORD = re.compile(r"(?:[^\W\d]|\$)[\w$]*|\.?\d[\w.]*(?:(?<=[0-9.][eEpP])[+-]\d+)?|#(?:[^\W\d]|\$)[\w$]*")


class Bad(Exception):
    """The text is not in the language."""


def word_coder(words: dict[str, str], number: re.Pattern):
    """Maps a WORD match to its character; a number of wrong form is Bad. Remembers up to 100,000 spellings."""
    seen = dict(words)

    def code(m) -> str:
        w = m[0]
        c = seen.get(w)
        if c is None:
            c = ID
            if w[0] in ".0123456789":
                if not number.fullmatch(w):
                    raise Bad("number")
                c = NUM
            if len(seen) > 100_000:
                seen.clear()
                seen.update(words)
            seen[w] = c
        return c

    return code


class Alphabet:
    """Characters for the keywords and operators of one language."""

    def __init__(self, words: str, operators: str) -> None:
        self.of: dict[str, str] = {}
        for k, w in enumerate(words.split() + operators.split()):
            self.of[w] = chr(0xE000 + k)
        self.words = {w: self.of[w] for w in words.split()}
        ops = sorted(operators.split(), key=len, reverse=True)
        self.op_pattern = re.compile("|".join(map(re.escape, ops)))
        self.ops = {w: self.of[w] for w in ops}

    def set(self, names: str) -> frozenset[str]:
        return frozenset(self.of.get(w, w) for w in names.split())


def match_brackets(s: str) -> dict[int, int]:
    """Position of the closing bracket for each opening one."""
    out, stack = {}, []
    for m in _BRACKETS.finditer(s):
        c = m[0]
        if c in _OPEN:
            if not stack or s[stack[-1]] != _OPEN[c]:
                raise Bad("bracket")
            out[stack.pop()] = m.start()
        else:
            stack.append(m.start())
    if stack:
        raise Bad("bracket")
    return out


class Tokens:
    """A token string, its line starts (sorted) and its brackets."""

    __slots__ = ("s", "starts", "closing")

    def __init__(self, lines: list[str]) -> None:
        starts, at, kept = [], 0, []
        for line in lines:
            if line:
                starts.append(at)
                at += len(line)
                kept.append(line)
        self.s = "".join(kept)
        self.starts = starts
        self.closing = match_brackets(self.s)
        self.s += END


class Parser:
    """Recursive descent over a token string.

    Statements that fill a line are looked up by their token string in a
    bounded memo that all files share: source text repeats few shapes.
    """

    MEMO_LIMIT = 200_000

    def __init__(self, tokens: Tokens) -> None:
        self.s = tokens.s
        self.closing = tokens.closing
        self.starts = tokens.starts
        self.first = dict.fromkeys(tokens.starts)
        self.p = 0

    def fail(self, what: str = "") -> None:
        raise Bad(f"{what} at token {self.p}")

    def need(self, c: str) -> None:
        if self.s[self.p] != c:
            self.fail(f"no {c!r}")
        self.p += 1

    def take(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def line_before(self) -> bool:
        return self.p in self.first

    def line_end(self) -> int:
        k = bisect_left(self.starts, self.p + 1)
        return self.starts[k] if k < len(self.starts) else len(self.s) - 1

    def attempt(self, rule) -> bool:
        """Run a rule; on failure go back."""
        at = self.p
        try:
            rule()
            return True
        except Bad:
            self.p = at
            return False
