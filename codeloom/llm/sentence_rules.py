"""Sentence ends of a text: a pushdown automaton over quotations, brackets and list levels."""

from __future__ import annotations

import re
from bisect import bisect_left

#: Abbreviations after which a sentence always goes on, by language, as they are written without case; fixed values.
NEVER_END = """
dr mr mrs ms prof sr jr st rev hon gen col capt lt sgt e.g i.e vs cf viz al approx ca resp incl excl
z. b d. h u. a o. ä i. d. r s. o s. u v. a bzw ggf evtl bspw zzgl inkl vgl hr fr frau dr dipl ing
т. е т. к т. н т. п см ср напр им проф гр ул стр
sra sr srta dra ud uds p. ej a. m p. m ee. uu
श्री डॉ प्रो
""".split("\n")
#: Abbreviations of which only a number makes a sentence go on; fixed values.
BEFORE_NUMBER = "no nos nr fig figs vol ch sec eq p pp art abs abb kap рис табл гл п пп № pág págs núm cap नं सं क्र".split()
#: Abbreviations that may end a sentence: it goes on unless a capital letter follows; fixed values.
MAY_END = "etc|p.m|a.m|inc|ltd|co|corp|usw|etc|u. s. w|usf|т. д|т. п|г|гг|в|вв|руб|тыс|млн|др|пр|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec".split("|")
#: Months after an ordinal number; fixed values.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: Verbs of speech that follow a quotation; fixed values.
SPEECH = frozenset("asked said says replied answered wrote added noted sagte fragte rief meinte schrieb antwortete спросил спросила сказал сказала ответил ответила написал dijo preguntó respondió".split())


class Trie:
    """Abbreviations by their letters from the end, so that the text before a full stop is walked backwards."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, kind: str) -> None:
        at = self.root
        for c in reversed(word):
            at = at.setdefault(c, {})
        at.setdefault("", kind)

    def find(self, text: str, end: int, start: int) -> str | None:
        """Kind of the longest abbreviation that ends at `end` and begins a word."""
        at, k, found = self.root, end, None
        while True:
            if "" in at and (k == start or not (text[k - 1].isalnum() or text[k - 1] in "_'’-")):
                found = at[""]
            if k == start:
                return found
            c = text[k - 1].lower()
            if c.isspace():
                c = " "
            if c not in at:
                return found
            at = at[c]
            k -= 1


TRIE = Trie()
for _line in NEVER_END:
    # words stand alone, pairs such as `z. b` are kept together
    for _w in re.findall(r"\w{1,3}\. \w+(?:\. \w+)?|\S+", _line):
        TRIE.add(_w, "never")
for _w in BEFORE_NUMBER:
    TRIE.add(_w, "number")
for _w in MAY_END:
    TRIE.add(_w, "may")

_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‹": "›", "《": "》"}
_CLOSE = frozenset("”»」』)）]】›》“\"'’")
_BRACKETS = frozenset(")）]】")
_WIDE = frozenset("。！？｡．")
_STOPS = ".!?…。！？｡।॥۔؟"
_EVENT = re.compile(r"`[^`]*`|[.!?…。！？｡।॥۔؟]+|[“”„«»「」『』()（）\[\]【】‹›《》\"]|(?<=[ก-๛])\s+(?=[^\W\d_])")
_ITEM = re.compile(r"\s*(?:[-*+•‣▪]\s+|(\d{1,4})[.)]\s+|\[[ xX]\]\s)")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_RULE = re.compile(r"\s*(?:[-=*_]\s*){3,}$")
_FENCE = re.compile(r"\s*(```+|~~~+)")


def _indent(line: str) -> int:
    wide = line.expandtabs(4)
    return len(wide) - len(wide.lstrip())


def blocks(text: str):
    """(begin, end, whole): paragraphs, and headings, list items and fenced lines, which are whole units.

    Open list levels are a stack of (indentation, number), number 0 for a
    bullet: an item goes on at any open level, closing those below it, or
    opens a deeper one at 1.
    """
    at, begin, kind, number, fence = 0, None, "", 0, None
    levels: list[tuple[int, int]] = []
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        here, at = at, at + len(line)
        if fence:
            if bare:
                yield here, at, True
            if bare.startswith(fence):
                fence = None
            continue
        if not bare:
            if begin is not None:
                yield begin, here, kind == "item"
                begin = None
            kind = ""
            continue
        f = _FENCE.match(line)
        if f:
            if begin is not None:
                yield begin, here, kind == "item"
                begin = None
            kind, fence = "", f[1]
            yield here, at, True
            continue
        if _HEADING.match(line):
            if begin is not None:
                yield begin, here, kind == "item"
                begin = None
            kind = ""
            yield here, at, True
            continue
        m = _ITEM.match(line)
        if m and begin is not None and m[1]:
            # inside a paragraph only a list that starts at 1 after a finished sentence; inside a list only the next number
            n, deep = int(m[1]), _indent(line)
            if kind == "item":
                goes_on = any(i == deep and (k == 0 or n == k + 1 or n == k == 1) for i, k in levels)
                if number and n != number + 1 and not goes_on and not (n == 1 and deep > levels[-1][0]):
                    m = None
            elif n != 1 or text[:here].rstrip()[-1:] not in _STOPS + ":：":
                m = None
        if m:
            if begin is not None:
                yield begin, here, kind == "item"
            begin, kind, number = here, "item", int(m[1] or 0)
            deep = _indent(line)
            while levels and levels[-1][0] >= deep:
                levels.pop()
            levels.append((deep, number))
            continue
        if begin is None:
            begin, kind, levels = here, "text", []
    if begin is not None:
        yield begin, len(text), kind == "item"


def _next_word(text: str, k: int, end: int) -> str:
    j = k
    while j < end and (text[j].isalnum() or text[j] in "_'’.-"):
        j += 1
    return text[k:j]


def paragraph(text: str, begin: int, end: int, emit) -> None:
    """Walk one paragraph; emit(offset) at each sentence end but the last."""
    stack: list[tuple[str, int]] = []
    start = begin
    while start < end and text[start].isspace():
        start += 1
    k = start
    events = list(_EVENT.finditer(text, begin, end))
    # a quotation that never closes is no level
    dangling, open_at = set(), []
    for n, m in enumerate(events):
        c = m[0]
        if len(c) == 1 and (c in _OPEN or c in _CLOSE):
            if open_at and (c == open_at[-1][0]):
                open_at.pop()
            elif c == '"':
                open_at.append(('"', n))
            elif c in _OPEN:
                open_at.append((_OPEN[c], n))
            else:
                hit = next((i for i in range(len(open_at) - 1, -1, -1) if open_at[i][0] == c), None)
                if hit is None:
                    dangling.add(n)
                else:
                    dangling.update(x for _, x in open_at[hit + 1 :])
                    del open_at[hit:]
    dangling.update(x for _, x in open_at)
    for n, m in enumerate(events):
        c, at = m[0], m.start()
        if at < k:
            continue
        if c[0] == "`":
            continue
        if c[0].isspace():
            if not stack:
                emit(at)
                start = k = m.end()
            continue
        if c[0] not in _STOPS:
            if n in dangling:
                continue
            if stack and c == stack[-1][0]:
                opened = stack.pop()[1]
                inner = text[at - 1] in _STOPS
                after = m.end()
                if inner and not stack and _closes(text, after, end, opened <= start, c):
                    after = _swallow(text, after, end)
                    emit(after)
                    start = _skip(text, after, end)
                    k = start
            elif c == '"':
                stack.append(('"', at))
            elif c in _OPEN:
                stack.append((_OPEN[c], at))
            continue
        if stack:
            continue
        after = m.end()
        if _ends(text, start, at, after, end, c):
            after = _swallow(text, after, end)
            emit(after)
            start = k = _skip(text, after, end)


def _skip(text: str, k: int, end: int) -> int:
    while k < end and text[k].isspace():
        k += 1
    return k


def _swallow(text: str, k: int, end: int) -> int:
    """Past closing marks and further terminators."""
    while k < end and (text[k] in _STOPS or text[k] in "”»」』)）]】›》'’" or text[k] == '"' and (k + 1 == end or not text[k + 1].isalnum())):
        k += 1
    return k


def _closes(text: str, after: int, end: int, whole: bool, mark: str) -> bool:
    """A quotation or bracket with a terminator inside has closed: does the sentence end with it?

    whole: it had opened the sentence.
    """
    j = _swallow(text, after, end)
    if j >= end:
        return True
    k = _skip(text, j, end)
    if k >= end:
        return True
    nxt = text[k]
    if k == j:  # no blank: scripts without spaces go on, but for another opening mark
        return mark in "」』”》" and nxt in "「『“《" and not whole
    if mark in _BRACKETS and whole:
        return True
    if nxt in ",;:—–-，、；：":
        return False
    if whole and mark not in _BRACKETS:
        word = _next_word(text, k, end)
        if word.lower() in SPEECH:
            return False
        return not (nxt.islower() and word.isalpha() and word == word.lower())
    if not whole and mark in _BRACKETS:
        return not nxt.islower()
    return True


def _ends(text: str, start: int, at: int, after: int, end: int, stops: str) -> bool:
    """A terminator outside quotations and brackets: does the sentence end?"""
    if stops[0] in _WIDE or stops[0] in "।॥۔؟":
        return True
    j = _swallow(text, after, end)
    if j >= end:
        return True
    if not text[j].isspace():
        return False
    k = _skip(text, j, end)
    if k >= end:
        return True
    nxt = text[k]
    if stops[0] == "…" or len(stops) > 1 and set(stops) == {"."}:
        return not nxt.islower()
    if "!" in stops or "?" in stops:
        if j > after and text[start] in "'’‘" and text[j - 1] in "'’" and nxt.islower():
            return False  # a single quotation that opened the sentence
        return nxt not in "—–"
    # a full stop
    kind = TRIE.find(text, at, start)
    if kind == "never":
        return False
    if kind == "may":
        return nxt.isupper() or nxt in "“„«\"(¿¡"
    prev = text[at - 1] if at > start else ""
    if prev.isdigit():
        w = at - 1
        while w > start and text[w - 1].isdigit():
            w -= 1
        if at - w <= 2 and (w == start or text[w - 1].isspace()) and _next_word(text, k, end).lower().rstrip(".") in MONTHS:
            return False
    elif prev.isalpha() and (at - 1 == start or text[at - 2].isspace() or text[at - 2] in ".(") and prev.lower() != "i" and not "฀" <= prev <= "๿" and not "぀" <= prev <= "鿿":
        return False  # an initial
    return kind != "number" or not nxt.isdigit()


def sentence_ends(text: str) -> list[int]:
    """Code point offsets after the last character of every sentence unit, ascending; none for blank text."""
    out: list[int] = []

    def emit(k: int) -> None:
        while k > 0 and text[k - 1].isspace():
            k -= 1
        if k and (not out or k > out[-1]):
            out.append(k)

    for begin, end, whole in blocks(text):
        if not whole:
            paragraph(text, begin, end, emit)
        emit(end)
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each unit."""
    out, last = [], 0
    for e in sentence_ends(text):
        b = last
        while b < e and text[b].isspace():
            b += 1
        out.append((b, e))
        last = e
    return out


def nearest_end(ends: list[int], k: int) -> int:
    """The first sentence end at or after k."""
    j = bisect_left(ends, k)
    return ends[j] if j < len(ends) else (ends[-1] if ends else 0)
