"""Evaluation texts leaking into training text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import materialise, spread, without_keys

#: A word, or one character of Chinese or Japanese.
_WORD = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^\W_぀-ヿ㐀-䶿一-鿿豈-﫿]+")
_SENTENCE_END = re.compile(r"[.!?:。！？：][\"')\]”」]*(?:\s|$)|\n")
#: Words of items that go to the tasks at once; a larger evaluation set is run in so many blocks.
BLOCK_WORDS = 5_000_000
#: Matches that are held at once; a shard with more of them is looked at item by item.
MOST_MATCHES = 4_000_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class SuffixArray:
    """The suffixes of a shard of training text in lexical order of their words.

    flat: codes of the words, 0 for a word that no item has and between
    documents; a suffix ends there. Prefix doubling: suffixes sorted by their
    first h words are sorted by 2h by the rank of what stands h further on;
    only those that are still equal are sorted again, up to `depth` words.
    """

    def __init__(self, flat: np.ndarray, depth: int = 64) -> None:
        self.flat = flat
        live = np.flatnonzero(flat)
        order = live[np.argsort(flat[live], kind="stable")]
        rank = np.zeros(len(flat) + depth + 1, dtype=np.int64)
        code = flat[order]
        group = np.cumsum(np.r_[True, code[1:] != code[:-1]]) if len(order) else code
        first = np.searchsorted(group, group)  # rank: the place of the first suffix of the group, plus 1
        rank[order] = first + 1
        h = 1
        while h < depth and len(order):
            r = rank[order]
            tied = np.r_[r[1:] == r[:-1], False]
            tied |= np.r_[False, tied[:-1]]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            p = order[at]
            nxt = rank[p + h]
            by = np.lexsort((nxt, rank[p]))
            p, nxt = p[by], nxt[by]
            order[at] = p
            r = rank[p]
            fresh = np.r_[True, (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])]
            new = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] + 1
            rank[p] = new
            h *= 2
        self.order = order

    def _below(self, want: np.ndarray, n: np.ndarray, upper: bool) -> np.ndarray:
        """For each row of `want` the number of suffixes below its first n words (or, upper, not above them): a binary search of all rows at once."""
        lo, hi = np.zeros(len(want), dtype=np.int64), np.full(len(want), len(self.order), dtype=np.int64)
        padded = np.r_[self.flat, np.zeros(want.shape[1], dtype=self.flat.dtype)]
        steps = np.arange(want.shape[1])
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            here = padded[self.order[mid][:, None] + steps]
            ended = np.cumsum(here == 0, axis=1) > 0  # nothing after the end of a suffix counts
            here = np.where(ended, 0, here)
            there = want[open_]
            counts = steps < n[open_, None]
            differs = (here != there) & counts
            k = differs.argmax(axis=1)
            some = differs.any(axis=1)
            rows = np.arange(len(open_))
            less = np.where(some, here[rows, k] < there[rows, k], upper)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def ranges(self, want: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) in the array of the suffixes that begin with the first n words of each row."""
        return self._below(want, n, False), self._below(want, n, True)


def least_run(m: int) -> int:
    """The shortest verbatim match that is looked up for an item of m words."""
    return 4 if m >= 16 else 3 if m >= 8 else 2 if m >= 3 else 1


class Items:
    """Own words of a block of items as codes."""

    def __init__(self, items: dict[int, list[str]]) -> None:
        self.ids = sorted(items)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for x in items.values() for w in x}))}
        self.coded = [np.array([self.vocabulary[w] for w in items[i]], dtype=np.int64) for i in self.ids]
        self.lengths = np.array([len(x) for x in self.coded], dtype=np.int64)
        self.runs = np.array([least_run(len(x)) for x in self.coded], dtype=np.int64)
        self.places = [places(x.tolist()) for x in self.coded]

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, first four words) of every suffix that is long enough."""
        item, place, want = [], [], []
        for k in which:
            x, n = self.coded[k], self.runs[k]
            at = np.arange(len(x) - n + 1)
            padded = np.r_[x, np.zeros(4, dtype=np.int64)]
            item.append(np.full(len(at), k))
            place.append(at)
            want.append(padded[at[:, None] + np.arange(4)])
        return np.concatenate(item), np.concatenate(place), np.concatenate(want)


def matches(array: SuffixArray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position in the shard, item, place in the item) of the verbatim matches of every item suffix, whole items at a time."""
    if not len(array.order):
        return
    item, place, want = items.suffixes(np.arange(len(items.ids)))
    lo, hi = array.ranges(want, items.runs[item])
    n = hi - lo
    per_item = np.bincount(item, weights=n, minlength=len(items.ids)).astype(np.int64)
    part = np.cumsum(per_item) // MOST_MATCHES  # items whose matches are held together
    for k in np.unique(part[per_item > 0]):
        rows = np.flatnonzero((part[item] == k) & (n > 0))
        which = np.repeat(rows, n[rows])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        yield array.order[lo[which] + inner], item[which], place[which]


def places(item: list[int]) -> dict:
    """Where each pair of words (or each word, for items of one or two) begins in the item."""
    at: dict = defaultdict(list)
    for k, w in enumerate(zip(item, item[1:]) if len(item) > 2 else item):
        at[w].append(k)
    return dict(at)


def verbatim_runs(at: dict, window: list[int], least: int) -> list[tuple[int, int, int]]:
    """(item place, window place, length) of the maximal verbatim runs of at least `least` words, 1 or 2."""
    runs: list[list[int]] = []
    live: dict[int, list[int]] = {}
    for j, w in enumerate(zip(window, window[1:]) if least == 2 else window):
        if w not in at:
            if live:
                live = {}
            continue
        now = {}
        for i in at[w]:
            run = live.get(i)
            if run is None:
                run = [i, j, least]
                runs.append(run)
            else:
                run[2] += 1
            now[i + 1] = run
        live = now
    return [tuple(r) for r in runs]


def passage(item: np.ndarray, window: np.ndarray, gap: int = 80, floor: float = 0, at: dict | None = None, sure: int = 14, dense: float = 0.6) -> tuple[int, int, int, int]:
    """(words, begin, end, longest run): the most words of the item that stand in its order in one stretch of the window.

    Verbatim runs of two words and more (one for items of one or two) are
    chained in the order of both; up to `gap` foreign words may lie between
    two runs. A changed word ends a run and costs only itself. A stretch
    longer than one and a half times the words found, plus one gap, is no
    passage but scattered phrases, and so is one in which the item's words are
    less than `dense` of all and no run has `sure` words (or half the item's):
    set phrases are short. Such a chain gives up its first run and all are
    chained anew. Nothing is sought below `floor` words. `at`: the
    item's places(), if they are at hand.
    """
    least = 1 if len(item) < 3 else 2
    runs = verbatim_runs(places(item.tolist()) if at is None else at, window.tolist(), least)
    top = (0, 0, 0, 0)
    if floor:
        held: set[int] = set()
        for i, _, n in runs:
            held.update(range(i, i + n))
        if len(held) < floor:
            return top
    while runs:
        best: list[tuple[int, int, int]] = []  # words of the best chain that ends with a run, its first run, the words of its longest
        first = longest = most = 0
        for k, (i, j, n) in enumerate(runs):
            longest = max(longest, n)
            while first < k and runs[first][1] + longest + gap < j:
                first += 1
            score, begin, top_run = n, k, n
            for q in range(first, k):
                qi, qj, qn = runs[q]
                over = max(qi + qn - i, qj + qn - j, 0)  # ends may overlap where a run could start later
                if over < n and qi < i and qj < j and j - (qj + qn) <= gap and best[q][0] + n - over > score:
                    score, begin, top_run = best[q][0] + n - over, best[q][1], max(best[q][2], n)
            best.append((score, begin, top_run))
            if score > best[most][0]:
                most = k
            start = runs[begin][1]
            span = j + n - start
            if score > top[0] and span <= 1.5 * score + gap and (score >= dense * span or top_run >= min(sure, len(item) / 2)):
                top = (score, start, j + n, top_run)
        score, begin, _ = best[most]
        if score <= top[0] or score < floor:
            break
        del runs[begin]
    return top


def item_words(items: DataFrame, shared_by: int = 3, least: int = 6) -> DataFrame:
    """(item_id, words): the own words of each item, without the opening that it shares.

    An opening is an instruction if at least `shared_by` items begin with the
    same `least` or more words up to the end of a sentence. Openings meet by
    their hash. A repeated item_id counts once (its greatest text); null and
    blank texts are left out.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"]):
                w = words(t)
                ends = sorted({n for m in _SENTENCE_END.finditer(t) if (n := len(words(t[: m.end()]))) >= least})
                rows.append((i, w, ends, [blake2b(" ".join(w[:n]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for n in ends]))
            yield pd.DataFrame(rows, columns=["item_id", "words", "ends", "openings"])

    one = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    rows = materialise(one.mapInPandas(cut, "item_id bigint, words array<string>, ends array<int>, openings array<binary>").where(F.size("words") > 0))
    openings = rows.select("item_id", F.size("words").alias("n"), F.explode(F.arrays_zip("ends", "openings")).alias("o")).select("item_id", "n", "o.*")
    shared = openings.groupBy("openings").agg(F.countDistinct("item_id").alias("by")).where(F.col("by") >= shared_by)
    cuts = openings.join(shared, "openings").where("ends < n").groupBy("item_id").agg(F.max("ends").alias("cut"))
    return rows.join(cuts, "item_id", "left").select("item_id", F.slice("words", F.coalesce("cut", F.lit(0)) + 1, F.size("words")).alias("words"))


_LEAK = ["doc_id", "item_id", "covered", "longest", "begin_word", "end_word"]


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, gap: int = 80, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, covered, longest, begin_word, end_word): every document with the items it gives away.

    covered: the share of the item's own words found in order in one passage,
    at least `share`; longest: the words of its longest verbatim match. Letter
    case, punctuation, blanks, line breaks and comment marks do not count.
    Null and blank texts and items give no rows.

    Every Arrow batch of documents is a shard with a suffix array of its
    words, in which all suffixes of all items are binary-searched; nothing is
    shuffled. The items are a stated set: they go to the tasks in blocks of
    about block_words, one pass over the documents for each. A pair is looked
    at whole if its verbatim matches of least_run() words lie close together.
    """
    spark = documents.sparkSession
    own = materialise(item_words(items))
    total = own.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = -(-total // block_words)
    kinds = "doc_id bigint, item_id bigint, covered double, longest int, begin_word int, end_word int"
    texts = spread(documents.where("text is not null").select("doc_id", "text"))
    out = spark.createDataFrame([], kinds)

    def scanner(shared):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(scan_shard(shared.value, b["doc_id"].tolist(), b["text"].tolist(), share, gap), columns=_LEAK)

        return scan

    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about block_words
        if rows:
            out = out.unionByName(texts.mapInPandas(scanner(spark.sparkContext.broadcast(Items({r.item_id: r.words for r in rows}))), kinds))
    return out


def without_leaked(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that give nothing away: the affected ones are removed whole."""
    return without_keys(documents, "doc_id", materialise(found.select("doc_id").distinct()))


def scan_shard(items: Items, doc_ids: list, texts: list[str], share: float, gap: int) -> list[tuple]:
    get = items.vocabulary.get
    pieces, starts, at = [], [], 0
    for t in texts:
        w = words(t)
        pieces += [np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w)), np.zeros(1, dtype=np.int64)]
        starts.append(at)
        at += len(w) + 1
    flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
    begins = np.array(starts, dtype=np.int64)
    # three in ten of the words that make a case must stand in the matches: with every fifth word changed eight in ten do
    need = np.maximum(1, (items.lengths * share * 0.3).astype(np.int64))
    out = []
    for pos, item, place in matches(SuffixArray(flat), items):
        doc = np.searchsorted(begins, pos, side="right") - 1
        order = np.lexsort((pos, item, doc))
        pos, item, doc, place = pos[order], item[order], doc[order], place[order]
        edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])
        stops = np.r_[edge[1:], len(pos)]
        fewest = np.maximum(1, need // 4)  # a match holds at most four words
        for k in np.flatnonzero(stops - edge >= fewest[item[edge]]):
            a, z = edge[k], stops[k]
            i, d, p = int(item[a]), int(doc[a]), pos[a:z]
            m, n = int(items.lengths[i]), int(items.runs[i])
            held = np.zeros(m + 4, dtype=bool)
            held[place[a:z, None] + np.arange(n)] = True
            if held.sum() < need[i]:
                continue
            span = 2 * m + 3 * gap
            close = np.searchsorted(p, p + span, side="right") - np.arange(len(p)) >= fewest[i]
            if not close.any():
                continue
            top, done = (0, 0, 0, 0), -1
            low, high = begins[d], begins[d + 1] - 1 if d + 1 < len(begins) else len(flat) - 1
            for s in np.flatnonzero(close):
                if p[s] <= done:
                    continue
                e = s  # the stretch of matches without a hole longer than a passage can have
                while e + 1 < len(p) and p[e + 1] - p[e] <= m + gap:
                    e += 1
                x, y = max(low, p[s] - m), min(high, p[e] + m + gap)
                done = p[e]
                found = passage(items.coded[i], flat[x:y], gap, share * m, items.places[i])
                if found[0] > top[0]:
                    top = (found[0], int(x - low) + found[1], int(x - low) + found[2], found[3])
            if top[0] >= share * m:
                out.append((doc_ids[d], items.ids[i], top[0] / m, top[3], top[1], top[2]))
    return out
