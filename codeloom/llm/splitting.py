"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.invalid_files import file_texts, newest_files
from codeloom.runtime import likely_in, materialise

_DEFINITION = re.compile(r"(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|abstract\s+|final\s+)*(?:def|class|func|function|interface|type|enum|struct|const|var|let|record|@\w)\b|#{1,6} |/\*\*")


def limit(limits: DataFrame, name: str) -> tuple[int, int]:
    """(capacity, overlap) of one row of size_limits, a fixed table of parameters."""
    row = limits.where(F.col("limit_name") == name).select("capacity", "overlap").first()
    if row is None:
        raise ValueError(f"size_limits has no {name}")
    return row.capacity, row.overlap


def least_pieces(n, capacity: int, overlap: int):
    """The minimum number of pieces, as a column: n length units, consecutive pieces share `overlap`."""
    return F.when(n <= capacity, 1).otherwise(F.ceil((n - overlap) / F.lit(capacity - overlap))).cast("int")


def plan_items(nodes: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_type, item_key, path, first, units, capacity, overlap, pieces) of every node and file with its minimum piece count.

    Nodes: newest row of any kind but file, module and namespace; units are
    lines, both ends counted, interchanged ends put right; a null line gives
    no item. Files: newest row, units are bytes; null sizes give no item.
    """
    c, o = limit(limits, "node_span")
    m = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", "kind", "file_path", "start_line", "end_line")).alias("m")).select("id", "m.*")
    span = F.abs(F.col("end_line") - F.col("start_line")) + 1
    by_node = m.where("kind not in ('file', 'module', 'namespace') and start_line is not null and end_line is not null").select(
        F.lit("node").alias("item_type"),
        F.col("id").alias("item_key"),
        F.col("file_path").alias("path"),
        F.least("start_line", "end_line").alias("first"),
        span.cast("bigint").alias("units"),
        F.lit(c).alias("capacity"),
        F.lit(o).alias("overlap"),
        least_pieces(span, c, o).alias("pieces"),
    )
    c, o = limit(limits, "file_text")
    by_file = newest_files(files).where("size is not null").select(
        F.lit("file").alias("item_type"),
        F.col("path").alias("item_key"),
        "path",
        F.lit(1).alias("first"),
        F.col("size").alias("units"),
        F.lit(c).alias("capacity"),
        F.lit(o).alias("overlap"),
        least_pieces(F.col("size"), c, o).alias("pieces"),
    )
    return by_node.unionByName(by_file)


def balanced_cuts(n: int, capacity: int, overlap: int, boundaries: list[list[int]], legal=None) -> list[int]:
    """Ends of the pieces but the last, so that piece k is [end(k-1) - overlap, end(k)) and none is longer than capacity.

    Starts with the minimum count and equal-length targets; each target snaps
    to the nearest boundary of the strongest level (sorted positions, the
    strongest first) within half a step. A piece more is taken whenever a
    limit fails. legal(x, low) moves a hard cut down to an allowed place.
    """
    if capacity <= overlap:
        raise ValueError("capacity must exceed overlap")
    if n <= capacity:
        return []
    step = capacity - overlap
    m = max(2, -(-(n - overlap) // step))
    while True:
        cuts, last, ok = [], 0, True
        for k in range(1, m):
            length = (n - last + (m - k) * overlap) / (m - k + 1) if last == 0 else (n - last + overlap + (m - k) * overlap) / (m - k + 1)
            start = last - overlap if last else 0
            target = start + length
            low = max(last + 1, n - (m - k) * step)  # the rest must fit into what is left
            high = min(start + capacity, n - 1)
            if low > high:
                ok = False
                break
            cut = None
            reach = max(1, length / 2)
            for level in boundaries:
                a, b = bisect_left(level, max(low, target - reach)), bisect_right(level, min(high, target + reach))
                if a < b:
                    cut = min(level[a:b], key=lambda x: (abs(x - target), x))
                    break
            if cut is None:
                cut = int(min(high, max(low, target)))
                cut = legal(cut, low) if legal else cut
            if not low <= cut <= high:
                ok = False
                break
            cuts.append(cut)
            last = cut
        if ok:
            return cuts
        m += 1


def line_boundaries(lines: list[str]) -> list[list[int]]:
    """Positions (0-based lines before which to cut): definitions, block ends and blank lines, any line by default."""
    defs, blocks, blanks = [], [], []
    for k, line in enumerate(lines):
        if k and _DEFINITION.match(line.strip()):
            defs.append(k)
        if k and not lines[k - 1].strip() and line.strip():
            blanks.append(k)
        if k and lines[k - 1].strip() in ("}", "};", "end", ")"):
            blocks.append(k)
    return [defs, blanks, blocks]


def split_lines(lines: list[str], capacity: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open line ranges of the pieces."""
    cuts = balanced_cuts(len(lines), capacity, overlap, line_boundaries(lines))
    ends = [*cuts, len(lines)]
    return [(max(0, (ends[k - 1] - overlap)) if k else 0, e) for k, e in enumerate(ends)]


def split_bytes(text: str, capacity: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open byte ranges of the pieces of the UTF-8 form; no character is cut, so an overlap may be up to 3 bytes shorter."""
    data = text.encode("utf-8", "surrogatepass")
    at, starts = 0, []
    for line in data.split(b"\n"):
        starts.append(at)
        at += len(line) + 1
    if len(data) <= capacity:
        return [(0, len(data))]
    kinds = line_boundaries(text.split("\n"))
    levels = [[starts[k] for k in level] for level in kinds] + [starts[1:]]
    words = [m.end() for m in re.finditer(rb"[ \t,;]", data)] if max(b - a for a, b in zip(starts, [*starts[1:], len(data)])) > capacity // 4 else []
    levels.append(words)

    def legal(x: int, low: int) -> int:
        while x > low and data[x] & 0xC0 == 0x80:
            x -= 1
        return x

    cuts = balanced_cuts(len(data), capacity, overlap, levels, legal)
    out, ends = [], [*cuts, len(data)]
    for k, e in enumerate(ends):
        s = max(0, ends[k - 1] - overlap) if k else 0
        while k and s < e and data[s] & 0xC0 == 0x80:
            s += 1
        out.append((s, e))
    return out


def cut_item(kind: str, first: int, units: int, capacity: int, overlap: int, text: str | None, lines: list[str] | None, content: bool) -> Iterator[tuple]:
    """(piece, begin, finish, content) of one item; `lines` are those of the text."""
    if kind == "node":
        own = (lines or [])[first - 1 : first - 1 + units] if first >= 1 else []
        own = own + [""] * (units - len(own))  # a span beyond its text is cut by line numbers
        for k, (x, y) in enumerate(split_lines(own, capacity, overlap)):
            yield k, first + x, first + y - 1, "\n".join(own[x:y]) if content and lines is not None else None
    elif text is None:
        ends = [*balanced_cuts(units, capacity, overlap, []), units]
        for k, e in enumerate(ends):
            yield k, ends[k - 1] - overlap if k else 0, e, None
    else:
        data = text.encode("utf-8", "surrogatepass")
        for k, (x, y) in enumerate(split_bytes(text, capacity, overlap)):
            yield k, x, y, data[x:y].decode("utf-8", "replace") if content else None


_ITEM = ("item_type", "item_key", "first", "units", "capacity", "overlap")


def split_items(nodes: DataFrame, files: DataFrame, limits: DataFrame, documents: DataFrame, content: bool = True) -> DataFrame:
    """(item_type, item_key, piece, begin, finish, content): the pieces of every item over its limit.

    Nodes: 1-based lines begin..finish. Files: byte offsets, half open. Items
    whose text is missing are cut by numbers alone, content null, as it is if
    it is not asked for. Only texts of files with oversized items are moved,
    once each, to the items of their file.
    """
    big = materialise(plan_items(nodes, files, limits).where("pieces > 1").select(*_ITEM, "path"))
    per_file = big.where("path is not null").groupBy("path").agg(F.collect_list(F.struct(*_ITEM)).alias("i"))
    texts = likely_in(file_texts(documents, "text"), F.col("path"), big, F.col("path")).groupBy("path").agg(F.max("text").alias("text"))
    lost = big.where("path is null").select(F.lit(None).cast("string").alias("text"), *(F.array(c).alias(c) for c in _ITEM))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, *items in zip(b["text"], *(b[c] for c in _ITEM)):
                lines = text.split("\n") if text is not None else None
                for kind, key, first, units, capacity, overlap in zip(*items):
                    rows += [(kind, key, *x) for x in cut_item(kind, int(first), int(units), int(capacity), int(overlap), text, lines, content)]
            yield pd.DataFrame(rows, columns=["item_type", "item_key", "piece", "begin", "finish", "content"])

    ready = per_file.join(texts, "path", "left").select("text", *(F.col(f"i.{c}").alias(c) for c in _ITEM)).unionByName(lost)
    return ready.mapInPandas(split, "item_type string, item_key string, piece int, begin bigint, finish bigint, content string")
