"""Sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.llm.sentence_rules import sentence_spans


def split_sentences(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, position, begin_offset, end_offset[, sentence]): the sentence units of every document, in code points.

    Headings, list items and fenced lines are one unit each; blank lines end
    units, single line breaks do not. Null and blank texts give no rows.
    Repeated documents are split each by itself. Texts are split where they
    are read: no shuffle.
    """
    columns = ["doc_id", "position", "begin_offset", "end_offset"] + ["sentence"] * with_text

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, x, y, t[x:y])[: 4 + with_text] for d, t in zip(b["doc_id"], b["text"]) for k, (x, y) in enumerate(sentence_spans(t))]
            yield pd.DataFrame(rows, columns=columns)

    kinds = "doc_id bigint, position int, begin_offset int, end_offset int" + ", sentence string" * with_text
    return documents.where("text is not null").select("doc_id", "text").mapInPandas(split, kinds)
