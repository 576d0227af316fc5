"""Token counts by section: offset-mapped attribution.

A whole document is encoded once; each token's bytes give its character span in the document. The spans
are interval-joined with the document's sections (sorted, disjoint character intervals; both sides are
sorted, so two binary searches per token do it). A token within one section counts there. One that
crosses a boundary is allocated by a stated rule:

* ``first``: to the section of its first character that lies in one;
* ``most``: to the section that holds most of its characters, the earlier one of equals;
* ``split``: to all that it touches, in proportion to its characters (counts are then fractions).

Tokens outside all sections are reported under section -1. A token that holds part of a character counts
as covering it.

Defined results: null and empty texts have no tokens, and sections with 0; empty sections have 0;
repeated rows are counted each; an empty table gives no rows; extra columns stay as the caller selects.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import mapped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RULES = ("first", "most", "split")


class Spans:
    """A tokenizer that gives character spans."""

    def __init__(self, ranks: bytes, pattern: str):
        own = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.sizes = np.zeros(max(own.values()) + 1, np.int64)
        for token, rank in own.items():
            self.sizes[rank] = len(token)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token."""
        ends = np.cumsum(self.sizes[np.asarray(self.encoding.encode_ordinary(text), np.int64)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        if len(ends) and not text.isascii():
            begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # the byte that opens a character
            number = np.cumsum(begins)
            starts, ends = number[starts] - 1, number[ends - 1]
        return starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, float, int]:
    """(count of each section [low, high), count outside all, tokens that cross a boundary)."""
    out, outside = np.zeros(len(low)), 0.0
    if not len(starts):
        return out, outside, 0
    one, last = np.searchsorted(high, starts, "right"), np.searchsorted(low, ends, "left") - 1  # touched sections
    inside = (one == last) & (starts >= low[np.minimum(one, len(low) - 1)]) & (ends <= high[np.minimum(one, len(low) - 1)]) if len(low) else np.zeros(len(starts), bool)
    out += np.bincount(one[inside], minlength=len(low))
    crossing = 0
    for k in np.flatnonzero(~inside):
        s, e = starts[k], ends[k]
        share = {j: n for j in range(one[k], last[k] + 1) if (n := min(e, high[j]) - max(s, low[j])) > 0}
        crossing += 1 if share else 0
        if not share:
            outside += 1
        elif rule == "first":
            out[min(share)] += 1
        elif rule == "most":
            out[min(share, key=lambda j: (-share[j], j))] += 1
        else:
            for j, n in share.items():
                out[j] += n / (e - s)
            outside += 1 - sum(share.values()) / (e - s)
    return out, outside, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feed: they tile the text."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends = ends[:-1]  # the text ends in a line feed
    return np.concatenate([[0], ends[:-1]]), ends


def given_sections(value: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as given; a section with a null bound is empty."""
    rows = [(r["start"], r["end"]) if r and r["start"] is not None and r["end"] is not None else (0, 0) for r in value or []]
    return np.array([a for a, _ in rows], np.int64), np.array([b for _, b in rows], np.int64)


def in_order(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of the sections by start; overlapping or reversed sections are an error."""
    order = np.lexsort((high, low))
    if np.any(high < low) or np.any(high[order][:-1] > low[order][1:]):
        raise ValueError("sections overlap or end before they start")
    return order


def section_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", sections: str | Callable = line_sections, rule: str = "most", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing_doc) per document and section.

    ``sections`` is the name of an array<struct<start, end>> column (in characters, in any order), or a function
    of the text; ``section`` is the place in it. A section with a null bound is empty; overlapping or reversed
    ones raise an error. Section -1 holds what lies in none, where there is any.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())  # 0.8 MB
    named = isinstance(sections, str)
    wide = df.select(F.col(id).alias("id"), F.col(text).alias("t"), *([F.col(sections).alias("s")] if named else []))
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        spans = Spans(shipped.value, pattern)
        for batch in batches:
            rows, parts = [], []
            for k in range(batch.num_rows):
                value = batch.column("t")[k].as_py() or ""
                low, high = given_sections(batch.column("s")[k].as_py()) if named else sections(value)
                number = in_order(low, high)
                low, high = low[number], high[number]
                counts, outside, crossing = attribute(*spans.of(value), low, high, rule)
                if outside > 1e-12:
                    number, low, high, counts = np.append(number, -1), np.append(low, 0), np.append(high, len(value)), np.append(counts, outside)
                rows.append(np.full(len(number), k))
                parts.append((number, low, high, counts, np.full(len(number), crossing)))
            columns = [pa.array(np.concatenate([p[j] for p in parts]), t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.concatenate(rows))), *columns], ["id", "section", "start", "end", "n_tokens", "n_crossing_doc"])

    made = mapped(wide, run, f"id {kind}, section int, start long, end long, n_tokens double, n_crossing_doc long")
    return made.withColumnRenamed("id", id)


def op2(spark, sf_dir):
    made = section_tokens(table(spark, sf_dir, "documents"))
    return made.withColumn("n_tokens", F.col("n_tokens").cast("long"))
