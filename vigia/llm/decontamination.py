"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers' bit-parallel verification.

An item with at most k edits inside a text, cut into k + 1 pieces, leaves at least one piece unedited.
So every occurrence within the budget holds an exact hit of some piece at a known offset; the stretch of
text around it is verified with Myers' bit-parallel edit distance. Items and texts are compared in lower
case with white space runs as one blank. The budget is ERRORS_PERCENT of an item's length.

The items are a stated query set; they are dealt into blocks of BLOCK_CHARS characters, one automaton of
pieces each, and every block runs over all texts. A block is what is broadcast, so its size is bounded.

Defined results: null and empty texts match nothing; null and empty items, and those too short for a
piece of LEAST_PIECE characters, are only found exactly (empty: never); repeated items and texts each
give their rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vigia.llm.common import free_name, mapped, stage, table

ERRORS_PERCENT, LEAST_PIECE, BLOCK_CHARS = 8, 8, 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, percent: int = ERRORS_PERCENT) -> int:
    """Edits allowed: the share of the length, as far as pieces keep LEAST_PIECE characters."""
    return max(0, min(length * percent // 100, length // LEAST_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces that cover the item, their lengths as even as can be."""
    n, parts = len(item), errors + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any stretch of a text that ends at each position."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), {}
        for k, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the closest stretch; among equal ones the first end."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, now, best = full, 0, self.size, (self.size, 0)
        masks = self.masks.get
        for end, c in enumerate(text, 1):
            match = masks(c, 0)
            across = (((match & up) + up) ^ up) | match | down  # zero horizontal or diagonal steps
            plus, minus = down | ~(across | up) & full, up & across
            if plus & top:
                now += 1
            elif minus & top:
                now -= 1
            plus, minus = plus << 1, minus << 1  # row 0 is free: an occurrence may start anywhere
            up, down = (minus | ~(across | plus)) & full, plus & across & full
            if now < best[0]:
                best = (now, end)
        return best


class Matcher:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items, self.patterns, machine, at = [], [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            if item := normal(text):
                errors = budget(len(item), percent)
                self.items.append((item_id, item, errors))
                for offset, piece in pieces(item, errors):
                    at.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.patterns = [Myers(item) for _, item, _ in self.items]
        for piece, places in at.items():
            machine.add_word(piece, (len(piece), places))
        self.machine = machine
        if at:
            machine.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, least distance, start bound, end) in the normal form, for each item within its budget."""
        if not self.items:
            return
        around: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.machine.iter(text):
            for k, offset in places:
                item, errors = self.items[k][1:]
                start = end + 1 - size - offset
                lo, hi = max(0, start - errors), min(len(text), start + len(item) + errors)
                spans = around.setdefault(k, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        for k, spans in around.items():
            item_id, item, errors = self.items[k]
            found = []
            for lo, hi in spans:
                if (exact := text.find(item, lo, hi)) >= 0:
                    found.append((0, exact + len(item)))
                elif errors:
                    distance, end = self.patterns[k].best(text[lo:hi])
                    found.append((distance, lo + end))
            distance, end = min(found, default=(len(item), 0))
            if distance <= errors:
                yield item_id, distance, max(0, end - len(item) - distance), end


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed to the driver one block at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = ERRORS_PERCENT) -> DataFrame:
    """(id, item_id, distance, start, end): each document and item within the budget, its closest place in normal form."""
    kind = docs.schema[id].dataType.simpleString()
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    item_kind, item_type = items.schema["item_id"].dataType.simpleString(), to_arrow_type(items.schema["item_id"].dataType)
    wide = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    out = None
    for block in _blocks(items, BLOCK_CHARS):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            matcher = Matcher(shipped.value, percent)
            for batch in batches:
                rows, found = [], []
                for k in range(batch.num_rows):
                    for match in matcher.matches(normal(batch.column("t")[k].as_py())):
                        rows.append(k)
                        found.append(match)
                own = [pa.array([m[j] for m in found], t) for j, t in enumerate((item_type, pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *own], ["id", "item_id", "distance", "start", "end"])

        part = mapped(wide, run, f"id {kind}, item_id {item_kind}, distance int, start long, end long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = wide.limit(0).selectExpr("id", f"CAST(NULL AS {item_kind}) AS item_id", "0 AS distance", "0L AS start", "0L AS `end`")
    return out.withColumnRenamed("id", id)


def op10(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontamination(spark, docs, sf_dir):
    """Pipeline: documents that hold a benchmark item within its budget go; a null id is told by its text."""
    found = contaminated(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text"), table(spark, sf_dir, "benchmark"), id="key")
    # Stored first: its size then decides, before any text moves, whether it is broadcast.
    bad_id, bad_h = free_name(docs, "bad_id"), free_name(docs, "bad_h")
    bad = stage(found.select(F.col("key.doc_id").alias(bad_id), F.col("key.h").alias(bad_h)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_h)), "left_anti").select(*docs.columns)
