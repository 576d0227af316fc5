"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Every word shingle is hashed once; the top bits of the hash choose one of BINS bins, which keeps its least
hash. An empty bin takes the value of a filled bin chosen by a hash of (bin, attempt) alone, so equal bins
of two documents are filled from equal places. Of each bin the BITS low-order bits are kept, two bins a byte.
Bins of unlike documents agree by chance with probability 2^-BITS, which the likeness corrects:
J = (m - c) / (1 - c) with m the share of agreeing bins, cut to 0..1.

``with_next_edited`` sorts by descending id once (range partitioning) and streams every partition, holding one
row; the one row at each partition's edge is joined to the next partition's first row by id.

Defined results: ids are integers; null and empty texts have no shingles and an empty fingerprint, alike (1) to each other and
unlike (0) any other; fewer words than a shingle make one shingle; rows with a null id come after all others;
ties are ordered by text; a table's only row is next to itself; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import WordHashes, mapped, mix, run_hashes, stage, table

SIZE, BINS, BITS = 5, 512, 4
_CHANCE = 2.0**-BITS
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
_FLOORS = np.arange(BINS, dtype=np.uint64) << _SHIFT


@lru_cache(maxsize=256)
def _tries(block: int) -> np.ndarray:
    """The bins that each bin asks in 16 attempts, as a hash of bin and attempt."""
    attempts = np.arange(16 * block + 1, 16 * block + 17, dtype=np.uint64)[:, None]
    return (mix(np.arange(BINS, dtype=np.uint64) + attempts * np.uint64(BINS)) >> _SHIFT).astype(np.int64)


def fingerprint(text: str, hashes: WordHashes, size: int = SIZE) -> np.ndarray:
    """BINS values of BITS bits (an empty array for a text without words)."""
    words = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    items = np.sort(run_hashes(words, min(size, len(words))))
    if not len(items):
        return np.empty(0, np.uint8)
    at = np.searchsorted(items, _FLOORS)
    least = items[np.minimum(at, len(items) - 1)]
    filled = (at < len(items)) & ((least >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    source, empty, block = np.arange(BINS), np.flatnonzero(~filled), 0
    while len(empty):
        tried = _tries(block)[:, empty]
        hit = filled[tried]
        first, found = hit.argmax(0), hit.any(0)
        source[empty[found]] = tried[first[found], np.flatnonzero(found)]
        empty, block = empty[~found], block + 1
    return (least[source] & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray) -> str:
    """Hexadecimal text of the bins, two in a byte."""
    return (values[::2] << 4 | values[1::2]).tobytes().hex()


def unpacked(text: str) -> np.ndarray:
    both = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([both >> 4, both & 15], 1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(min(1.0, max(0.0, (np.mean(a == b) - _CHANCE) / (1 - _CHANCE))))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the following text as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGES = [("part", pa.int32()), ("head", pa.bool_()), ("tail", pa.bool_()), ("t", pa.string())]


def _row(id, text: str, own: np.ndarray, following: str, after: np.ndarray, hashes: WordHashes, size: int) -> tuple:
    new = edited(text, following)
    changed = fingerprint(new, hashes, size)
    return (id, len(text), hashlib.sha256(new.encode()).hexdigest(), packed(own), packed(changed), likeness(own, changed), likeness(own, after))


def _batch(rows: list[tuple], schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])


def _streamed(size: int):
    """Rows of a sorted partition with what follows them; the last one waits for the next partition."""

    def run(batches):
        hashes, part, held, first = WordHashes(), TaskContext.get().partitionId(), None, True
        for batch in batches:
            rows = []
            for id, value in zip(batch.column("id"), batch.column("t"), strict=True):
                text = value.as_py() or ""
                own = fingerprint(text, hashes, size)
                if held:
                    rows.append((*_row(*held, text, own, hashes, size), part, first, False, held[1] if first else None))
                    first = False
                held = (id.as_py(), text, own)
            if rows:
                yield _batch(rows, _OUT + _EDGES)
        if held:
            yield _batch([(held[0], len(held[1]), None, packed(held[2]), None, None, None, part, first, True, held[1])], _OUT + _EDGES)

    return run


def _completed(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows.append(_row(r["id"], r["t"], unpacked(r["fingerprint"]), r["next_text"], unpacked(r["next_print"]), hashes, size))
            if rows:
                yield _batch(rows, _OUT)

    return run


_TYPES = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.int32(): "int", pa.bool_(): "boolean"}


def _ddl(schema: list) -> str:
    return ", ".join(f"{n} {_TYPES[t]}" for n, t in schema)


def with_next_edited(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its text edited with the next one by descending id."""
    wide = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    order = [F.col("id").desc_nulls_last(), F.col("t").asc_nulls_first()]
    # Ranges of ids alone: equal ids share a range, and Spark's sample of the keys holds no texts.
    ranged = wide.repartitionByRange(order[0]).sortWithinPartitions(*order)
    made = stage(mapped(ranged, _streamed(size), _ddl(_OUT + _EDGES)), "prints")

    # One first and one last row a partition: their order is one small table.
    edges = made.filter("head OR tail").select("part", "head", "tail", "fingerprint", "t")
    order = Window.orderBy("part")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = edges.select("part").distinct().select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(around)).alias("next_part"))
    heads = edges.filter("head").select(F.col("part").alias("next_part"), F.col("t").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = made.filter("tail").join(nexts, "part").join(heads, "next_part")
    last = mapped(tails.select("id", "t", "fingerprint", "next_text", "next_print"), _completed(size), _ddl(_OUT))
    names = [n for n, _ in _OUT]
    return made.filter("NOT tail").select(*names).unionByName(last).withColumnRenamed("id", id)


def op8(spark, sf_dir):
    return with_next_edited(table(spark, sf_dir, "documents"))
