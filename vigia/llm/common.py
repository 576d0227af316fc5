"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from vigia.session import cut_lineage

# Rows per Arrow batch: texts are long, so a batch of the default 10,000 rows could fill a worker.
BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Bound the Arrow batches of this session (a batch is the unit a Python worker holds)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (computed once, lineage cut)."""
    return cut_lineage(df, name)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in small batches; workers are reused, so each task gives its freed memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return small_batches(df).mapInArrow(task, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one at a time; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for the frequent words (bounded)."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, composed from runs of powers of two."""
    n, out, done, power, at = len(words), None, 0, words, 1
    if size < 1 or n < size:
        return words[:0]
    while True:
        if size & at:
            part = power[done : done + n - size + 1]
            out = part if out is None else mix(out * _STEP + part + np.uint64(at))
            done += at
        if 2 * at > size:
            return out
        power = mix(power[:-at] * _STEP + power[at:] + np.uint64(at))
        at *= 2


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words, sorted; fewer words make one shingle; none makes none."""
    return np.unique(run_hashes(words, min(size, len(words))))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values (at least ``size`` are given)."""
    at = 1
    while 2 * at <= size:
        x, at = np.minimum(x[:-at], x[at:]), 2 * at
    rest = size - at
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def prune_scans_at_run_time(df: DataFrame) -> DataFrame:
    """Let Spark filter a scan by a Bloom filter of a selective join side, whatever the scan's size.

    Texts are wide, so a join that keeps few documents should not shuffle the others. The filter has a
    fixed size; beyond its capacity it prunes less and results stay the same.
    Spark does so only for a side that has a filter, so callers add one that every row meets.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "512m")
    return df
