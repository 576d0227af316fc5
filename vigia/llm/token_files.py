"""Token-id files: Simple-8b words with escapes, in blocks that decode alone.

**Coding.** An id stream is cut into blocks of BLOCK ids. A 64-bit word holds a 4-bit selector and 60 bits of
payload; selector s packs COUNTS[s] ids of WIDTHS[s] bits, the first id in the lowest bits. Each word takes
the most ids that fit; the last word of a block is padded with zeros. An id of more than 60 bits is an escape:
a word with selector 0, whose payload is its place in the segment's list of raw 64-bit ids.

**File.** A folder of Parquet part files in ascending document order; a row is a *segment*: whole documents,
closed at SEGMENT ids, with ``ids`` (document ids), ``counts`` (ids of each document), ``words`` and
``escapes`` (little-endian 64-bit words), ``offsets`` (first word of each block). ``part`` and ``segment`` give
the order; ``manifest`` gives the ids before each part. Any block decodes by itself, and all words of one
selector decode in one numpy step.

**Work.** Texts are range-partitioned by document id, then by a hash of the text and by row, so one repeated id
spreads over tasks. Encoding is the tokenizers library's, once for each distinct piece that a worker remembers
(bounded): texts of ASCII and Latin-1 are lower-cased and split as the vocabulary's own pre-tokenizer does
(``_PIECE``), and the library's model encodes each piece; white-space chunks with other characters go through
the whole library. A part's first id comes from the totals of the parts before it: one number a part.

Defined results: null texts are empty (just the end id); null document ids come first; rows that share an id
all stand in the file, equal ones next to each other; an empty table gives a folder without segments; other
columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.llm.common import lists, mapped, sliding_min, table
from vigia.session import ensure_checkpoint_dir

VOCABULARY, END = "word_bpe_49k.json", 2
BLOCK, SEGMENT = 8192, 1 << 18
#: Selectors 1 to 14: ids in a word, and bits of each (0: escape).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Pieces and chunks that a worker remembers.
ROOM = 400_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block) of ids (uint64)."""
    words, offsets, escapes = [], [0], []
    for k in range(0, len(ids), BLOCK):
        block, raw = _pack_block(ids[k : k + BLOCK], sum(map(len, escapes)))
        words.append(block)
        escapes.append(raw)
        offsets.append(offsets[-1] + len(block))
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *words]), np.concatenate([none, *escapes]), np.array(offsets[:-1], np.int64)


def _pack_block(ids: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    big = ids >> np.uint64(60) != 0
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = np.where(big, np.uint64(1) << np.uint64(60), ids)
    selector = np.zeros(n, np.int64)
    for s in range(len(COUNTS) - 1, 0, -1):  # the selector with the most ids wins
        count = int(COUNTS[s])
        fits = padded < np.uint64(1) << np.uint64(WIDTHS[s])
        selector[sliding_min(fits.view(np.uint8), count)[:n] != 0] = s
    after, starts, at = (np.arange(n) + COUNTS[selector]).tolist(), [], 0
    while at < n:
        starts.append(at)
        at = after[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s:
            slots = np.arange(COUNTS[s])
            words[here] |= (padded[starts[here][:, None] + slots] << (slots * WIDTHS[s]).astype(np.uint64)).sum(1, dtype=np.uint64)
        else:
            words[here] |= np.arange(before, before + len(here), dtype=np.uint64)
    return words, ids[starts[chosen == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids (uint64) of one block's words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    starts, out = ends - COUNTS[chosen], np.empty(ends[-1] if len(ends) else 0, np.uint64)
    payload = words & ((np.uint64(1) << np.uint64(60)) - np.uint64(1))
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s:
            slots, mask = np.arange(COUNTS[s]), (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
            out[starts[here][:, None] + slots] = (payload[here][:, None] >> (slots * WIDTHS[s]).astype(np.uint64)) & mask
        else:
            out[starts[here]] = escapes[payload[here].astype(np.int64)]
    return out[:n]


def unpack_all(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """All ``n`` ids of a segment, block by block."""
    cuts = [*offsets.tolist(), len(words)]
    blocks = [unpack(words[a:b], escapes, min(BLOCK, n - k * BLOCK)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return np.concatenate(blocks) if blocks else np.empty(0, np.uint64)


# What the vocabulary's pre-tokenizer matches, within ASCII and Latin-1 (letters, single digits, other runs).
_PLAIN = re.compile("[\x00-\x08\x0e-\x1b\t-\r -~\xa1-\xff]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t-\r {_LETTERS}{_DIGITS}]+")
_CHUNK = re.compile("[^\t-\r ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: printable ones are themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Remembered(dict):
    """piece -> its ids as 4-byte words, found once; emptied between texts when it holds over ROOM pieces."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.find(piece)).tobytes()
        return ids

    def of(self, pieces: list[str]) -> np.ndarray:
        if len(self) > ROOM:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.uint32).astype(np.uint64)


class Encoder:
    """Texts -> ids as the tokenizers library gives them, one encoding for each remembered piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _byte_letters()
        self.pieces, self.chunks = _Remembered(self._piece), _Remembered(self._chunk)

    def _piece(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return [token.id for token in self.model.tokenize(piece)]

    def _chunk(self, chunk: str) -> list[int]:
        return self.library.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and "<|" not in text:  # special tokens' own strings are the library's matter
            return self.pieces.of(_PIECE.findall(text.lower()))
        return self.chunks.of(_CHUNK.findall(text))


_SEGMENT = "part int, segment int, ids array<long>, counts array<long>, words binary, escapes binary, offsets array<long>"


def _segments(path: str, end: int | None):
    def run(batches):
        from pyspark import TaskContext

        encoder, part, number = Encoder(path), TaskContext.get().partitionId(), 0
        ids, streams, size = [], [], 0

        def segment():
            nonlocal number, ids, streams, size
            words, escapes, offsets = pack(np.concatenate(streams))
            row = [[part], [number], [ids], [[len(x) for x in streams]], [words.astype("<u8").tobytes()], [escapes.astype("<u8").tobytes()], [offsets]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            number, ids, streams, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "segment", "ids", "counts", "words", "escapes", "offsets"])

        tail = np.array([] if end is None else [end], np.uint64)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("t")):
                ids.append(doc)
                streams.append(np.concatenate([encoder.encode(text.as_py() or ""), tail]))
                size += len(streams[-1])
                if size >= SEGMENT:
                    yield segment()
        if ids:
            yield segment()

    return run


def write_tokens(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int | None = END) -> None:
    """Encode ``df`` and write the files at ``path``, in ascending order of ``id`` (integers)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    rows = rows.withColumns({"h": F.xxhash64("t"), "row": F.monotonically_increasing_id()})
    # So many ranges as the session shuffles to, kept as they are: a part is a file.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "t")
    mapped(rows, _segments(vocabulary, end), _SEGMENT).write.parquet(path)


def manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids in the parts before each part: one entry a part file, from the counts alone."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    out, before = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals.collect()):
        out[part], before = before, before + n
    return out


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            words, escapes = (np.frombuffer(row[c].as_py(), "<u8") for c in ("words", "escapes"))
            counts, docs = row["counts"].values.to_numpy(), row["ids"].values
            flat = unpack_all(words, escapes, row["offsets"].values.to_numpy(), int(counts.sum()))
            ends = np.cumsum(counts)
            n = len(counts)
            where = [pa.array(np.full(n, row[c].as_py(), np.int32)) for c in ("part", "segment")]
            yield pa.RecordBatch.from_arrays([docs, *where, pa.array(ends - counts), pa.array(counts), lists(np.split(flat, ends[:-1]), pa.int64())], ["id", "part", "segment", "at", "n", "tokens"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, segment, at, n, tokens) of every document in the files: ``at`` is its place in the segment."""
    return mapped(spark.read.parquet(path), _read, "id long, part int, segment int, at long, n long, tokens array<long>")


def _digested(batches):
    for batch in _read(batches):
        tokens = batch.column("tokens")
        flat, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        words = flat.astype("<u4")
        crc = [zlib.crc32(words[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "part", "segment", "at", "n")), pa.array(crc, pa.int64())], ["id", "part", "segment", "at", "n", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, ids_crc32) of every document in the files: ids before it, its ids, their CRC-32 as 4-byte words."""
    files = spark.read.parquet(path)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    # Segments of one part, in order: a part is one task's file, so this window is bounded like the file.
    from pyspark.sql import Window

    before = F.sum("size").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "segment", size.alias("size")).select("part", "segment", F.coalesce(before, F.lit(0)).alias("in_part"))
    parts = spark.createDataFrame(list(manifest(spark, path).items()), T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType())]))
    found = mapped(files, _digested, "id long, part int, segment int, at long, n long, ids_crc32 long")
    start = (F.col("first") + F.col("in_part") + F.col("at")).alias("start")
    return found.join(starts.join(parts, "part"), ["part", "segment"]).select("id", start, "n", "ids_crc32")


def op13(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigia-tables/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return digests(spark, path).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")
