"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with equal shingle sets form a class, led by its smallest id; only leaders go on.
2. Leaders are banded: BANDS keys of ROWS minima each; at similarity 0.8 a pair shares no key with
   probability under 1e-5 (``missed``).
3. Of each candidate text, the shingles that no other candidate text holds are counted, also where one id
   has several texts; the others bound its overlap with any text, in total and within each of CELLS parts
   of the hash range. A text with too many of its own leaves, and a pair whose bounds and sizes exclude the
   threshold is not made. Both tests are exact.
   Then each row of a bucket is paired with one hub, the member with most partners; links form
   components, and rows of one component need no further comparison. In a second turn the rows of buckets
   that still hold several components meet another hub. The pairs between components that the bounds still
   allow are then compared one by one, so no link is lost beyond the banding's stated probability, and the
   copies of a group are not paired with each other. Each turn joins the components found before it: only
   its own links, between components, form the next ones.
4. A candidate's signatures are compared batch by batch; after each, it is dropped when the posterior
   probability of reaching the threshold (uniform prior) is under MISS. Survivors are confirmed on the
   full shingle sets of the texts, as 64-bit hashes of their shingles.

Defined results: ids are integers; null and empty texts have no shingles and stay alone; fewer words than a shingle form
one shingle; rows with a null id stay alone (component null); rows that share an id are one document,
whose links are united; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import WordHashes, lists, mapped, prune_scans_at_run_time, shingles, stage, table
from vigia.llm.components import stars

SIZE, PERCENT = 5, 80
BANDS, ROWS, BATCH, MISS = 30, 5, 30, 1e-6
HASHES = BANDS * ROWS
CELLS = 32
#: Turns in which the rows of a bucket meet one of them, before the rest is compared one by one.
HUB_TURNS = 2


def missed(similarity: float) -> float:
    """Probability that a pair of this similarity shares no band."""
    return (1 - similarity**ROWS) ** BANDS


def least_matches(threshold: float) -> list[int]:
    """For each batch, the fewest agreeing minima of all so far that keep a pair.

    Under a uniform prior, P(similarity >= t | m of n agree) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= MISS:
                break
            m += 1
        out.append(m)
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def minima(items: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits) of a set of 64-bit hashes."""
    factor, shift = _seeds()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(low, (short[k : k + 512, None] * factor + shift).min(0), out=low)
    return low


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z and ASCII white space only


def _signed(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            counts, digests, cells, bands, sigs = [], [], [], [], []
            for value in batch.column("t"):
                items = shingles(hashes.of(word_list(value.as_py())), size)
                counts.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()))
                cells.append(np.bincount((items % np.uint64(CELLS)).astype(np.int64), minlength=CELLS))
                low = minima(items) if len(items) else np.empty(0, np.uint32)
                keys = low.reshape(-1, ROWS)
                bands.append(np.array([xxhash.xxh3_64_intdigest(k.tobytes(), j) for j, k in enumerate(keys)], np.uint64).view(np.int64))
                sigs.append((low & np.uint32(0xFFFF)).astype(np.uint16).view(np.int16))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists(cells, pa.int32()), lists(bands, pa.int64()), lists(sigs, pa.int16())], ["id", "n", "digest", "cells", "bands", "sig"])

    return run


#: Two ids, the smaller one first, and the components that they are in so far.
_PAIR = ["a", "b", "la", "lb"]
_PAIRS = "a long, b long, la long, lb long"


def _likely(batches):
    """Sequential test of candidate pairs on their signatures."""
    need = least_matches(PERCENT / 100)
    for batch in batches:
        a, b = (batch.column(c).flatten().to_numpy().reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        alive, agree = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
        for k, least in enumerate(need):
            at = slice(k * BATCH, (k + 1) * BATCH)
            agree[alive] += (a[alive, at] == b[alive, at]).sum(1, dtype=np.int32)
            alive = alive[agree[alive] >= least]
        yield batch.select(_PAIR).take(pa.array(alive))


def _confirmed(size: int, percent: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keep, last = [], (None, None)
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                if last[0] != b:  # pairs arrive sorted by b
                    last = (b, shingles(hashes.of(word_list(batch.column("text_b")[k].as_py())), size))
                x, y = shingles(hashes.of(word_list(batch.column("text_a")[k].as_py())), size), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(_PAIR).take(pa.array(keep, pa.int64()))

    return run


def _verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose sets reach the threshold; staged. Pairs of an id with several texts may be repeated."""
    left, right = (sigs.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    likely = stage(mapped(pairs.join(left, "a").join(right, "b"), _likely, _PAIRS), "near-likely")
    likely = prune_scans_at_run_time(likely).filter("a < b")
    own = docs.select("id", "t")
    wide = likely.join(own.select(F.col("id").alias("a"), F.col("t").alias("text_a")), "a")
    wide = wide.join(own.select(F.col("id").alias("b"), F.col("t").alias("text_b")), "b")
    return stage(mapped(wide, _confirmed(size, percent), _PAIRS), "near-links")


def _relabelled(df: DataFrame, step: DataFrame) -> DataFrame:
    """``df`` with its components l mapped by (node, component)."""
    return df.join(step.withColumnRenamed("node", "l"), "l", "left").withColumn("l", F.coalesce("component", "l")).drop("component")


def _open(members: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    live = members.groupBy("bucket").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo < hi").select("bucket")
    return members.join(live, "bucket", "left_semi")


def _pair(c: str, l: str, c2: str, l2: str) -> list:
    first = F.col(c) < F.col(c2)
    return [F.least(c, c2).alias("a"), F.greatest(c, c2).alias("b"), F.when(first, F.col(l)).otherwise(F.col(l2)).alias("la"), F.when(first, F.col(l2)).otherwise(F.col(l)).alias("lb")]


def _hub_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each row with its bucket's hub: first the member with most bucket partners, then another one."""
    rank = -F.col("w") if turn == 0 else F.xxhash64("c", F.lit(turn))
    hubs = members.groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), "c", "l", "n", "m", "cells")).alias("hub"))
    pairs = members.join(hubs, "bucket").filter((F.col("l") != F.col("hub.l")) & _allowed(("n", "m", "cells"), ("hub.n", "hub.m", "hub.cells"), percent))
    return pairs.select(*_pair("c", "l", "hub.c", "hub.l")).distinct()


def _allowed(one: tuple, two: tuple, percent: int):
    """Whether two sets (n, m, cells) can reach the threshold, by the most they can share."""
    (n1, m1, cells1), (n2, m2, cells2) = one, two

    def enough(shared):
        return 100 * shared >= percent * (F.col(n1) + F.col(n2) - shared)

    by_cell = F.aggregate(F.zip_with(cells1, cells2, lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda t, v: t + v)
    return enough(F.least(m1, m2)) & enough(by_cell)


def _pairs_between(members: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket's rows in different components that their bounds allow."""
    two = members.select("bucket", *(F.col(k).alias(f"{k}2") for k in ("c", "l", "n", "m", "cells")))
    allowed = _allowed(("n", "m", "cells"), ("n2", "m2", "cells2"), percent)
    return members.join(two, (members["bucket"] == two["bucket"]) & (F.col("l") < F.col("l2")) & allowed).select(*_pair("c", "l", "c2", "l2")).distinct()


def _items(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(word_list(t.as_py())), size) for t in batch.column("t")]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, lists([x.view(np.int64) for x in sets], pa.int64())], ["digest", "items"])

    return run


def _bounded(members: DataFrame, docs: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """``members`` with n (shingles), m (those that another candidate text holds too) and w (partners), where m allows a link.

    All counts are of one text (d, from the digest of its shingles), never of all texts of an id.
    """
    some = stage(members.groupBy("c", "d").agg(F.sum("k").alias("w")), "near-some")
    known = prune_scans_at_run_time(some.select(F.col("c").alias("id"))).filter("id >= 0 OR id < 0")
    items = mapped(docs.select("id", "t").join(known, "id", "left_semi"), _items(size), "digest binary, items array<long>").select(F.xxhash64("digest").alias("d"), "items")
    owners = items.select("d", F.explode("items").alias("s")).groupBy("s").agg(F.min("d").alias("d"), F.max("d").alias("hi"))
    # s is signed: its cell is that of the unsigned hash.
    cell = F.expr(f"int(pmod(s, {CELLS}))")
    own = owners.filter("d = hi").groupBy("d").agg(*[F.count_if(cell == k).cast("int").alias(f"u{k}") for k in range(CELLS)])
    own = own.select("d", F.array(*[f"u{k}" for k in range(CELLS)]).alias("own"))
    shared = F.zip_with("cells", "own", lambda v, u: v - u)
    bound = some.select("d", "w").join(sizes, "d").join(own, "d", "left").withColumn("cells", F.when(F.col("own").isNull(), F.col("cells")).otherwise(shared))
    bound = bound.withColumn("m", F.aggregate("cells", F.lit(0).cast("long"), lambda t, v: t + v))
    bound = bound.filter(100 * F.col("m") >= percent * F.col("n")).select("d", "n", "m", "w", "cells")
    return members.drop("k").join(bound, "d").drop("d").withColumn("l", F.col("c"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``df``."""
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    signed = stage(mapped(docs, _signed(size), "id long, n long, digest binary, cells array<int>, bands array<long>, sig array<smallint>"), "near-signed")
    full = signed.filter("n > 0 AND id IS NOT NULL")
    # The leader of each class with what it brings along: copies are combined before they move.
    led = full.groupBy("n", "digest").agg(F.min(F.struct("id", "cells", "bands", "sig")).alias("x"))
    leaders = stage(led.select("n", "digest", F.xxhash64("digest").alias("d"), "x.*"), "near-leaders")
    classes = leaders.select("n", "digest", F.col("id").alias("c"))
    rows = leaders.select(F.col("id").alias("c"), "d", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi").select("bucket", "k")
    members = stage(rows.join(shared, "bucket").select("bucket", "c", "d", "k"), "near-members")

    known = docs.filter("id IS NOT NULL")
    live = stage(_bounded(members, known, leaders.select("d", "n", "cells"), size, percent), "near-bounded")
    links, steps = None, []
    for turn in range(HUB_TURNS + 1):
        if turn:
            live = stage(_open(_relabelled(live, steps[-1])), "near-open")
        if live.isEmpty():
            break
        pairs = _hub_pairs(live, turn, percent) if turn < HUB_TURNS else _pairs_between(live, percent)
        found = _verify(stage(pairs, "near-pairs"), leaders.select("id", "sig"), known, size, percent)
        links = found if links is None else links.unionByName(found)
        steps.append(stars(found.select(F.col("la").alias("u"), F.col("lb").alias("v"))))

    # Rows -> class -> component; classes of one id are one document.
    at = signed.select("id", "n", "digest").join(classes, ["n", "digest"], "left").withColumn("l", F.col("c"))
    repeated = full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").select("id")
    if repeated.isEmpty():
        for step in steps:
            at = _relabelled(at, step)
    else:  # an id with several texts joins their classes
        same = at.filter("id != c").select(F.col("id").alias("u"), F.col("c").alias("v"))
        both = same if links is None else same.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        at = _relabelled(at.withColumn("l", F.when(F.col("c").isNotNull(), F.col("id"))), stars(both))
    out = at.withColumn("component_id", F.when(F.col("id").isNull(), None).otherwise(F.coalesce("l", "id")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def op7(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def stage_near_dedup(spark, docs, sf_dir):
    """Pipeline: one document of each group of near-duplicates stays (the smallest id)."""
    found = stage(near_duplicates(docs), "near-found")
    # Stored first: its size then decides, before any text moves, whether the ids that go are broadcast.
    gone = stage(found.filter("doc_id != component_id").select("doc_id").distinct(), "near-gone")
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        out = kept.unionByName(out.filter("doc_id IS NULL"))
    return out
