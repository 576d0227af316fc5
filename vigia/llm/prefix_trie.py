"""Conversation prefix trie with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role, text); conversations that start with it are its members.

1. A turn becomes a 128-bit digest and a byte length in the scan, so texts are not shuffled. A conversation's
   turns pass in order as a stream, which chains the digests: the chained digest names the node.
2. Nodes are counted by partial aggregation (members, smallest member), however many conversations share one.
3. Nodes are layered by their members: up to SHARD_MEMBERS, then each layer FACTOR times more. A shard is a
   subtree within a layer; its root is the first node of the layer on the way down. So a first turn that a
   third of all conversations share is cut below itself into many shards.
4. Time-forward processing, layer by layer from the smallest: a shard's nodes are sorted by Spark (externally)
   in reverse level order and pass as a stream; each node takes the messages of its children from a priority
   queue ordered like the nodes and sends its own subtree totals to its parent. The queue holds ROOM messages
   and spills sorted runs beyond that. The totals of shard roots are summed by parent (partial aggregation)
   and start the next layer, until the root of all. A layer for each power of FACTOR: 6 for 1e12 conversations.
5. The ids that end in a node pass in order as a stream into its hash.

Spilled runs are unnamed files of the task in the scratch folders that Spark gives its workers for spilling; no
other task reads them.

Defined results: turns are ordered by turn (nulls first), then by digest; null roles and texts are empty; rows
without a conversation id are no conversation; repeated rows are repeated turns; an empty table gives no rows;
other columns are not read. c%5 has the sign of c.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigia.llm.common import mapped, stage, table

SHARD_MEMBERS, FACTOR = 1024, 64
ROOM = 200_000
ROOT = bytes(16)
#: The dealt rebuilding: a conversation's first turns come from the first one of its group of GROUP.
GROUP, HEAD = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Messages by key, taken in ascending order of keys; more than ``room`` are spilled in sorted runs."""

    def __init__(self, room: int = ROOM):
        self.room, self.heap, self.runs, self.heads = room, [], [], []

    def send(self, key, message: tuple):
        heapq.heappush(self.heap, (key, message))
        if len(self.heap) > self.room:
            self._spill()

    def _spill(self):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        items = sorted(self.heap)
        for k in range(0, len(items), 1024):
            pickle.dump(items[k : k + 1024], file)
        file.seek(0)
        self.heap = []
        self.runs.append(self._items(file))
        self._next(len(self.runs) - 1)

    @staticmethod
    def _items(file):
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: int):
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def take(self, key):
        """The messages of ``key``; every smaller key has been taken."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        while self.heads and self.heads[0][0][0] == key:
            item, run = heapq.heappop(self.heads)
            yield item[1]
            self._next(run)


def _tuples(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(rows, schema: str, size: int = 4096):
    fields, block = [f.split() for f in schema.split(", ")], []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(column, _KINDS[kind]) for column, (_, kind) in zip(zip(*block), fields)], [name for name, _ in fields])

    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield made()
            block = []
    if block:
        yield made()


def turn_digest(role: str, text: str):
    """128 bits of a turn's role and text (native)."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))


_CHAINED = "conv long, depth long, node binary, parent binary, b long, ends boolean"


def _chained(batches):
    """Nodes on each conversation's way down; rows (conv, k, d, b) arrive in order, first one without a turn."""

    def rows():
        for conv, group in groupby(_tuples(batches), key=lambda r: r[0]):
            last = None
            for depth, (_, _, d, b) in enumerate(group):
                if last:
                    yield (*last, False)
                node = ROOT if last is None else hashlib.blake2b(last[2] + d, digest_size=16).digest()
                last = (conv, depth, node, last and last[2], b)
            yield (*last, True)

    yield from _arrow(rows(), _CHAINED)


_TOTALS = "conv long, depth long, node binary, parent binary, n long, n_children long, n_leaves long, saved long, top boolean"


def _forward(room: int):
    """Subtree totals; rows (shard, depth, node, parent, conv, n, b, kids, leaves, saved) arrive in reverse level order."""

    def run(batches):
        def rows():
            for shard, group in groupby(_tuples(batches), key=lambda r: r[0]):
                queue = SpillingQueue(room)
                for _, depth, node, parent, conv, n, b, kids, leaves, saved in group:
                    saved += (n - 1) * b
                    for more_leaves, more_saved in queue.take((-depth, node)):
                        kids, leaves, saved = kids + 1, leaves + more_leaves, saved + more_saved
                    leaves = leaves if kids else 1
                    if node != shard:
                        queue.send((1 - depth, parent), (leaves, saved))
                    yield conv, depth, node, parent, n, kids, leaves, saved, node == shard

        yield from _arrow(rows(), _TOTALS)

    return run


def _ids_hashed(batches):
    """SHA-256 of the ids of each node, joined by commas; rows (node, conv) arrive in order."""

    def rows():
        for node, group in groupby(_tuples(batches), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for k, (_, conv) in enumerate(group):
                digest.update(b",%d" % conv if k else b"%d" % conv)
            yield node, digest.hexdigest()

    yield from _arrow(rows(), "node binary, ends_sha256 string")


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, d, b): the k-th turn of each conversation, its digest and the bytes of its text."""
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), turn_digest(role, text).alias("d"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("b"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "d")) - 1
    return rows.filter("conv IS NOT NULL").select("conv", place.cast("long").alias("k"), "d", "b")


def rebuilt(placed: DataFrame) -> DataFrame:
    """The dealt conversations: first h turns of conversation c-c%5, then the own turns after the first h."""
    def head(c):
        return F.crc32(F.col(c).cast("string").cast("binary")) % HEAD

    own = placed.filter(F.col("k") >= head("conv"))
    base = placed.filter((F.col("k") < HEAD - 1) & (F.col("conv") % GROUP == 0))
    copies = base.withColumn("o", F.explode(F.array(*(F.lit(o) for o in range(1 - GROUP, GROUP))))).withColumn("c", F.try_add("conv", "o"))
    copies = copies.filter((F.col("c") % GROUP == F.col("o")) & (F.col("k") < head("c"))).select(F.col("c").alias("conv"), "k", "d", "b")
    known = placed.filter("k = 0").select("conv")
    return own.unionByName(copies.join(known, "conv", "left_semi"))


def _layer(n, limit: int):
    return sum(((n > limit * FACTOR**k).cast("int") for k in range(10) if limit * FACTOR**k < 1 << 62), F.lit(0))


def prefix_trie(placed: DataFrame, convs: DataFrame, limit: int = SHARD_MEMBERS, room: int = ROOM) -> DataFrame:
    """One row a node of the conversations ``convs`` (conv) with the turns ``placed`` (conv, k, d, b).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    starts = convs.select("conv", F.lit(-1).cast("long").alias("k"), F.lit(None).cast("binary").alias("d"), F.lit(0).cast("long").alias("b"))
    # By a hash: where both sides are already dealt by ``conv``, Spark takes their union to be so too and shuffles
    # nothing, but AQE joins the partitions of each side on its own, and a conversation is cut in two.
    ordered = starts.unionByName(placed.select("conv", "k", "d", "b")).repartition(F.xxhash64("conv")).sortWithinPartitions("conv", "k")
    ways = stage(mapped(ordered, _chained, _CHAINED), "trie-ways")
    nodes = ways.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("b").alias("b"))
    nodes = stage(nodes.withColumn("layer", _layer(F.col("n"), limit)), "trie-nodes")
    top = nodes.filter("depth = 0").select("layer").first()
    layers = top["layer"] if top else 0

    # The shard root of a conversation's nodes of a layer: the first of them on its way down.
    wide = nodes.filter("layer > 0 AND depth > 0").select("node", "layer")
    on_way = ways.filter("depth > 0").join(wide, "node", "left").select("conv", F.coalesce("layer", F.lit(0)).alias("layer"), "depth", "node").filter(F.col("layer") < layers)
    roots = on_way.groupBy("conv", "layer").agg(F.min(F.struct("depth", "node")).alias("way")).select("conv", "layer", F.col("way.node").alias("shard"))
    inner = nodes.filter(F.col("layer") < layers).join(roots, ["conv", "layer"])
    nodes = stage(inner.unionByName(nodes.filter(F.col("layer") == layers).withColumn("shard", F.lit(ROOT))), "trie-shards")

    done, messages = None, None
    for layer in range(layers + 1):
        now = nodes.filter(F.col("layer") == layer)
        if messages is None:
            now = now.withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
        else:
            sent = messages.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
            now = now.join(sent, "node", "left").fillna(0, ["kids", "leaves", "saved"])
        now = now.select("shard", "depth", "node", "parent", "conv", "n", "b", "kids", "leaves", "saved")
        now = now.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
        found = stage(mapped(now, _forward(room), _TOTALS), "trie-totals")
        up = found.filter("top AND parent IS NOT NULL").select("parent", "n_leaves", "saved")
        messages = up if messages is None else messages.unionByName(up)
        done = found if done is None else done.unionByName(found)

    ends = mapped(ways.filter("ends").select("node", "conv").repartition("node").sortWithinPartitions("node", "conv"), _ids_hashed, "node binary, ends_sha256 string")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = done.join(above, "parent", "left").join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12(spark, sf_dir):
    placed = stage(turns(table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(rebuilt(placed), placed.filter("k = 0"))
