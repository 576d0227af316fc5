"""Extendible-hashing shards: a directory over hash-prefix bits, split only where a bucket is too large.

Native DataFrame work. Every row gets a 60-bit hash of its key. A bucket is a hash prefix of ``depth``
bits; a bucket over the byte limit splits on its next bit, the others stay. Splits are decided for a
whole block of bits at once from one histogram of prefixes (partial aggregation, no row order); only
the rows of buckets that are still too large take part in the next, deeper block.

A bucket over the limit whose rows all have one key hash (a repeated or null key) has a directory of its
own over a second hash, that of the text: ``sub_depth`` and ``sub_prefix`` count its bits.

Defined results: a null key and a null text hash as the empty text; a null or empty text counts 0 bytes; repeated
keys share a shard unless it is over the limit; a bucket whose rows share both hashes (one long text, or copies of
one key and text) cannot split and is marked ``oversize``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.llm.common import free_name, stage, table

HASH_BITS = 60
#: Bits that one histogram looks beyond the depth an even spread would need.
SPARE_BITS = 6
#: Production shard limit: blocks of 2 MiB, the unit a training reader fetches.
LIMIT_BYTES = 2 * 1024 * 1024


def key_hash(key: Column) -> Column:
    """First 60 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


#: The bucket of the first directory that a second one splits (0, 0 for the first directory itself).
_OF = ["of_depth", "of_prefix"]


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*_OF, *keys).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _leaves(rows: DataFrame, largest: int, limit: int) -> DataFrame:
    """``rows`` (b, h and the columns of _OF) with depth, prefix, shard_bytes and shard_rows of their bucket.

    ``largest`` is the byte total of the largest directory.
    """
    top = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, largest / limit)))) + SPARE_BITS)
    base, todo, placed = 0, rows, []
    while True:
        cells = stage(_sums(todo.select(*_OF, _prefix(F.col("h"), F.lit(top)).alias("cell"), "b", F.lit(1).cast("long").alias("n"), F.col("h").alias("lo"), F.col("h").alias("hi")), "cell"), "shard-cells")
        # Every bucket between the base depth and the histogram's depth, summed from the cells.
        leveled = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(top)))).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(top) - F.col("depth")).cast("int")))
        buckets = _sums(leveled, "depth", "prefix").withColumn("split", (F.col("b") > limit) & (F.col("lo") < F.col("hi")) & (F.col("depth") < HASH_BITS))
        buckets = stage(buckets, "shard-buckets")
        parents = buckets.filter("split").select(*_OF, (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        reached = buckets.withColumn("parent", F.shiftright("prefix", 1)).join(parents, [*_OF, "depth", "parent"], "left_semi").unionByName(buckets.filter(F.col("depth") == base).withColumn("parent", F.shiftright("prefix", 1)))
        reached = stage(reached.select(*_OF, "depth", "prefix", "split", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows")), "shard-reached")
        # Directory entry of each non-empty cell: the one leaf above it.
        entry = leveled.select(*_OF, "cell", "depth", "prefix").join(reached.filter("not split").drop("split"), [*_OF, "depth", "prefix"])
        rest = reached.filter(F.col("split") & (F.col("depth") == top)).select(*_OF, F.col("prefix").alias("cell"))
        at = todo.withColumn("cell", _prefix(F.col("h"), F.lit(top)))
        placed.append(at.join(entry, [*_OF, "cell"]))
        if top >= HASH_BITS or rest.isEmpty():
            break
        todo = stage(at.join(rest, [*_OF, "cell"], "left_semi").drop("cell"), "shard-deeper")
        base, top = top, min(HASH_BITS, top + SPARE_BITS + 2)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.drop("cell")


def _directory(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(k, t, b, depth, prefix, sub_depth, sub_prefix, shard_bytes, shard_rows), ``t`` being the hash of the text."""
    none = [F.lit(0).alias(c) if c == "of_depth" else F.lit(0).cast("long").alias(c) for c in _OF]
    rows = df.select(F.col(key).alias("k"), key_hash(F.col(key)).alias("h"), key_hash(F.col(text)).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"), *none)
    rows = stage(rows, "shard-rows")
    sizes = ["k", "t", "b", "depth", "prefix", "sub_depth", "sub_prefix", "shard_bytes", "shard_rows"]
    first = stage(_leaves(rows, rows.agg(F.sum("b")).first()[0] or 0, limit), "shard-first")
    again = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    largest = first.filter(again).agg(F.max("shard_bytes")).first()[0]
    out = first.filter(~again) if largest else first
    out = out.select("*", F.lit(0).alias("sub_depth"), F.lit(0).cast("long").alias("sub_prefix")).select(sizes)
    if largest:
        hot = first.filter(again).select("k", "t", "b", F.col("t").alias("h"), F.col("depth").alias("of_depth"), F.col("prefix").alias("of_prefix"))
        split = _leaves(stage(hot, "shard-hot"), largest, limit).withColumnsRenamed({"depth": "sub_depth", "prefix": "sub_prefix"})
        out = out.unionByName(split.withColumnsRenamed({"of_depth": "depth", "of_prefix": "prefix"}).select(sizes))
    return out


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """(key, n_bytes, depth, prefix, sub_depth, sub_prefix, shard_bytes, shard_rows, oversize) for every row of ``df``."""
    names = ["depth", "prefix", "sub_depth", "sub_prefix"]
    out = _directory(df, key, text, limit)
    return out.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), *(F.col(c).cast("int" if c.endswith("depth") else "long").alias(c) for c in names), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write ``df`` as one Parquet folder per shard (``shard=<depth>-<prefix>-<sub_depth>-<sub_prefix>``), each one task's file.

    The folders' column is named ``shard``, with underscores after it where ``df`` has such a column.
    """
    shard, own, hashed = free_name(df, "shard"), free_name(df, "shard_key"), free_name(df, "shard_text")
    name = F.concat_ws("-", "depth", "prefix", "sub_depth", "sub_prefix")
    shards = _directory(df, key, text, limit).select(F.col("k").alias(own), F.col("t").alias(hashed), name.alias(shard)).distinct()
    met = F.col(key).eqNullSafe(F.col(own)) & (key_hash(F.col(text)) == F.col(hashed))
    df.join(shards, met).drop(own, hashed).repartition(shard).write.partitionBy(shard).parquet(path)


def op9(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


def _sql_hash(text: str) -> str:
    return f"('0x' || substr(md5(coalesce(CAST({text} AS VARCHAR), '')), 1, 15))::BIGINT"


def _sql_leaves(rows: str, name: str) -> str:
    return f"""{name}_buckets AS (
  SELECT of_depth, of_prefix, depth, h >> ({HASH_BITS} - depth) AS prefix, sum(b)::BIGINT AS shard_bytes, count(*) AS shard_rows,
         sum(b) > {LIMIT_BYTES} AND min(h) < max(h) AS split
  FROM {rows}, levels GROUP BY ALL),
{name} AS (
  SELECT d.row, d.doc_id, d.t, d.b, d.of_depth, d.of_prefix, k.depth, k.prefix, k.shard_bytes, k.shard_rows
  FROM {rows} d JOIN {name}_buckets k ON k.of_depth = d.of_depth AND k.of_prefix = d.of_prefix AND k.prefix = d.h >> ({HASH_BITS} - k.depth)
  WHERE NOT k.split QUALIFY row_number() OVER (PARTITION BY d.row ORDER BY k.depth) = 1)"""


ORACLE = f"""
WITH levels AS (SELECT depth::INTEGER AS depth FROM range(0, {HASH_BITS + 1}) t(depth)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_sql_hash("doc_id")} AS h, {_sql_hash("text")} AS t, coalesce(strlen(text), 0)::BIGINT AS b,
             0 AS of_depth, 0::BIGINT AS of_prefix FROM documents),
{_sql_leaves("d", "one")},
hot AS (SELECT row, doc_id, t AS h, t, b, depth AS of_depth, prefix AS of_prefix FROM one WHERE shard_bytes > {LIMIT_BYTES} AND shard_rows > 1),
{_sql_leaves("hot", "two")},
leaf AS (SELECT doc_id, b, depth, prefix, 0 AS sub_depth, 0::BIGINT AS sub_prefix, shard_bytes, shard_rows FROM one WHERE NOT (shard_bytes > {LIMIT_BYTES} AND shard_rows > 1)
         UNION ALL SELECT doc_id, b, of_depth, of_prefix, depth, prefix, shard_bytes, shard_rows FROM two)
SELECT doc_id, b AS n_bytes, depth, prefix, sub_depth, sub_prefix, shard_bytes, shard_rows, shard_bytes > {LIMIT_BYTES} AS oversize FROM leaf
"""
