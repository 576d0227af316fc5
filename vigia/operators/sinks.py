"""Sinks and load control: align to the target, sanitise text, append/replace, period replace, ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.functions.core import keep_first
from vigia.operators.cleaning import strip_accents
from vigia.session import cut_lineage
from vigia.sources.folders import children, exists, publish, remove, staged

# FIXED VALUES — typographic characters mapped to ASCII before a load.
CHARSET_MAP = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("—", "-"))


def align_to_target(df: DataFrame, target: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename, then reorder to the target's columns; missing columns → typed NULL, extra columns dropped."""
    for old, new in (renames or {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields])


def sanitize_charset(df: DataFrame) -> DataFrame:
    """Every string column: curly quotes/em dash → ASCII, accents stripped, characters above U+00FF removed."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            for a, b in CHARSET_MAP:
                c = F.replace(c, F.lit(a), F.lit(b))
            c = F.regexp_replace(strip_accents(c), "[^\\x{00}-\\x{FF}]", "")
        out.append(c.alias(f.name))
    return df.select(*out)


def sink_append_or_replace(df: DataFrame, path: str, replace: bool = False, fmt: str = "parquet") -> str:
    """Create the table on first load; then append, or clear and insert (one distributed write).

    A replacement is written beside the table and published when it is complete, so a write that fails
    leaves the old rows; ``df`` may be read from the table itself. An append is published by Spark's job commit.
    """
    spark = df.sparkSession
    if replace or not exists(spark, path):
        with staged(spark, path) as at:
            df.write.format(fmt).save(at)
            publish(spark, [(at, path)])
    else:
        df.write.mode("append").format(fmt).save(path)
    return path


def sink_replace_period(df: DataFrame, path: str, partition_col: str = "PERIODO", periods: Sequence[str] = ()) -> str:
    """Idempotent rerun: the periods in ``df`` are replaced, and those of ``periods`` even when ``df`` has no rows of them.

    New rows are written beside the table; their period folders take the old ones' place together, or none does.
    """
    spark = df.sparkSession
    with staged(spark, path) as at:
        df.write.partitionBy(partition_col).parquet(at)
        names = {n for n in children(spark, at) if n.startswith(f"{partition_col}=")} | {f"{partition_col}={p}" for p in periods}
        publish(spark, [(f"{at}/{n}", f"{path}/{n}") for n in sorted(names)])
    return path


LEDGER = "ARCHIVO string, DESTINO string, HUELLA string, CARGA string"


def load_ledger(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """The loads to do now: neither the file's name nor its content is recorded for the target.

    Of the files of one run that share a name or a content (``HUELLA``, when both frames have it) one is kept,
    the first by name; files without a fingerprint are told apart by name.
    """
    def unrecorded(df, column):
        done = ledger.where(F.col(column).isNotNull()).select(F.col(column).alias("_A"), F.col("DESTINO").alias("_D")).distinct()
        return df.join(done, (df[column] == done["_A"]) & (df["DESTINO"] == done["_D"]), "left_anti")

    by_content = "HUELLA" in candidates.columns and "HUELLA" in ledger.columns
    todo = keep_first(unrecorded(candidates, "ARCHIVO"), ["ARCHIVO", "DESTINO"])
    if by_content:
        own = F.coalesce(F.col("HUELLA"), F.concat(F.lit("sin huella "), "ARCHIVO")).alias("_H")
        todo = keep_first(unrecorded(todo, "HUELLA").select("*", own), ["_H", "DESTINO"], order=["ARCHIVO"])
    return todo.select(*candidates.columns)


def file_fingerprints(spark: SparkSession, folder: str, target: str, glob: str = "*") -> DataFrame:
    """(ARCHIVO, DESTINO, HUELLA, RUTA) of a folder's files: name, target, SHA-256 of the content, path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("ARCHIVO"), F.lit(target).alias("DESTINO"),
                        F.sha2("content", 256).alias("HUELLA"), F.col("path").alias("RUTA"))


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The recorded loads (none before the first)."""
    if not exists(spark, ledger_path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger_path)


def load_files(spark: SparkSession, folder: str, table_path: str, ledger_path: str, target: str,
               read: Callable[[SparkSession, list[str]], DataFrame], glob: str = "*") -> str | None:
    """Load a folder's new files once: rows go to a folder of this load, the ledger entry publishes them.

    ``read`` turns paths into rows. Until the ledger's entry is in place, readers (:func:`loaded_rows`) see
    nothing of the load, and a load that ends before leaves only an unread folder. The driver holds the
    paths of the new files. Returns the load's name, or None when every file is recorded.
    """
    todo = cut_lineage(load_ledger(file_fingerprints(spark, folder, target, glob), read_ledger(spark, ledger_path)), "ledger-todo")
    paths = sorted(r["RUTA"] for r in todo.select("RUTA").collect())
    if not paths:
        return None
    load = f"c{uuid.uuid4().hex}"
    read(spark, paths).write.parquet(f"{table_path}/CARGA={load}")
    with staged(spark, ledger_path) as at:
        todo.select("ARCHIVO", "DESTINO", "HUELLA", F.lit(load).alias("CARGA")).write.parquet(at)
        publish(spark, [(at, f"{ledger_path}/{load}")])
    return load


def _loads(spark: SparkSession, ledger_path: str, target: str) -> list[str]:
    return sorted(r["CARGA"] for r in read_ledger(spark, ledger_path).where(F.col("DESTINO") == target).select("CARGA").distinct().collect())


def loaded_rows(spark: SparkSession, table_path: str, ledger_path: str, target: str, schema: str) -> DataFrame:
    """Rows of the loads that the ledger names for ``target``; folders of other loads are pruned."""
    loads = _loads(spark, ledger_path, target)
    if not loads:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, CARGA string").parquet(table_path).where(F.col("CARGA").isin(*loads)).drop("CARGA")


def drop_unpublished(spark: SparkSession, table_path: str, ledger_path: str, target: str) -> list[str]:
    """Remove the folders of loads that never reached the ledger (no load of ``table_path`` may be under way)."""
    known = {f"CARGA={x}" for x in _loads(spark, ledger_path, target)}
    gone = [n for n in children(spark, table_path) if n.startswith("CARGA=") and n not in known]
    for n in gone:
        remove(spark, f"{table_path}/{n}")
    return gone


def export_distinct_keys(df: DataFrame, column: str, path: str, header: str = "REG_EJECUTIVO") -> str:
    """Distinct non-empty codes as CSV with a header (a folder of part files, written in parallel)."""
    (df.select(F.trim(F.col(column)).alias(header)).where(F.col(header).isNotNull() & (F.col(header) != ""))
       .distinct().write.mode("overwrite").option("header", True).csv(path))
    return path
