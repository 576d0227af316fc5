"""Consent history: append only the lead rows whose consent code is not stored yet.

The reference repeats one INSERT … NOT EXISTS block per product table; here
the products are a parameter table, all lead rows are tagged with their target
table in one pass and the whole increment is one ``left_anti`` join on
(table, code) — one shuffle for all twelve tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.params import Period


@dataclass(frozen=True)
class ConsentTable:
    table: str                      # target history table suffix
    digital: bool                   # source: digital lead base
    types: tuple[str, ...]          # lead types selected
    label: str | None = None        # fixed type label written (else the row's own type)
    bad_documents: tuple[str, ...] = ()


# FIXED VALUES — the twelve consent history tables.
CONSENT_TABLES = (
    ConsentTable("PP", False, ("PP",)),
    ConsentTable("TC", False, ("C", "NC", "2DA"), label="TC"),
    ConsentTable("EC", False, ("EC",)),
    ConsentTable("CD", False, ("CD",)),
    ConsentTable("CON", False, ("CON",)),
    ConsentTable("IL", False, ("IL",)),
    ConsentTable("UPG", False, ("UPG",)),
    ConsentTable("DPP", True, ("DPP",)),
    ConsentTable("DTC", True, ("DTC",), bad_documents=("callback",)),
    ConsentTable("DEC", True, ("DEC",)),
    ConsentTable("DCD", True, ("DCD",)),
    ConsentTable("DPRT", True, ("DIL", "DUPG", "DTCA", "DPA")),
)


def consent_code(tip: Column) -> Column:
    """type_document_flag_userfield5; NULL when USERFIELD5 is NULL (SQL concat semantics)."""
    return F.concat(tip, F.lit("_"), F.col("NUMERO_DOCUMENTO"), F.lit("_"), F.coalesce(F.col("VARIABLE_26"), F.lit("")),
                    F.lit("_"), F.col("USERFIELD5"))


def _by_type(digital: bool, value) -> Column:
    """Column that looks a value of the table up by the row's type (each type belongs to one table of its base)."""
    pairs = [x for t in CONSENT_TABLES if t.digital == digital for k in t.types for x in (F.lit(k), F.lit(value(t)).cast("string"))]
    return F.try_element_at(F.create_map(*pairs), F.col("TIP_CLIENTE"))


def consent_candidates(leads: DataFrame, leads_digital: DataFrame, period: Period) -> DataFrame:
    """All lead rows tagged with their target table and consent code (distinct per table): one scan of each base."""
    out = None
    for src, digital in ((leads, False), (leads_digital, True)):
        df = src.where(F.col("TIP_CLIENTE").isin(*(k for t in CONSENT_TABLES if t.digital == digital for k in t.types)))
        for t in CONSENT_TABLES:
            if t.digital == digital and t.bad_documents:
                df = df.where(~F.col("TIP_CLIENTE").isin(*t.types) | ~F.col("NUMERO_DOCUMENTO").isin(*t.bad_documents))
        tip = F.coalesce(_by_type(digital, lambda t: t.label), F.col("TIP_CLIENTE"))
        df = df.select(_by_type(digital, lambda t: t.table).alias("TABLA"), tip.alias("TIP_CLIENTE"),
                       F.col("NUMERO_DOCUMENTO").alias("NUM_DOCUMENTO"), F.col("VARIABLE_26").alias("FLAG_CONS"),
                       "USERFIELD5", consent_code(tip).alias("CODE"), F.lit(period.run_date).alias("UPDATED"))
        out = df if out is None else out.unionByName(df)
    return out.distinct()


#: Hash buckets of a stored history: at least the tasks that a month's join should have.
HISTORY_BUCKETS = 64


def consent_history(spark: SparkSession, path: str, buckets: int = HISTORY_BUCKETS) -> str:
    """Name of the history table at ``path``, bucketed by (table, code); it is created when missing.

    A month's candidates are then dealt out by those buckets and meet the stored codes where they lie: the
    history is read without an exchange. The session's catalog knows the table, the files are at ``path``.
    """
    name = "consent_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (TABLA STRING, CODE STRING) USING parquet "
              f"CLUSTERED BY (TABLA, CODE) SORTED BY (TABLA, CODE) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return name


def append_consent(rows: DataFrame, name: str, buckets: int = HISTORY_BUCKETS) -> None:
    """Append codes to a stored history; rows without a code are never found again, so they need no place in it.

    New rows, not stored ones, are dealt out as the table is, so that an append adds one file a bucket.
    """
    rows.where(F.col("CODE").isNotNull()).select("TABLA", "CODE").repartition(buckets, "TABLA", "CODE").write.insertInto(name)


def consent_increment(leads: DataFrame, leads_digital: DataFrame, history: DataFrame, period: Period) -> DataFrame:
    """Rows to append: codes not yet stored in their table (NULL codes are always appended)."""
    cand = consent_candidates(leads, leads_digital, period)
    # Merged in place: a history that is bucketed by (table, code) moves neither by shuffle nor by broadcast.
    stored = history.select(F.col("TABLA").alias("_T"), F.col("CODE").alias("_C")).where(F.col("_C").isNotNull()).hint("merge")
    return cand.join(stored, (cand["TABLA"] == stored["_T"]) & (cand["CODE"] == stored["_C"]), "left_anti")


def consent_reset(leads: DataFrame, leads_digital: DataFrame, history: DataFrame, period: Period,
                  start_of_month: bool = True) -> DataFrame:
    """New history state. On the start-of-month run the history is cleared first, so the
    increment is every candidate; otherwise the stored rows are kept and the increment appended."""
    if start_of_month:
        return consent_candidates(leads, leads_digital, period)
    inc = consent_increment(leads, leads_digital, history, period)
    return history.select(*inc.columns).unionByName(inc)
