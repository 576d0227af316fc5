"""Run-time audits: source row counts, feed month check, reporting window."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigia.params import Period


def audit_source_counts(sources: list[tuple[str, DataFrame, Column | None]]) -> DataFrame:
    """Row count per configured source with its filter; status VACIA/OK (non-blocking).

    The counts of one table, whatever their filters, come from one aggregate over one scan.
    """
    tables: dict[int, tuple[DataFrame, list]] = {}
    for name, df, cond in sources:
        tables.setdefault(id(df), (df, []))[1].append((name, F.lit(True) if cond is None else cond))
    out = None
    for df, counts in tables.values():
        x = df.agg(*[F.count_if(cond).alias(f"c{k}") for k, (_, cond) in enumerate(counts)])
        x = x.select(F.explode(F.array(*[F.struct(F.lit(name).alias("TABLA"), F.col(f"c{k}").alias("FILAS"))
                                         for k, (name, _) in enumerate(counts)])).alias("c")).select("c.*")
        out = x if out is None else out.unionByName(x)
    return out.withColumn("ESTADO", F.when(F.col("FILAS") == 0, F.lit("VACIA")).otherwise(F.lit("OK")))


def audit_feed_period(feed: DataFrame, date_col: str, period: Period, name: str) -> DataFrame:
    """Rows, latest date and whether the feed is usable for the month (non-empty, latest date in the month)."""
    return _period_check(feed.agg(F.count(F.lit(1)).alias("FILAS"), F.max(date_col).alias("FECHA_MAX")).withColumn("TABLA", F.lit(name)), period)


@dataclass(frozen=True)
class FeedAudit:
    """What to count of a feed while it is stored: rows by named condition (SQL), rows and latest date under ``feed``."""
    counts: dict[str, str]
    feed: str | None = None
    date_col: str | None = None

    def on(self, df: DataFrame) -> tuple[DataFrame, StoredAudit]:
        """``df`` that counts itself when it is written, and where the counts will stand."""
        seen = Observation()
        metrics = [F.count_if(F.expr(cond)).alias(f"c{k}") for k, cond in enumerate(self.counts.values())]
        metrics += [F.count(F.lit(1)).alias("FILAS")] + ([F.max(self.date_col).alias("FECHA_MAX")] if self.date_col else [])
        return df.observe(seen, *metrics), StoredAudit(self, seen)


@dataclass(frozen=True)
class StoredAudit:
    """The counts of a stored feed: numbers that came with the write, no scan."""
    audit: FeedAudit
    seen: Observation


def source_counts(spark: SparkSession, stored: list[StoredAudit]) -> DataFrame:
    """:func:`audit_source_counts` of feeds that were observed while they were stored."""
    rows = [(name, s.seen.get[f"c{k}"]) for s in stored for k, name in enumerate(s.audit.counts)]
    out = spark.createDataFrame(rows, "TABLA string, FILAS long")
    return out.withColumn("ESTADO", F.when(F.col("FILAS") == 0, F.lit("VACIA")).otherwise(F.lit("OK")))


def feed_periods(spark: SparkSession, stored: list[StoredAudit], period: Period) -> DataFrame:
    """:func:`audit_feed_period` of feeds that were observed while they were stored."""
    rows = [(s.audit.feed, s.seen.get["FILAS"], s.seen.get["FECHA_MAX"]) for s in stored]
    return _period_check(spark.createDataFrame(rows, "TABLA string, FILAS long, FECHA_MAX timestamp_ntz"), period)


def _period_check(df: DataFrame, period: Period) -> DataFrame:
    month = F.date_format("FECHA_MAX", "yyyyMM")
    ok = (F.col("FILAS") > 0) & (month == period.periodo)
    return df.select("TABLA", "FILAS", "FECHA_MAX", month.alias("PERIODO_MAX"), F.coalesce(ok, F.lit(False)).alias("OK"))


def assert_feed_period(check: DataFrame) -> None:
    """Abort the run when a feed check fails (the check is one row per feed)."""
    bad = check.where(~F.col("OK")).select("TABLA").collect()  # one row per configured feed
    if bad:
        raise ValueError(f"feeds not usable for the month: {[r[0] for r in bad]}")


def reporting_window_bounds(period: Period, today: dt.date) -> tuple[dt.date, dt.date]:
    """From the 15th of the previous month to the month's last day (or today when earlier)."""
    end = period.fec_fin_mes if (period.anio, period.mes) != (today.year, today.month) else today
    first = end.replace(day=1)
    start = (first - dt.timedelta(days=1)).replace(day=15)
    return start, min(end, today)


def reporting_window(df: DataFrame, date_col: str, period: Period, today: dt.date) -> DataFrame:
    start, end = reporting_window_bounds(period, today)
    return df.where((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end + dt.timedelta(days=1))))
