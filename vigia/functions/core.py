"""Reusable column expressions and skew-safe DataFrame patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.params import Period


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_crlf(c: str | Column) -> Column:
    """Remove carriage returns and line feeds."""
    return F.translate(col(c), "\r\n", "")


def fold(c: str | Column) -> Column:
    """Case- and blank-insensitive comparison key (text declared NOT CASESPECIFIC)."""
    return F.upper(F.trim(col(c)))


def in_month(c: str | Column, period: Period) -> Column:
    """The raw column lies in the run's month: a range of literals, which reaches the scan."""
    return (col(c) >= F.lit(period.fec_inicio_mes)) & (col(c) < F.lit(period.fec_inicio_mes_sig))


def by_rows(df: DataFrame) -> DataFrame:
    """A table that grows with the data and is sorted and merged wherever it is joined.

    Before it runs, Spark takes the size of a stored table from its packed files. Ours pack to a hundredth (codes,
    periods and scores repeat), so millions of rows would look like a few megabytes and be collected by the driver
    to be broadcast.
    """
    return df.hint("merge")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = (),
               cols: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the smallest by ``order`` then by all remaining columns.

    Expressed as ``groupBy(keys).agg(min(struct(...)))`` rather than a
    ``row_number`` window so the choice is made by partial (map-side)
    aggregation: a key holding a third of all rows is reduced inside every map
    task before the shuffle. The struct makes it a sort aggregate, so each input
    partition is sorted by key; no group is gathered to be sorted as a whole.
    ``order`` entries sort ascending with NULLs first (Spark's struct order);
    pass ``-col`` / ``F.desc``-like negations for descending numeric keys.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    order_exprs = [col(o).alias(f"__o{i}") for i, o in enumerate(order)]
    packed = F.min(F.struct(*order_exprs, *[F.col(c) for c in cols])).alias("__m")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in cols])


def with_group_aggs(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach whole-group aggregates to every row (``agg() OVER (PARTITION BY keys)``).

    Computed as a partial aggregation joined back on the keys (NULL-safe), which
    lets AQE broadcast the aggregate or split a skewed key instead of sorting a
    whole hot partition inside one window task.
    """
    g = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    g = g.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *aggs.keys())
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(g[f"__k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(g, cond, "left").drop(*[f"__k_{k}" for k in keys])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used at result boundaries for comparisons)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
