"""Upload cleaning: template-driven projection and the column cleaner, as one ``select``.

Everything is a JVM column expression except Unicode NFKD accent stripping,
which Spark has no built-in for; that one runs as an Arrow-batched pandas UDF
that gets only the values that contain non-ASCII characters (the others arrive
as NULL). The cleaner limits text to U+00FF first and needs no Python.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES — text treated as NULL, default text length, type names offered by the uploader.
NULL_LITERALS = ("nan", "none", "<na>", "null")
DEFAULT_MAX_LEN = 3000
UPLOAD_TYPES = ("VARCHAR(255)", "INTEGER", "FLOAT", "TIMESTAMP", "DATE", "CHAR(1)")
# Formats tried, in order, for text → timestamp/date (explicit configuration).
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
                     "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")


# --------------------------------------------------------------------------- names and types

_WORD_RUN = re.compile(r"[A-Za-z0-9_]")
# Spark type → upload type; anything else is text.
_UPLOAD_TYPE = {T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER",
                T.FloatType: "FLOAT", T.DoubleType: "FLOAT", T.DecimalType: "FLOAT",
                T.DateType: "TIMESTAMP", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
                T.BooleanType: "CHAR(1)"}


def sanitize_identifier(name: str | None) -> str:
    """Non ``[A-Za-z0-9_]`` → ``_``; strip outer ``_``; leading digit gets ``_``; empty → ``column``."""
    kept = "".join(c if _WORD_RUN.match(c) else "_" for c in name or "").strip("_")
    return f"_{kept}" if kept[:1].isdigit() else kept or "column"


def is_sid_column(name: str | None, new_name: str | None = None) -> bool:
    """Identifier columns named like "clave … sid" always stay text."""
    words = f"{name or ''} {new_name or ''}".lower()
    return all(part in words for part in ("clave", "sid"))


def suggest_sql_type(dt: T.DataType) -> str:
    return _UPLOAD_TYPE.get(type(dt), UPLOAD_TYPES[0])


@dataclass(frozen=True)
class ColumnSelection:
    name: str
    new_name: str
    datatype: str
    selected: bool = True
    convert_nulls: bool = False


def selections_from_template(df: DataFrame, template: dict) -> list[ColumnSelection]:
    """Template JSON ``{column: {Añadir, Nuevo nombre, Null:0/No Null:1, Tipo de dato}}`` → selection list.

    Columns absent from the template are not selected. New names follow the
    identifier rule; a collision between two new names is an error.
    """
    out, seen = [], set()
    for f in df.schema.fields:
        t = template.get(f.name)
        if not t:
            continue
        new = sanitize_identifier(t.get("Nuevo nombre") or f.name)
        sel = bool(t.get("Añadir", True))
        if sel and new in seen:
            raise ValueError(f"duplicate target column name {new!r}")
        seen.add(new)
        dtype = t.get("Tipo de dato") or suggest_sql_type(f.dataType)
        out.append(ColumnSelection(f.name, new, dtype, sel, bool(t.get("Null:0/No Null:1", False))))
    return out


# --------------------------------------------------------------------------- column rules

def null_indicator(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1))


def null_literals(c: Column) -> Column:
    """Text ``nan``/``none``/``<na>``/``null`` (any case) → NULL."""
    return F.when(F.lower(c).isin(*NULL_LITERALS) | c.isNull(), F.lit(None).cast("string")).otherwise(c)


def latin1_truncate(c: Column, max_len: int = DEFAULT_MAX_LEN) -> Column:
    """Drop characters above U+00FF, then cut to ``max_len`` characters (in that order)."""
    return F.substring(F.regexp_replace(c, "[^\\x{00}-\\x{FF}]", ""), 1, max_len)


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def strip_accents(c: Column) -> Column:
    """NFKD-normalise and drop combining marks (``ñ→n``, ``ß`` stays, ``ﬁ→fi``).

    A Python function runs before the projection that holds it, so the condition is inside its
    argument: only texts beyond ASCII reach it, the others pass as NULL. Marks are dropped in the JVM.
    """
    beyond = F.when(c.rlike("[^\\x{00}-\\x{7F}]"), c)
    return F.coalesce(F.regexp_replace(_nfkd(beyond), r"\p{M}", ""), c)


def _latin1_forms() -> dict[str, str]:
    """Characters U+0080 to U+00FF whose compatibility form without marks differs from themselves."""
    forms = {chr(k): "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x)) for k in range(0x80, 0x100)}
    return {c: form for c, form in forms.items() if c != form}


def strip_accents_latin1(c: Column) -> Column:
    """:func:`strip_accents` for text limited to U+00FF: plain JVM replacements."""
    forms = _latin1_forms()
    one = {k: v for k, v in forms.items() if len(v) == 1}
    c = F.translate(c, "".join(one), "".join(one.values()))
    for long, form in ((k, v) for k, v in forms.items() if len(v) != 1):
        c = F.replace(c, F.lit(long), F.lit(form))
    return c


def char1(c: Column) -> Column:
    return F.substring(c, 1, 1)


def lenient_numeric(c: Column, kind: str) -> Column:
    """INTEGER/FLOAT cast; failures → NULL (Spark 4 ANSI ``cast`` would throw)."""
    return c.try_cast("bigint" if kind == "INTEGER" else "double")


def lenient_temporal(c: Column, kind: str, source_type: T.DataType) -> Column:
    """TIMESTAMP/DATE from text with a list of formats (failures → NULL); non-text by cast."""
    if isinstance(source_type, T.StringType):
        if kind == "DATE":
            return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS])
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")
    return c.try_cast("date" if kind == "DATE" else "timestamp_ntz")


def clean_column(df: DataFrame, sel: ColumnSelection, strip: bool, latin: bool, max_len: int) -> Column:
    c = F.col(sel.name)
    if sel.convert_nulls:
        return null_indicator(c).alias(sel.new_name)
    dtype = "VARCHAR(255)" if is_sid_column(sel.name, sel.new_name) else sel.datatype
    if dtype.startswith("VARCHAR") or dtype == "CHAR(1)":
        c = null_literals(c.cast("string"))
        if latin:
            c = latin1_truncate(c, max_len)
        if strip:
            c = strip_accents_latin1(c) if latin else strip_accents(c)
        if dtype == "CHAR(1)":
            c = char1(c)
    elif dtype in ("INTEGER", "FLOAT"):
        c = lenient_numeric(c, dtype)
    elif dtype in ("TIMESTAMP", "DATE"):
        c = lenient_temporal(c, dtype, df.schema[sel.name].dataType)
    return c.alias(sel.new_name)


def clean_frame(df: DataFrame, selections: list[ColumnSelection], strip_accents_flag: bool = True,
                latin: bool = True, max_len: int = DEFAULT_MAX_LEN) -> DataFrame:
    """The whole cleaner: all rules, in the reference's order, in one projection."""
    return df.select(*[clean_column(df, s, strip_accents_flag, latin, max_len) for s in selections if s.selected])


def template_project(df: DataFrame, template: dict) -> DataFrame:
    """Keep/rename/type the template's columns only (no text cleaning)."""
    sels = selections_from_template(df, template)
    out = []
    for s in sels:
        if not s.selected:
            continue
        dtype = "VARCHAR(255)" if is_sid_column(s.name, s.new_name) else s.datatype
        c = F.col(s.name)
        if dtype in ("INTEGER", "FLOAT"):
            c = lenient_numeric(c, dtype)
        elif dtype in ("TIMESTAMP", "DATE"):
            c = lenient_temporal(c, dtype, df.schema[s.name].dataType)
        else:
            c = c.cast("string")
        out.append(c.alias(s.new_name))
    return df.select(*out)


# --------------------------------------------------------------------------- profiling

def column_completeness(df: DataFrame) -> DataFrame:
    """Per column: non-NULL count and percentage of rows (one aggregation pass, then ``stack``)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', __c{i}" for i, c in enumerate(cols))
    long = one.selectExpr("__n", f"stack({len(cols)}, {pairs}) AS (COLUMNA, NO_NULOS)")
    return long.select("COLUMNA", F.col("NO_NULOS").cast("long").alias("NO_NULOS"),
                       F.round(F.when(F.col("__n") > 0, F.col("NO_NULOS") * 100.0 / F.col("__n")).otherwise(0.0), 2)
                       .alias("PORCENTAJE"))


def drop_empty_unnamed(df: DataFrame) -> DataFrame:
    """Drop ``Unnamed*`` columns that are entirely NULL (one count pass over those columns only)."""
    unnamed = [c for c in df.columns if c.startswith("Unnamed")]
    if not unnamed:
        return df
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in unnamed]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])
