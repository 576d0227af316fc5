"""Feed readers: delimited files, reports with a preamble, feed folders, a JDBC source.

Every reader returns a lazy DataFrame over the whole set of files; Spark splits
and parallelises the scan. Only file *names and sizes* (listing metadata) and
one header line are looked at on the driver.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.operators.cleaning import sanitize_identifier  # noqa: F401  (re-exported for callers)


def read_csv_tolerant(spark: SparkSession, paths: str | list[str], infer: bool = False) -> DataFrame:
    """Comma file with header; rows longer than the header are cut (PERMISSIVE drops extra tokens),
    short rows are padded with NULL."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", infer)
            .option("enforceSchema", False).csv(paths))


def read_tsv_all_string(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab feed, every column text (typed later by the template)."""
    return (spark.read.option("header", True).option("sep", "\t").option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(paths))


def read_report_with_preamble(spark: SparkSession, paths: str | list[str], header_line: int = 29,
                              sep: str = ",") -> DataFrame:
    """Delimited report whose header is on line ``header_line`` of every file.

    Line numbers are only needed inside each file's first split: a split is read
    in file order by one task, so ids that increase within a task, less the least
    id of the (file, first split), are line numbers; every row of a later split
    is data. Each file has its own header: columns are the names of all headers,
    in order of first appearance by file, and a row's cells go to the names of
    its file. Blank header cells become ``column_{i}``; missing cells and blank
    values become NULL, cells beyond the header are cut. A cell in double quotes may
    hold separators and doubled quotes (not line ends: a line is a row). The driver
    holds the header lines, one a file.
    """
    raw = spark.read.text(paths).select(
        F.col("value").alias("_L"), F.col("_metadata.file_path").alias("_F"),
        F.col("_metadata.file_block_start").alias("_B"), F.monotonically_increasing_id().alias("_ID"))
    starts = raw.where(F.col("_B") == 0).groupBy(F.col("_F").alias("_SF")).agg(F.min("_ID").alias("_FIRST"))
    numbered = raw.join(starts, raw["_F"] == starts["_SF"], "left").drop("_SF")
    line = F.when(F.col("_B") == 0, F.col("_ID") - F.col("_FIRST") + 1)
    found = numbered.where(line == header_line).select(F.col("_F").alias("_HF"), F.col("_L").alias("_H")).orderBy("_HF").collect()
    if not found:
        raise ValueError(f"no line {header_line} in {paths}")
    found = [{"_HF": r["_HF"], "_H": [x.strip() or f"column_{k}" for k, x in enumerate(next(csv.reader([r["_H"]], delimiter=sep), [""]), 1)]} for r in found]
    width = max(len(r["_H"]) for r in found)
    parsed = F.from_csv("_L", ", ".join(f"c{k} string" for k in range(width)), {"sep": sep, "quote": '"', "escape": '"'})
    cells = F.array(*[parsed[f"c{k}"] for k in range(width)])
    order = list(dict.fromkeys(n for r in found for n in r["_H"]))
    per_file = spark.createDataFrame([(r["_HF"], r["_H"]) for r in found], "_HF string, _H array<string>")
    data = numbered.where(F.coalesce(line > header_line, F.lit(True)))
    data = data.join(per_file, data["_F"] == per_file["_HF"]).select(cells.alias("_C"), "_H")
    out = []
    for n in order:
        at = F.array_position("_H", F.lit(n)).cast("int")
        v = F.when(at > 0, F.try_element_at("_C", at))
        out.append(F.when(F.trim(v) == "", F.lit(None)).otherwise(v).alias(n))
    return data.select(*out)


def list_feed_files(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files or export folders in ``folder`` whose name matches ``pattern`` (listing only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    rx = re.compile(pattern)
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not rx.search(name):
            continue
        size = st.getLen() if st.isFile() else fs.getContentSummary(st.getPath()).getLength()
        out.append((st.getPath().toString(), int(size)))
    return sorted(out)


def read_many_append(spark: SparkSession, folder: str, pattern: str, newest_only: bool = False,
                     sep: str = "\t") -> DataFrame | None:
    """Feed folder → one table. Parts of one extract are read together; for dated exports only the
    newest file name is used; zero-byte files are skipped (zero-row files add nothing)."""
    files = [(p, n) for p, n in list_feed_files(spark, folder, pattern) if n > 0]
    if not files:
        return None
    paths = [files[-1][0]] if newest_only else [p for p, _ in files]
    return (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(paths))


def jdbc_period_extract(spark: SparkSession, url: str, table: str, period_num: int, properties: dict,
                        num_partitions: int = 8, partition_column: str | None = None,
                        bounds: tuple[int, int] | None = None) -> DataFrame:
    """Read another RDBMS's table from a month on. The month predicate is pushed into the JDBC query;
    with a partition column the read is split into ``num_partitions`` parallel range queries."""
    q = f"(SELECT * FROM {table} WHERE periodo >= {int(period_num)}) src"
    r = spark.read.option("fetchsize", 50000)
    if partition_column and bounds:
        return r.jdbc(url, q, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                      numPartitions=num_partitions, properties=properties)
    return r.jdbc(url, q, properties=properties)


def disbursements_reshape(df: DataFrame, evaluated: DataFrame, run_ts) -> DataFrame:
    """Reshape extracted disbursements: renames, 8-char agent, person type by document length, evaluated flag."""
    n = F.length(F.trim(F.col("NUM_RUC").cast("string")))
    ev = evaluated.select(F.col("DOCUMENTO").alias("_EV")).distinct()
    x = df.select("FECHA_DESEMBOLSADO", "COD_UNICO", F.col("COD_DOC").alias("CODDOC"),
                  F.col("CLIENTE").alias("REPRESENTANTE_LEGAL"),
                  F.when(n == 8, "PN").when(n == 11, "PJ").otherwise("DESCONOCIDO").alias("TIPO_PERSONA"), "CANAL",
                  F.substring("REG_EJECUTIVO", 1, 8).alias("REGISTRO"), "NOM_EJECUTIVO", "COLOCACION_NETA",
                  F.col("CAMPANA_VPC").alias("CAMPANA_N2"))
    x = x.join(ev, x["CODDOC"] == ev["_EV"], "left")
    return x.select(*[c for c in x.columns if c != "_EV"],
                    F.when(F.col("_EV").isNotNull(), "SI").otherwise("NO").alias("EVALUADO"),
                    F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("FECHA_UPDATE"))
