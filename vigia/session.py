"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that matter for the month pipelines: AQE re-plans joins from runtime
# sizes (small dimension sides become broadcasts without a hint), coalesces
# tiny shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "vigia", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        b = b.config("spark.driver.memory", os.environ.get("VIGIA_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is;
    a machine-local folder is only chosen for local test sessions.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if not cur:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        cur = tempfile.mkdtemp(prefix="vigia-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", cur)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return cur


# Row groups of stage tables: parquet splits by row group, so a table that AQE wrote from a few
# coalesced partitions is still read back by many tasks. The same on a laptop and a cluster.
_STAGE_ROW_GROUP = 16 * 1024 * 1024


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Computed once (a reliable RDD checkpoint would run the plan twice), safe
    against executor loss (the files live in the cluster's shared
    ``spark.checkpoint.dir``), and the re-read scan carries real file sizes, so
    AQE/CBO size checks (broadcast or not) see the true size of the stage. The
    folder goes when the application ends; ``vigia.stage.rowGroupBytes``
    overrides the row-group size.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/vigia-tables/{name}-{uuid.uuid4().hex}"
    block = int(spark.conf.get("vigia.stage.rowGroupBytes", str(_STAGE_ROW_GROUP)))
    df.write.mode("overwrite").option("parquet.block.size", block).option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
