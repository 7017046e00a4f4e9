"""Session defaults and the few helpers that depend on the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; a cluster's own settings may be passed in `conf`."""
    builder = SparkSession.builder.appName("sentinela")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A folder that all machines see, for tables of one job: `spark.checkpoint.dir`, or in local mode, where that is unset, one of
    this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="work-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy text work on an input with fewer scan tasks than cores.

    A file with a single row group is one scan task whatever its size. Large inputs have far more
    tasks than cores, and then nothing is shuffled. Meant for a table as read: counting the tasks of a
    DataFrame with joins would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
