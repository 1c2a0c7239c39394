"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Settings the jobs rely on for their results (not only for speed).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
}

# Settings for throughput; a cluster overrides them as it likes.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app_name: str = "tidemark",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``master`` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **TUNING_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new empty folder that every executor can reach.

    The parent is ``spark.checkpoint.dir``. Only a local master may do without
    that setting: there a temporary folder is shared by construction.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        parent = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", parent)
    return f"{parent.rstrip('/')}/tidemark-{purpose}-{uuid.uuid4().hex}"


def literal_table(df: DataFrame, most_rows: int, what: str) -> DataFrame:
    """A result with one row per ``what`` as a broadcast literal table; beyond ``most_rows`` it fails.

    For results whose size does not follow the data, such as one row per log partition.
    """
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows where one per {what} was expected")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
