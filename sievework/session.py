"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "sievework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under.

    On a cluster pass no master; memory, executors and the checkpoint folder come from the submit command.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # vectors and whole texts are wide rows: smaller batches keep one batch within a few MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; a private one is made only in local mode."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "sievework-" + spark.sparkContext.applicationId)


def new_workspace(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once and go on from the written copy; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of few files; inputs with enough partitions, as large ones have, are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


BROADCAST_ROWS = 1_000_000


def fetch(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of their rows. The hits are written once; while they are short they are broadcast, and the
    rows, whole texts mostly, are read in place instead of being shuffled."""
    return rows.join(broadcast_if_short(cut_lineage(hits)), key)


def broadcast_if_short(written: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of a few numbers per row for broadcast when it is short enough, about 60 MB at the limit."""
    return F.broadcast(written) if written.count() <= limit else written
