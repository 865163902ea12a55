"""Session defaults and the one place that decides where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, **overrides: str) -> SparkSession:
    """A laptop session for tests and the bench; clusters bring their own, with ``spark.checkpoint.dir`` set."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelweave")
    shared = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="panelweave-shared-")}
    conf = {**DEFAULTS, **shared, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g", **overrides}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process: ``local`` or ``local[...]``, but not ``local-cluster[...]``."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    A session on several machines without that setting is an error: a private folder would lose what executors write. Only
    a session that is one process, as in tests, gets a temporary folder instead.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = context.getConf().get("spark.checkpoint.dir")
    if not target:
        if not one_machine(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        target = tempfile.mkdtemp(prefix="panelweave-shared-")
    context.setCheckpointDir(target)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read on from there.

    Used where several branches of a plan start from the same aggregated panel (so the raw scan runs once), where a
    partition number must stay what it was, and inside year-by-year loops (so the lineage stays short). The files survive
    the loss of executors, later readers get pruned columns and pushed filters, and the planner knows the table's size.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/panelweave/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
