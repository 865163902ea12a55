"""Intermediate tables in the cluster's shared folder, and reading the test tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a plain ``local[...]`` session (one process on one machine, as in tests) gets a temporary
    folder; any other session is an error, because its executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="panelweave-shared-")
        context.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per context, so that tasks can import them anywhere.

    The archive lies in the shared folder and reaches the executors as any file added to a Spark job does.
    """
    context = spark.sparkContext
    if not getattr(context, "_panelweave_shipped", False):
        package, archive = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        target = f"{shared_folder(spark)}/panelweave-code-{uuid.uuid4().hex}.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(target)
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        stream.write(bytearray(archive.getvalue()))
        stream.close()
        context.addPyFile(target)
        context._panelweave_shipped = True


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the files.

    This cuts the lineage, survives lost executors, and later readers get pruned columns and pushed filters.
    """
    path = f"{shared_folder(df.sparkSession)}/panelweave-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and nothing will read any more."""
    jvm = df.sparkSession.sparkContext._jvm
    hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
