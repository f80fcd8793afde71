"""Steps written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may do without the setting, and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The folder within the shared one that holds the steps of the run that is going on.
RUN: ContextVar[str] = ContextVar("run", default="")


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is stored inside stands in one folder, which is removed at the end.

    Results are read from stored steps, so they must be written or collected before the end. A run that is killed leaves
    its folder behind. Without a run, stored steps stay until somebody clears the shared folder.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    before = RUN.set(folder)
    try:
        yield folder
    finally:
        RUN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    This cuts lineage with files that outlive any executor, and keeps a step
    with several readers from being computed for each of them.
    """
    path = f"{RUN.get() or shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
