"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir.

    Only a local session, whose driver and tasks share one machine, gets a folder of our own where
    none is set; on a cluster nothing that the driver makes up would be shared.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read again.

    A table rather than checkpoint(): a checkpoint keeps the size that its plan was estimated at, and
    over the rounds of an iteration those products of products make planning itself slow.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove checkpointed tables that nothing reads any more."""
    for df in tables:
        for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(uri)
            if path.getName().startswith("table-"):
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
