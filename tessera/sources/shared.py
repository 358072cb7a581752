"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "tessera.local.shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without that setting a local session, as in tests, gets a folder of this machine; a session on a cluster is refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get(LOCAL, None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
            spark.conf.set(LOCAL, folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once, as a Parquet table of the shared folder: its plan ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
