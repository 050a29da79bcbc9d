"""A folder that the driver and all executors share, for files that queries write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder, a cluster ValueError."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="levelcast-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return f"{base}/levelcast-files/{sc.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows neither computes it twice nor depends on executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that still read it must have been written elsewhere."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "x")).getParent()
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
