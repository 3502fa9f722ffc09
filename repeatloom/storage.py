"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is not set, in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        kept = getattr(spark.sparkContext, "_repeatloom_dir", None)
        if kept is None:
            kept = tempfile.mkdtemp(prefix="repeatloom-")
            spark.sparkContext._repeatloom_dir = kept
            atexit.register(shutil.rmtree, kept, True)
        found = f"file://{kept}"
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it survives lost executors, and
    what is planned on it does not repeat its plan."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
