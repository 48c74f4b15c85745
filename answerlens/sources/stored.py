"""Tables that several parts of a query read: written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.answerlens.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark is local (tests), one temporary folder per session,
    which goes with the process. On a cluster the setting must be there, and its tables are the cluster's to clear."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        own = tempfile.mkdtemp(prefix="spark-answerlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set(_OWN, base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as read back from a table under shared_dir, so that consumers scan it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/answerlens-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
