"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from answerlens.sources.stored import shared_dir


class Scratch:
    """Written tables that cut lineage: lost executors reread files instead of recomputing the job.

    ``save`` writes a table and returns it as read back; ``drop`` deletes one that no later step reads, ``keep`` all but
    those that the result reads; ``close`` deletes what is left once the result is written. Spark deletes the shuffle files
    of a finished write when the driver collects the plan as garbage, so ``save`` asks for that at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/answerlens-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def save(self, df: DataFrame, name: str, *, scan: bool = False, wait: float = 0.0) -> DataFrame:
        """Writes with up to four tasks per core, which read several shuffle partitions in turn; ``scan`` keeps the
        tasks of a scan, whose splits are large. ``wait`` gives executors that many seconds to delete shuffle files,
        for steps that leave many."""
        if not scan:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.base}/{name}-{len(self.kept)}"
        df.write.parquet(path)
        for _ in range(2 if wait else 1):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(wait / 2)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables written here but these."""
        mine = {id(t) for t in tables}
        self.drop(*[t for t in self.kept if id(t) in self.paths and id(t) not in mine])

    def close(self) -> None:
        self.keep()
