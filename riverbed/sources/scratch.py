"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a single machine that has none, a temporary folder that goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="riverbed-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return "file://" + local


class Tables:
    """Tables written as Parquet and read back, which cuts their lineage; a lost executor takes nothing away."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{scratch_root(spark)}/riverbed-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path, schema = f"{self.root}/{self.count}", df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
