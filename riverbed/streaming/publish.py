"""A table of the latest row of each key, kept by a stream: every micro-batch is one version that readers see whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the store adds.
BUCKET, VERSION = "_bucket", "_version"


class LatestTable:
    """Rows by key in a folder `path`, the newest by a version column.

    A micro-batch writes only the buckets of keys that it touches, as folder _version=<id>/_bucket=<n>; Spark marks the version complete when all of it is there, and readers take
    each bucket from its newest complete version. So an update costs what it touches, not the table, and a crash leaves an older whole state. A batch that is
    replayed finds its version complete and changes nothing; one that was cut off is written anew from the versions before it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], newer: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.newer, self.buckets = spark, path.rstrip("/"), keys, newer, buckets

    def _folder(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        where, fs = self._folder(name)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        found = (int(n.partition("=")[2]) for n in self._names() if n.startswith(VERSION))
        return sorted(v for v in found if "_SUCCESS" in self._names(f"{VERSION}={v}"))

    def _newest(self, before: int | None = None) -> dict[int, int]:
        """The newest complete version of each bucket; at most as many entries as there are buckets."""
        out: dict[int, int] = {}
        for v in self.versions():
            if before is None or v < before:
                out |= {int(n.partition("=")[2]): v for n in self._names(f"{VERSION}={v}") if n.startswith(BUCKET)}
        return out

    def _read(self, places: dict[int, int], schema: object) -> DataFrame | None:
        paths = [f"{self.path}/{VERSION}={v}/{BUCKET}={b}" for b, v in places.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, schema: object) -> DataFrame:
        """The table as the last complete version left it."""
        found = self._read(self._newest(), schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def merge(self, rows: DataFrame, version: int) -> bool:
        """Replaces the rows of keys for which rows has a newer one. False if that version, or a later one, is complete already."""
        done = self.versions()
        if done and done[-1] >= version:
            return False
        schema = rows.schema
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rest = [c for c in rows.columns if c not in self.keys]
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # no more than there are buckets
        old = self._read({b: v for b, v in self._newest(version).items() if b in touched}, schema)
        # of rows that are equally new the stored one stays
        place = lambda df, stored: df.withColumn("_place", F.struct(F.col(self.newer).alias("n"), F.lit(stored).alias("s")))
        both = place(rows, False) if old is None else place(old, True).unionByName(place(rows, False))
        latest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_place").alias("_row")).select(*self.keys, "_row.*").select(rows.columns)
        target = f"{self.path}/{VERSION}={version}"
        latest.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        return True

    def sink(self, accepted: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: merges what accepted leaves of a micro-batch, as the version of its number."""

        def write(df: DataFrame, batch_id: int) -> None:
            self.merge(accepted(df), batch_id)

        return write

    def vacuum(self) -> None:
        """Deletes folders of buckets that a newer complete version replaces, but never the newest version itself; no reader may be at work on an older one."""
        newest = self._newest()
        done = self.versions()
        for v in done[:-1]:
            for name in self._names(f"{VERSION}={v}"):
                if name.startswith(BUCKET) and newest[int(name.partition("=")[2])] != v:
                    where, fs = self._folder(f"{VERSION}={v}/{name}")
                    fs.delete(where, True)
