"""Writers: JSON lines, reports, exports of several artifacts with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20


def write_trace(df: DataFrame, path: str, compress: bool = True) -> None:
    """JSON lines; fails if the target exists. Spark's commit makes all files visible at once or none."""
    df.write.mode("errorifexists").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "false").json(path)


def write_report(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """Text lines in a stated order, each partition a range of it."""
    lines.orderBy(*order).select(F.col(text).alias("value")).write.mode("errorifexists").text(path)


def json_bytes(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def manifest(samples: DataFrame, module: str, source: str, signature: str) -> DataFrame:
    """Per module: samples, distinct supervision, and a digest of all rows that does not depend on their order; per source too."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    told = samples.withColumn("_row", row)
    return told.groupBy(module, source).agg(F.count("*").alias("samples"), F.count_distinct(signature).alias("distinct_samples"), F.sum("_row").alias("digest"))


def export(artifacts: dict[str, DataFrame], root: str, most_bytes: int = MOST_BYTES) -> int:
    """Writes each artifact below root, after checking the size of all together; returns the bytes."""
    total = sum(json_bytes(df) for df in artifacts.values())
    if total > most_bytes:
        raise ValueError(f"export of {total} bytes is over {most_bytes}")
    for name, df in artifacts.items():
        write_trace(df, f"{root}/{name}", compress=False)
    return total


def artifact_hashes(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """artifact, files, bytes, sha256 of exported artifacts: the digest of their files' digests in the order of names. Executors read the files; a digest and a size of each are gathered."""
    parts = None
    for name in names:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/{name}")
        one = found.select(F.lit(name).alias("artifact"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha"))
        parts = one if parts is None else parts.unionByName(one)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "sha"))), lambda x: x["sha"]), "\n")
    return parts.groupBy("artifact").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(joined.cast("binary"), 256).alias("sha256"))


def export_with_manifest(artifacts: dict[str, DataFrame], counts: DataFrame, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Exports artifacts, then writes and returns their manifest beside them: the counts of manifest() and the artifacts' digests, one JSON row. A reader that finds a manifest finds all that it names."""
    export(artifacts, root, most_bytes)
    spark = counts.sparkSession
    hashes = artifact_hashes(spark, root, list(artifacts)).agg(F.array_sort(F.collect_list(F.struct("artifact", "files", "bytes", "sha256"))).alias("artifacts"), F.lit(1).alias("_one"))
    told = counts.agg(F.array_sort(F.collect_list(F.struct(*counts.columns))).alias("counts"), F.sum("samples").alias("samples"), F.lit(1).alias("_one")).join(hashes, "_one").drop("_one")  # one row each
    told.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{root}/manifest")
    return spark.read.schema(told.schema).json(f"{root}/manifest")
