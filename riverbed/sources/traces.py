"""Readers of traces and documents: JSON lines (plain or gzip), JSON documents, logs, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _case(df: DataFrame) -> DataFrame:
    """Adds case_id, the file's name without its endings."""
    return df.withColumn("case_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def read_trace(spark: SparkSession, root: str, case_id: str, schema: T.StructType | str, suffix: str = ".frames.jsonl") -> DataFrame:
    """The trace of a case: a plain file wins over a gzip one, a missing one gives no rows, blank lines are left out."""
    for path in (f"{root}/{case_id}{suffix}", f"{root}/{case_id}{suffix}.gz"):
        if _exists(spark, path):
            return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


def read_traces(spark: SparkSession, glob: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """All traces of a pattern with their case_id; strict: a malformed line fails the query."""
    return _case(spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(glob))


def read_documents(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """Whole files as one nested record each."""
    return _case(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(glob))


def read_log(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """White-space separated integers by position; a missing file gives no rows."""
    schema = ", ".join(f"{c} long" for c in columns)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, F.lit(k)).cast("long").alias(c) for k, c in enumerate(columns)])


def path_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Keys that a path spells, by the groups of a pattern."""
    return df.withColumns({n: F.regexp_extract(F.col("_metadata.file_path"), pattern, k + 1) for k, n in enumerate(names)})


def manifest_violations(spark: SparkSession, glob: str, expected: DataFrame) -> DataFrame:
    """(name, label) of files whose SHA-256 differs from expected (name, sha256), that are missing, or that nobody expects."""
    found = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("got"))
    both = found.join(expected, "name", "full_outer")
    label = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("got") != F.col("sha256"), "digest")
    return both.select("name", label.alias("label")).filter("label is not null")


def read_number(spark: SparkSession, path: str) -> int | None:
    """The whole number that a small text file holds, such as an exit code; None if it is missing or holds something else."""
    if not _exists(spark, path):
        return None
    lines = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).select(F.when(F.col("v").rlike(r"\A-?[0-9]+\z"), F.col("v").cast("long")))
    return lines.first()[0]


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """The files of a pattern with position (from 0 in order of names), name and size; only names are read, not contents."""
    from pyspark.sql.window import Window

    found = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"))
    return found.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("position"), "name", "size")


def read_fixed_samples(spark: SparkSession, path: str, sha256: str, key: str, samples: int, schema: T.StructType | str) -> DataFrame:
    """The samples of a manifest (a JSON array of records) that is fixed: ValueError unless its bytes have that digest, and it holds so many samples, each key once."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != sha256:
        raise ValueError(f"{path} has the digest {got}, not {sha256}")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    n, distinct = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if n != samples or distinct != samples:
        raise ValueError(f"{path} holds {n} samples, {distinct} of them different, not {samples}")
    return rows
