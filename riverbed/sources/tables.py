"""Readers of the driver's tables, with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverbed.functions.scalars import micros


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The event table with us, the microseconds of ts, in its place."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("us", micros("ts")).select("us", *(columns or ("event_id", "user_id", "event_type", "value", "props")))
