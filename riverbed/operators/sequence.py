"""Rules and folds over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dealt(df: DataFrame, keys: list[str], rows: int, part_rows: int = 100_000) -> DataFrame:
    """df dealt by keys to parts whose number grows with rows, so that what a task holds does not, and no core is idle where rows are small but dear. Windows and groups over these keys and more need no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // part_rows)), *keys)


def sequence_gaps(df: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Rows whose step is not their position from 0; expected is the position."""
    return df.withColumn("expected", (F.row_number().over(by(keys, [step])) - 1).cast("long")).filter(F.col(step) != F.col("expected"))


def append_only(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Rows whose text does not start with the text before them."""
    return df.withColumn("_before", F.coalesce(F.lag(text).over(by(keys, order)), F.lit(""))).filter(~F.col(text).startswith(F.col("_before"))).drop("_before")


def prefix_delta(text: Column, w: WindowSpec) -> Column:
    """What a text adds to the one before."""
    return F.substr(text, F.coalesce(F.length(F.lag(text).over(w)), F.lit(0)) + 1)


def running_count(condition: Column, w: WindowSpec) -> Column:
    return F.sum(condition.cast("long")).over(so_far(w))


def carry_forward(value: Column, changes: Column, w: WindowSpec) -> Column:
    """The value at the last row where something changed."""
    return F.last(F.when(changes, value), ignorenulls=True).over(so_far(w))


def overlaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows that start before the end of the row before them."""
    return df.withColumn("previous_end", F.lag(end).over(by(keys, order))).filter(F.col(start) < F.col("previous_end"))


def merge_runs(df: DataFrame, keys: list[str], order: str, role: str, text: str) -> DataFrame:
    """Consecutive rows of a role as one, texts joined by a blank: keys, run (from 0), role, n, text."""
    w = by(keys, [order])
    change = F.coalesce(F.lag(role).over(w) != F.col(role), F.lit(True))
    runs = df.withColumn("_change", change).withColumn("run", running_count(F.col("_change"), w) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return runs.groupBy(*keys, "run", role).agg(F.count("*").alias("n"), joined.alias(text))


def lifecycle_violations(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Rows that open while something is open or close while nothing is; active counts opened minus closed up to the row."""
    active = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far(by(keys, order))).cast("long")
    return df.withColumn("active", active).filter((opens & (F.col("active") > 1)) | (closes & (F.col("active") < 0)))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, a row number would not."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
