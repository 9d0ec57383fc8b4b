"""As-of, barrier, existence and difference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.sequence import by, so_far


def asof(df: DataFrame, keys: list[str], order: list[str], value: Column, matches: Column, forward: bool = False) -> Column:
    """The value at the nearest matching row of the key, at or before each row, or after it.

    One sort of the key's rows serves both sides; there is no join and no pair is made.
    """
    w = by(keys, order)
    if forward:  # backward in the opposite order: a frame that grows row by row, where one to the end would be read anew for every row
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return F.last(F.when(matches, value), ignorenulls=True).over(so_far(w))


def barrier(df: DataFrame, keys: list[str], lane: str, lanes: list[str]) -> DataFrame:
    """Keys that have every lane exactly once."""
    counts = df.filter(F.col(lane).isin(lanes)).groupBy(*keys).agg(*[F.count_if(F.col(lane) == x).alias(x) for x in lanes])
    complete = F.lit(True)
    for x in lanes:
        complete = complete & (F.col(x) == 1)
    return counts.filter(complete).select(*keys)


def trace_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entries of two aligned traces that differ or that one of them lacks, also where the other's value is null."""
    l, r = (df.select(*keys, F.col(value).alias(f"{side}_value"), F.lit(True).alias(f"_{side}")) for df, side in ((left, "left"), (right, "right")))
    differs = F.col("_left").isNull() | F.col("_right").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))
    return l.join(r, keys, "full_outer").filter(differs).drop("_left", "_right")


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the same position (from 0) in both sides of a key; what the longer side has beyond is left out."""
    w = by(keys, [order])
    place = lambda df: df.withColumn("position", (F.row_number().over(w) - 1).cast("long")).drop(order)
    return place(left).join(place(right), [*keys, "position"])


def coverage(planned: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of keys on both sides and on one side only."""
    both = planned.select(key).distinct().withColumn("p", F.lit(True)).join(actual.select(key).distinct().withColumn("a", F.lit(True)), key, "full_outer")
    return both.agg(
        F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("both"), F.count_if(F.col("a").isNull()).alias("left_only"), F.count_if(F.col("p").isNull()).alias("right_only")
    )


def slice_spans(df: DataFrame, begin: int, end: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """The parts of spans within [begin, end), counted from begin."""
    inside = df.filter((F.col(start) < end) & (F.col(stop) > begin))
    return inside.withColumn("slice_start", F.greatest(F.col(start), F.lit(begin)) - begin).withColumn("slice_stop", F.least(F.col(stop), F.lit(end)) - begin)
