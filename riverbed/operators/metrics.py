"""Exact distributions, conditional success metrics, gates and other aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distribution(x: Column | str, decimals: int = 6) -> list[Column]:
    """n, p50, p95 (linear interpolation at (n - 1) q) and max; nulls do not count; an empty input gives 0 and nulls."""
    x = F.col(x) if isinstance(x, str) else x
    return [F.count(x).alias("n"), F.round(F.percentile(x, 0.5), decimals).alias("p50"), F.round(F.percentile(x, 0.95), decimals).alias("p95"), F.max(x).alias("max")]


def units(x: Column, per: int = 1_000_000) -> Column:
    """x in whole parts, so many per unit, as a number whose sums are exact in any order; a sum of doubles depends on the order of its rows."""
    return F.round(x * per).cast("decimal(20,0)")


def exact_sum(x: Column, per: int = 1_000_000) -> Column:
    """The sum of x, each value first rounded to so many parts per unit."""
    return F.sum(units(x, per)).cast("double") / per


def success_report(ok: Column, latency: Column) -> list[Column]:
    """Rate over all rows, and over those that have one the mean latency, in whole microseconds, halves up."""
    mean = F.round(F.sum(units(latency)) / F.count(latency), 0).cast("double") / 1e6
    return [
        F.count("*").alias("n"), F.sum(ok.cast("int")).alias("successes"), F.round(F.avg(ok.cast("double")), 6).alias("rate"),
        F.count(latency).alias("latency_n"), F.when(F.count(latency) > 0, mean).alias("latency_mean"),
    ]


def gate(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (keys, failure) for each rule that holds in a row; a row that passes gives none."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return df.select(*keys, F.explode(labels).alias("failure"))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A union of one filter for each rule: keys and label of the rows that break it."""
    return reduce(DataFrame.unionByName, [df.filter(c).select(*keys, F.lit(k).alias("label")) for k, c in rules.items()])


def drift(x: str, order: Column) -> Column:
    """Last value minus first."""
    return F.max_by(x, order) - F.min_by(x, order)


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and by a fixed list of columns, zeros kept. Conditional counts need one partial aggregation and no second pass."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def budget_prefix(df: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """Rows in order until their sizes reach a budget, the last one cut: adds taken.

    Sums by block of the order column come first, so that the ordered pass reads only blocks below the budget.
    """
    width = 1024
    blocks = df.groupBy(F.floor(F.col(order) / width).alias("_block")).agg(F.sum(size).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before).filter(F.col("_before") < budget).drop("_sum")
    rows = df.withColumn("_block", F.floor(F.col(order) / width)).join(blocks, "_block")
    running = F.col("_before") + F.coalesce(F.sum(size).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", running).filter(F.col("_start") < budget)
    return rows.withColumn("taken", F.least(F.col(size), F.lit(budget) - F.col("_start"))).drop("_block", "_before", "_start")
