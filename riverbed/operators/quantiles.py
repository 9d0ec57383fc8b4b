"""Exact quantiles: groups of few rows by one sort, large ones by rank selection: counts by range, then a finer look at the one range that holds a rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators import sequence as S
from riverbed.sources.scratch import Tables

#: Ranges that a range is cut into, each round.
RANGES = 1024
#: Rows of groups of few rows that a task sorts.
PART_ROWS = 500_000


def _share(v: Column, low: Column, high: Column) -> Column:
    """Where v lies from low (0) to high (1), so that larger values never lie lower: by difference where all of the range has one sign and size, else by logarithm, so that a
    few rounds do for values of any size."""
    near = (F.signum(low) == F.signum(high)) & (F.greatest(F.abs(low), F.abs(high)) <= 4 * F.least(F.abs(low), F.abs(high)))
    place = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745))  # noqa: E731  745: all doubles but zero have a larger logarithm than -745
    return F.when(near, (v - low) / (high - low)).otherwise((place(v) - place(low)) / (place(high) - place(low)))


def _interpolated(ends: DataFrame, keys: list[str], quantiles: dict[str, float], decimals: int | None) -> DataFrame:
    """keys, n, quantiles, max from n, high and the values at the ranks beside each quantile, name_a and name_b."""
    result = []
    for name, q in quantiles.items():
        share = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        x = F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * share
        result.append((x if decimals is None else F.round(x, decimals)).alias(name))
    return ends.select(*keys, "n", *result, F.col("high").alias("max"))


def _rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*keys, F.when(~F.isnan(v), v).alias("v"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], decimals: int | None = 6) -> DataFrame:
    """What exact_quantiles returns, by one sort of df by keys and value. A group lies in one task: df should be dealt by keys, or some of them, to parts that a task can sort; it is not shuffled again then."""
    w = S.by(keys, [F.col("v").asc_nulls_last()])
    of_group = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = _rows(df, keys, value).select(*keys, "v", (F.row_number().over(w) - 1).alias("rank"), F.count("v").over(of_group).alias("n"))
    at = lambda side, q: F.max(F.when(F.col("rank") == side((F.col("n") - 1) * F.lit(q)), F.col("v")))
    beside = [at(side, q).alias(f"{name}_{s}") for name, q in quantiles.items() for s, side in (("a", F.floor), ("b", F.ceil))]
    return _interpolated(ranked.groupBy(*keys).agg(F.max("n").alias("n"), *beside, F.max("v").alias("high")), keys, quantiles, decimals)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], decimals: int | None = 6, few: int = 20_000, known: int = 100_000, dealt: bool = False) -> DataFrame:
    """keys, n, a column for each quantile (linear interpolation at (n - 1) q) and max, for every group of df; nulls and NaN do not count, values must be finite.

    Groups of no more than few values are dealt by keys to parts whose number grows with their rows, and sorted there; dealt: df is so already, by keys or some of them. No rank of theirs is looked for.

    Ranks of larger groups are looked for in rounds. In each, executors count a group's values by range, and combine the counts before the shuffle, so neither a task nor a buffer grows with a group. The range
    that holds a rank is cut in the next round, until it holds one value or no more than few values, which are then sorted. Each round reads df again (a thousandth of the range each time: two or three
    rounds for any size), so df should be cheap to read. The table of ranks has a few rows a large group; it is broadcast up to known rows and joined otherwise.
    """
    spark = df.sparkSession
    tables = Tables(spark)
    rows = _rows(df, keys, value)
    held = rows.filter("v is not null")
    stats = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    stats = tables.save(stats)
    is_large = F.col("n") > few
    large_groups, small_rows = stats.agg(F.count_if(is_large), F.coalesce(F.sum(F.when(~is_large, F.col("n"))), F.lit(0))).first()
    many = large_groups * 2 * len(quantiles) > known
    side = (lambda t: t) if many else F.broadcast
    t_key = [F.col(k).alias(f"t_{k}") for k in keys]
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys], F.lit(True))
    no_value = [F.lit(None).cast("double").alias(f"{name}_{s}") for name in quantiles for s in "ab"]
    out = _interpolated(stats.filter("n = 0").select("*", *no_value), keys, quantiles, decimals)
    if small_rows:
        small = held.join(side(stats.filter(is_large).select(*t_key)), on, "left_anti") if large_groups else held
        out = out.unionByName(group_quantiles(small if dealt else S.dealt(small, keys, small_rows, PART_ROWS), keys, "v", quantiles, decimals))
    if not large_groups:
        return out
    ranks = []
    for name, q in quantiles.items():
        at = (F.col("n") - 1) * F.lit(q)
        for end, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            ranks.append(F.struct(F.lit(f"{name}_{end}").alias("name"), rank.cast("long").alias("rank")))
    wanted = stats.filter(is_large).select(*keys, F.explode(F.array(*ranks)).alias("r"), "low", "high", F.col("n").alias("held")).select(*keys, "r.*", "low", "high", "held")
    done: list[DataFrame] = []
    within = on & F.col("v").between(F.col("low"), F.col("high"))
    while True:
        wanted = tables.save(wanted)
        done.append(wanted.filter((F.col("low") == F.col("high")) | (F.col("held") <= few)))
        wide = wanted.filter((F.col("low") < F.col("high")) & (F.col("held") > few))
        if wide.isEmpty():
            break
        part = F.least(F.lit(RANGES - 1), F.floor(_share(F.col("v"), F.col("low"), F.col("high")) * RANGES))
        met = held.join(side(wide.select(*t_key, "name", "rank", "low", "high")), within)
        counts = met.groupBy(*[f"t_{k}" for k in keys], "name", "rank", part.alias("part")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("held").over(Window.partitionBy(*[f"t_{k}" for k in keys], "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held")))
        wanted = found.select(*[F.col(f"t_{k}").alias(k) for k in keys], "name", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "held")
    ends = reduce(DataFrame.unionByName, done)
    # a range of one value needs no look; ranks in the same short range share its sorted values
    flat = ends.filter("low = high").select(*keys, "name", F.col("low").alias("x"))
    short = ends.filter("low < high").groupBy(*keys, "low", "high").agg(F.collect_list(F.struct("name", "rank")).alias("ranks"))
    met = held.join(side(short.select(*t_key, "low", "high", "ranks")), within)
    names = [f"t_{k}" for k in keys]
    sorted_values = met.groupBy(*names, "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("ranks").alias("ranks"))
    picked = sorted_values.select(*[F.col(f"t_{k}").alias(k) for k in keys], F.explode(F.transform("ranks", lambda r: F.struct(r["name"].alias("name"), F.get(F.col("vs"), r["rank"].cast("int")).alias("x")))).alias("p")).select(*keys, "p.*")
    values = flat.unionByName(picked)
    by_name = values.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{name}_{s}", F.col("x"))).alias(f"{name}_{s}") for name in quantiles for s in "ab"])
    ends = stats.filter(is_large).join(by_name.select(*t_key, *[c for c in by_name.columns if c not in keys]), on, "left")
    return out.unionByName(_interpolated(ends, keys, quantiles, decimals))
