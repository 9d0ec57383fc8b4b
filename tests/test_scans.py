"""Two-level scans against windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.joins import asof
from riverbed.operators.scans import Running, asof_scan, scan
from riverbed.operators.sequence import carry_forward, running_count


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows have one key; others are small, one is null; values and flags have nulls."""
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice([None, *"abcdefghijkl"])
    data = [(key(), rng.randrange(500), k, rng.choice([None, *range(-50, 50)]), rng.choice([None, True, False, False])) for k in range(3000)]
    return spark.createDataFrame(data, "key string, at long, id long, v long, flag boolean").repartition(5).cache()


@pytest.mark.parametrize("part_rows", [10_000, 700, 101])
def test_scan_is_the_window(rows, part_rows):
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v, flag = F.col("v"), F.col("flag")
    got = scan(rows, ["key"], ["at", "id"], {"s": Running("sum", v), "n": Running("count", flag), "hi": Running("max", v), "lo": Running("min", v), "l": Running("last", F.when(flag, v))}, part_rows)
    want = rows.withColumns({"s": F.sum("v").over(w), "n": running_count(F.coalesce(flag, F.lit(False)), Window.partitionBy("key").orderBy("at", "id")), "hi": F.max("v").over(w), "lo": F.min("v").over(w), "l": carry_forward(v, F.coalesce(flag & v.isNotNull(), F.lit(False)), Window.partitionBy("key").orderBy("at", "id"))})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("forward", [False, True])
def test_asof_scan_is_asof(rows, forward):
    matches = F.coalesce(F.col("flag"), F.lit(False))
    got = asof_scan(rows, ["key"], ["at", "id"], F.col("id"), matches, "hit", forward, 101)
    want = rows.withColumn("hit", asof(rows, ["key"], ["at", "id"], F.col("id"), matches, forward))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_is_spread(spark, rows):
    """No task of the scan's windows sees more than a part's rows of the key that has half of them."""
    from riverbed.sources.scratch import Tables

    kept = []

    class Seen(Tables):
        def save(self, df):
            kept.append(super().save(df))
            return kept[-1]

    scan(rows, ["key"], ["at", "id"], {"s": Running("sum", F.col("v"))}, 200, Seen(spark)).count()
    hot = [r["count"] for r in kept[0].filter("key = 'hot'").groupBy("_part").count().collect()]
    assert len(hot) >= 7 and max(hot) < 500 and sum(hot) > 1300
    assert scan(rows.limit(0), ["key"], ["at", "id"], {"s": Running("sum", F.col("v"))}).count() == 0
