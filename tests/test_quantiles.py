"""Exact quantiles by rank selection against sorted lists."""

import math
import random
import re

import pytest

from riverbed.operators import quantiles as Q
from riverbed.operators.quantiles import exact_quantiles


def plain(values, q):
    xs = sorted(values)
    at = (len(xs) - 1) * q
    a, b = math.floor(at), math.ceil(at)
    return xs[a] + (xs[b] - xs[a]) * (at - a)


@pytest.mark.parametrize("known", [100_000, 0])
@pytest.mark.parametrize("few", [1, 7, 20_000])
def test_exact_quantiles(spark, few, known):
    """One group of many rows, some of one value, of ties, of huge and tiny values, a null key; whether ranges are cut often, seldom or not at all."""
    rng = random.Random(few)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(5000)], "ties": [float(rng.randrange(3)) for _ in range(900)], "one": [4.25] * 50, "single": [-3.5], None: [rng.random() for _ in range(31)],
        "wide": [1e308, -1e308, 5e-324, 0.0, -0.0, 1e-300, 1e300, 7.0], "close": [1 + k * 2**-52 for k in range(40)], "mixed": [math.exp(rng.uniform(-300, 300)) * rng.choice((-1, 1)) for _ in range(400)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("ties", None), ("hot", float("nan")), ("empty", None)]
    rng.shuffle(rows)
    qs = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", qs, None, few, known).collect()}
    assert got.keys() == {*groups, "empty"}
    assert tuple(got["empty"])[1:] == (0, None, None, None, None, None)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs) and got[k]["max"] == max(vs)
        for name, q in qs.items():
            assert got[k][name] == plain(vs, q), (k, name)


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"p50": 0.5}).count() == 0


def test_groups_of_few_rows_are_sorted(spark, monkeypatch):
    """No rank is looked for in groups of few rows, however many they are: no join, one shuffle, to parts whose number grows with the rows; none if they are dealt already."""
    monkeypatch.setattr(Q, "PART_ROWS", 100, raising=False)
    df = spark.range(2000).selectExpr("id % 300 as k", "double(id * 7919 % 1000) as v")
    plan = exact_quantiles(df, ["k"], "v", {"p50": 0.5}, known=0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and re.search(r"hashpartitioning\(k#\d+L?, 20\)", plan)
    dealt = exact_quantiles(df.repartition(3, "k"), ["k"], "v", {"p50": 0.5}, known=0, dealt=True)
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    values = {k: [i * 7919 % 1000 for i in range(k, 2000, 300)] for k in range(300)}
    assert {r["k"]: (r["n"], r["p50"], r["max"]) for r in dealt.collect()} == {k: (len(vs), plain(vs, 0.5), max(vs)) for k, vs in values.items()}


def test_few_and_many_rows_beside_nothing(spark):
    """Groups that are sorted, one whose ranks are looked for and those without a value, in one table; each once."""
    rows = [("large", float(i * 37 % 101)) for i in range(101)] + [("small", 2.0), ("small", 1.0), ("small", None), (None, 5.0), ("none", None), ("nan", float("nan"))]
    for known in (100_000, 0):
        got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", {"p50": 0.5, "p95": 0.95}, None, 10, known).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([("large", 101, 50.0, 95.0, 100.0), ("small", 2, 1.5, 1.95, 2.0), (None, 1, 5.0, 5.0, 5.0), ("none", 0, None, None, None), ("nan", 0, None, None, None)], key=repr)
