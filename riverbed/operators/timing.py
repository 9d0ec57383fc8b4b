"""The timing of recorded runs: every duration and lag as a row of long form, from all levels of a trace in one pass, and what came first.

One row of a trace is a step of a run, from 0; what a step lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.operators.joint import WORD
from riverbed.operators.quantiles import exact_quantiles, group_quantiles
from riverbed.sources.scratch import Tables

_EVENT = "struct<kind: string, name: string, token: string, needed: boolean, started_at: double, completed_at: double, samples: array<bigint>>"
_FRAME = "struct<started_at: double, completed_at: double, decision: int, text_available_at: double, stages: array<struct<name: string, started_at: double, completed_at: double>>>"
TRACE = f"""run_id string, step_id long, input_ready_at double, released_at double, published_at double, commit_seconds double, main_lag_ms double, observed_lag_ms double, asr_lag_ms double,
control struct<started_at: double, completed_at: double, state_available_at: double, events: array<{_EVENT}>>, frames array<{_FRAME}>, waits map<string, double>, text string, read_at double"""
_VALUE = "array<struct<metric: string, part: string, value: double>>"


def _one(metric: str, value: Column, part: Column | None = None) -> Column:
    return F.struct(F.lit(metric).alias("metric"), (F.lit(None).cast("string") if part is None else part).alias("part"), value.alias("value"))


def _ms(later: Column, earlier: Column) -> Column:
    return (later - earlier) * 1000


def measures(trace: DataFrame) -> DataFrame:
    """run_id, metric, part, value: twelve distributions of a run and four of its parts (recogniser by samples, stages of both lanes, waits by lane). Each level's values come from its own array; the row is read once."""
    c = F.col
    control, later, read = c("control"), c("step_id") > 0, c("text").isNotNull()
    took = lambda x: _ms(x["completed_at"], x["started_at"])
    none = F.array().cast(_VALUE)
    steps = F.array(
        _one("controller_compute_ms", took(control)), _one("controller_main_lag_ms", c("main_lag_ms")), _one("stable_main_lag_ms", F.when(later, c("main_lag_ms"))), _one("controller_observed_lag_ms", c("observed_lag_ms")),
        _one("raw_state_main_lag_ms", c("main_lag_ms") - _ms(c("released_at"), control["state_available_at"])), _one("controller_queue_ms", _ms(control["started_at"], c("input_ready_at"))),
        _one("asr_main_lag_ms", c("asr_lag_ms")), _one("stable_asr_main_lag_ms", F.when(later, c("asr_lag_ms"))), _one("joint_commit_ms", c("commit_seconds") * 1000),
        _one("state_available_to_publish_ms", _ms(c("published_at"), control["state_available_at"])),
    )
    frames, events = F.coalesce("frames", F.array().cast(f"array<{_FRAME}>")), F.coalesce(control["events"], F.array().cast(f"array<{_EVENT}>"))
    words = F.filter(frames, lambda x: (x["decision"] == WORD) & x["text_available_at"].isNotNull())
    samples = lambda x: F.aggregate(F.coalesce(x["samples"], F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, n: a + n)
    parts = [
        F.transform(frames, lambda x: _one("asr_compute_ms", took(x))), F.transform(words, lambda x: _one("eos_available_to_publish_ms", _ms(c("published_at"), x["text_available_at"]))),
        F.transform(F.filter(events, lambda x: x["kind"] == "recogniser"), lambda x: _one("recogniser_by_samples", took(x), samples(x).cast("string"))),
        F.transform(F.filter(events, lambda x: x["kind"] == "stage"), lambda x: _one("controller_stages", took(x), x["name"])),
        F.when(read, F.flatten(F.transform(frames, lambda x: F.transform(F.coalesce(x["stages"], F.array().cast("array<struct<name: string, started_at: double, completed_at: double>>")), lambda s: _one("asr_stages", took(s), s["name"]))))).otherwise(none),
        F.when(read & c("waits").isNotNull(), F.transform(F.map_entries("waits"), lambda w: _one("barrier_wait_ms", w["value"] * 1000, w["key"]))).otherwise(none),
    ]
    return trace.select("run_id", F.explode(F.concat(*[x.cast(_VALUE) for x in (steps, *parts)])).alias("m")).select("run_id", "m.*").filter("value is not null")


def distributions(trace: DataFrame, decimals: int = 9, few: int = 50_000) -> DataFrame:
    """run_id, metric, part, n, p50, p95, max of every measure, exactly. A trace dealt by run is not shuffled: the measures of runs of no more than few steps are sorted where they are made. Those of longer
    runs are written, and their ranks looked for."""
    keys, quantiles = ["run_id", "metric", "part"], {"p50": 0.5, "p95": 0.95}
    tables = Tables(trace.sparkSession)
    long_runs = tables.save(trace.groupBy(F.col("run_id").alias("long_id")).count().filter(F.col("count") > few).select("long_id"))
    if long_runs.isEmpty():
        out = group_quantiles(measures(trace), keys, "value", quantiles, decimals)
    else:
        of = lambda how: measures(trace.join(F.broadcast(long_runs), F.col("run_id").eqNullSafe(F.col("long_id")), how))
        out = group_quantiles(of("left_anti"), keys, "value", quantiles, decimals).unionByName(exact_quantiles(tables.save(of("left_semi")), keys, "value", quantiles, decimals))
    return out.withColumn("max", F.round("max", decimals))


def firsts(trace: DataFrame) -> DataFrame:
    """run_id, first_step and its lag, and the step, text and reading time of the first text that is not empty."""
    spoken = F.when(F.col("text") != "", F.struct("step_id", "text", "read_at"))
    out = trace.groupBy("run_id").agg(F.min_by(F.struct("step_id", "main_lag_ms"), "step_id").alias("f"), F.min_by(spoken, F.when(F.col("text") != "", F.col("step_id"))).alias("t"))
    return out.select("run_id", F.col("f.step_id").alias("first_step"), F.col("f.main_lag_ms").alias("first_lag_ms"), F.col("t.step_id").alias("text_step"), F.col("t.text").alias("first_text"), F.col("t.read_at").alias("text_read_at"))


def encounters(trace: DataFrame) -> DataFrame:
    """run_id, kind, token, needed, samples, step_id, lag_ms: where a run first met each such event. Minima combine before the shuffle."""
    e = trace.select("run_id", "step_id", "main_lag_ms", F.posexplode("control.events").alias("pos", "e"))
    samples = F.aggregate(F.coalesce("e.samples", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, n: a + n)
    first = e.groupBy("run_id", "e.kind", "e.token", "e.needed", samples.alias("samples")).agg(F.min_by(F.struct("step_id", F.col("main_lag_ms").alias("lag_ms")), F.struct("step_id", "pos")).alias("f"))
    return first.select("run_id", "kind", "token", "needed", "samples", "f.*")
