"""The timing summary over runs built from the event table: a user's events are the steps of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.catalog import query
from riverbed.operators import timing as T
from riverbed.operators.sequence import by, dealt
from riverbed.sources.tables import events, table

#: Steps that a task takes; each has about twenty measures.
PART_STEPS = 25_000


def trace(spark, sf_dir) -> DataFrame:
    """Steps whose durations follow from value and event_id; errors are not published, signups have no snapshot. They are dealt by run."""
    c = F.col
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "value").withColumn("run_id", F.concat(F.lit("u"), "user_id")).drop("user_id")
    e = dealt(e, ["run_id"], table(spark, sf_dir, "events").count(), PART_STEPS).withColumn("step_id", (F.row_number().over(by(["run_id"], ["us", "event_id"])) - 1).cast("long"))
    tick = lambda n: (c("event_id") % n) / 1e3
    e = e.withColumn("ready", c("step_id") * 0.16).withColumn("began", c("ready") + c("value") / 1e3).withColumn("released", c("ready") + 0.2 + tick(31))
    event = lambda kind, took, name=None, token=None, needed=None, samples=None: F.struct(
        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if name is None else name).alias("name"), (F.lit(None).cast("string") if token is None else token).alias("token"), F.lit(needed).cast("boolean").alias("needed"),
        c("began").alias("started_at"), (c("began") + took).alias("completed_at"), (F.lit(None).cast("array<bigint>") if samples is None else samples).alias("samples"),
    )
    heard = F.array(F.lit(1280).cast("long"), c("event_id") % 3 * 640)
    happened = F.array(event("recogniser", c("value") / 1e3, needed=True, samples=heard), event("stage", tick(17), name=c("event_type")), event("state", tick(5), token=F.when(c("event_id") % 4 == 0, "user_idle").otherwise("user_nonidle")))

    def frame(i: int):
        at = c("ready") + 0.01 + 0.03 * i
        word = c("event_id") % 5 == i
        stage = lambda name, took: F.struct(F.lit(name).alias("name"), at.alias("started_at"), (at + took).alias("completed_at"))
        return F.struct(at.alias("started_at"), (at + tick(7 + i)).alias("completed_at"), F.when(word, 33).otherwise(32).alias("decision"), F.when(word, at + 0.005).alias("text_available_at"), F.array(stage("encode", tick(23)), stage("decode", tick(29))).alias("stages"))

    public = c("event_type") != "error"
    return e.select(
        "run_id", "step_id", c("ready").alias("input_ready_at"), c("released").alias("released_at"), F.when(public, c("released") - 0.01).alias("published_at"), F.when(public, c("value") / 1e6).alias("commit_seconds"),
        (c("value") * 10).alias("main_lag_ms"), (c("value") * 10 + 5).alias("observed_lag_ms"), F.when(c("event_type") != "signup", c("value") * 7).alias("asr_lag_ms"),
        F.struct(c("began").alias("started_at"), (c("began") + tick(97)).alias("completed_at"), (c("began") + tick(13)).alias("state_available_at"), happened.alias("events")).alias("control"),
        F.array(frame(0), frame(1)).alias("frames"), F.create_map(F.lit("controller"), tick(11), F.lit("asr"), tick(19)).alias("waits"),
        F.when(c("event_type") != "signup", F.when(c("step_id") < 3, "").otherwise(F.concat(F.lit("t"), c("step_id")))).alias("text"), (c("released") + 0.1).alias("read_at"),
    )


_STEPS = """
e AS (SELECT 'u' || user_id AS run_id, event_id AS i, event_type AS kind, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS step FROM events),
b AS (SELECT *, step * 0.16::DOUBLE AS ready, step * 0.16::DOUBLE + v / 1e3 AS began, step * 0.16::DOUBLE + 0.2::DOUBLE + i % 31 / 1e3 AS released FROM e),
s AS (SELECT *, began + i % 13 / 1e3 AS available, CASE WHEN kind <> 'error' THEN released - 0.01::DOUBLE END AS published FROM b)"""
_FRAMES = "(SELECT s.*, f, ready + 0.01::DOUBLE + (0.03::DOUBLE * f) AS t FROM s, (VALUES (0), (1)) x(f))"


@query("q_timing_distributions", f"""
WITH {_STEPS},
m AS (
  SELECT run_id, 'controller_compute_ms' AS metric, NULL AS part, (began + i % 97 / 1e3 - began) * 1000 AS x FROM s UNION ALL SELECT run_id, 'controller_main_lag_ms', NULL, v * 10 FROM s UNION ALL SELECT run_id, 'stable_main_lag_ms', NULL, v * 10 FROM s WHERE step > 0
  UNION ALL SELECT run_id, 'controller_observed_lag_ms', NULL, v * 10 + 5 FROM s UNION ALL SELECT run_id, 'raw_state_main_lag_ms', NULL, v * 10 - (released - available) * 1000 FROM s UNION ALL SELECT run_id, 'controller_queue_ms', NULL, (began - ready) * 1000 FROM s
  UNION ALL SELECT run_id, 'asr_main_lag_ms', NULL, v * 7 FROM s WHERE kind <> 'signup' UNION ALL SELECT run_id, 'stable_asr_main_lag_ms', NULL, v * 7 FROM s WHERE kind <> 'signup' AND step > 0 UNION ALL SELECT run_id, 'joint_commit_ms', NULL, v / 1e6 * 1000 FROM s WHERE kind <> 'error'
  UNION ALL SELECT run_id, 'state_available_to_publish_ms', NULL, (published - available) * 1000 FROM s WHERE published IS NOT NULL UNION ALL SELECT run_id, 'asr_compute_ms', NULL, (t + i % (7 + f) / 1e3 - t) * 1000 FROM {_FRAMES}
  UNION ALL SELECT run_id, 'eos_available_to_publish_ms', NULL, (published - (t + 0.005::DOUBLE)) * 1000 FROM {_FRAMES} WHERE i % 5 = f AND published IS NOT NULL
  UNION ALL SELECT run_id, 'recogniser_by_samples', (1280 + i % 3 * 640)::VARCHAR, (began + v / 1e3 - began) * 1000 FROM s UNION ALL SELECT run_id, 'controller_stages', kind, (began + i % 17 / 1e3 - began) * 1000 FROM s
  UNION ALL SELECT run_id, 'asr_stages', 'encode', (t + i % 23 / 1e3 - t) * 1000 FROM {_FRAMES} WHERE kind <> 'signup' UNION ALL SELECT run_id, 'asr_stages', 'decode', (t + i % 29 / 1e3 - t) * 1000 FROM {_FRAMES} WHERE kind <> 'signup'
  UNION ALL SELECT run_id, 'barrier_wait_ms', 'controller', i % 11 / 1e3 * 1000 FROM s WHERE kind <> 'signup' UNION ALL SELECT run_id, 'barrier_wait_ms', 'asr', i % 19 / 1e3 * 1000 FROM s WHERE kind <> 'signup')
SELECT run_id, metric, part, count(x) AS n, round(quantile_cont(x, 0.5), 9) AS p50, round(quantile_cont(x, 0.95), 9) AS p95, round(max(x), 9) AS max FROM m GROUP BY ALL""")
def q_timing_distributions(spark, sf_dir):
    """Sixteen distributions of each run, four of them by part."""
    return T.distributions(trace(spark, sf_dir))


@query("q_timing_firsts", f"""
WITH {_STEPS} SELECT run_id, min(step) AS first_step, arg_min(v * 10, step) AS first_lag_ms, min(step) FILTER (WHERE kind <> 'signup' AND step >= 3) AS text_step, 't' || min(step) FILTER (WHERE kind <> 'signup' AND step >= 3) AS first_text,
  round(arg_min(released + 0.1::DOUBLE, step) FILTER (WHERE kind <> 'signup' AND step >= 3), 9) AS text_read_at FROM s GROUP BY 1""")
def q_timing_firsts(spark, sf_dir):
    """The first step of each run, and the first text that is not empty."""
    return T.firsts(trace(spark, sf_dir)).withColumn("text_read_at", F.round("text_read_at", 9))


@query("q_timing_encounters", f"""
WITH {_STEPS}, x AS (SELECT run_id, 'recogniser' AS kind, NULL AS token, true AS needed, 1280 + i % 3 * 640 AS samples, step, v FROM s UNION ALL SELECT run_id, 'stage', NULL, NULL, 0, step, v FROM s
  UNION ALL SELECT run_id, 'state', CASE WHEN i % 4 = 0 THEN 'user_idle' ELSE 'user_nonidle' END, NULL, 0, step, v FROM s)
SELECT run_id, kind, token, needed, samples::BIGINT AS samples, min(step) AS step_id, arg_min(v * 10, step) AS lag_ms FROM x GROUP BY run_id, kind, token, needed, samples""")
def q_timing_encounters(spark, sf_dir):
    """Where each run first met each kind of event, by token, need and samples."""
    return T.encounters(trace(spark, sf_dir))
