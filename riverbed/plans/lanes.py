"""Lanes by themselves, over line items as packets and vectors as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.operators import lanes
from riverbed.plans.scans import PART_ROWS
from riverbed.sources.scratch import Tables
from riverbed.sources.tables import events, table
from riverbed.streaming import ledger


def packets(spark, sf_dir) -> DataFrame:
    """A packet for each line item of an order, 100 samples for each unit; every seventh order has not ended."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    i = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", *order)
    i = i.withColumns({"n": F.row_number().over(w), "end": F.sum((F.col("l_quantity") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "of": F.count("*").over(Window.partitionBy("l_orderkey"))})
    return i.select(F.col("l_orderkey").alias("run_id"), "end", (F.col("n") * 0.5).alias("at"), ((F.col("n") == F.col("of")) & (F.col("l_orderkey") % 7 != 0)).alias("eof"))


_STEPS = """
p AS (SELECT l_orderkey AS run_id, row_number() OVER w AS n, sum((l_quantity * 100)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
t AS (SELECT run_id, max(e)::BIGINT AS total, max(n) AS n, run_id % 7 <> 0 AS eof FROM p GROUP BY run_id),
k AS (SELECT run_id, total, n, unnest(range(0, CASE WHEN eof THEN ceil(total / 2560.0) ELSE floor(total / 2560.0) END::BIGINT)) AS step_id FROM t),
s AS (SELECT run_id, step_id, step_id * 2560 AS begins, least((step_id + 1) * 2560, total) AS processed_until, CASE WHEN (step_id + 1) * 2560 > total THEN n * 0.5::DOUBLE ELSE (SELECT min(p.n) FROM p WHERE p.run_id = k.run_id AND p.e >= (step_id + 1) * 2560) * 0.5::DOUBLE END AS ready_at FROM k)"""


@query("q_single_lane", f"WITH {_STEPS} SELECT run_id, step_id::BIGINT AS step_id, begins::BIGINT AS begins, processed_until::BIGINT AS processed_until, ready_at FROM s")
def q_single_lane(spark, sf_dir):
    """When each step of a lane that waits for no other is ready."""
    return lanes.single_lane(packets(spark, sf_dir), part_rows=PART_ROWS)


@query("q_lane_surplus", f"""
WITH {_STEPS}, j AS (SELECT run_id, step_id, processed_until + CASE WHEN run_id % 11 = 0 AND step_id = 1 THEN 5 ELSE 0 END AS x FROM s WHERE NOT (run_id % 5 = 0 AND step_id >= 2) UNION ALL SELECT run_id, 1000, 0 FROM s WHERE run_id % 13 = 0 AND step_id = 0)
SELECT coalesce(s.run_id, j.run_id) AS run_id, coalesce(s.step_id, j.step_id)::BIGINT AS step_id, CASE WHEN x IS NULL THEN 'only_in_lane' WHEN processed_until IS NULL THEN 'missing_in_lane' ELSE 'behind' END AS label FROM s FULL JOIN j ON s.run_id = j.run_id AND s.step_id = j.step_id WHERE x IS NULL OR processed_until IS NULL OR processed_until < x""")
def q_lane_surplus(spark, sf_dir):
    """Steps that a lane alone delivers and a joint run, cut short for some orders, lacks; and those that it lacks or is behind in."""
    # written once: the joint run is made of it twice more
    lane = Tables(spark).save(lanes.single_lane(packets(spark, sf_dir), part_rows=PART_ROWS))
    joint = lane.filter("not (run_id % 5 = 0 and step_id >= 2)").select("run_id", "step_id", F.expr("processed_until + if(run_id % 11 = 0 and step_id = 1, 5, 0)").alias("processed_until"))
    more = lane.filter("run_id % 13 = 0 and step_id = 0").select("run_id", F.lit(1000).cast("long").alias("step_id"), F.lit(0).cast("long").alias("processed_until"))
    return lanes.surplus(lane, joint.unionByName(more))


HOP = 64


def windows(spark, sf_dir) -> DataFrame:
    """Vectors of a label as a stream of samples, two to a window, one of them shared with the next; some windows are moved, cut, changed or sent with another digest."""
    v = table(spark, sf_dir, "embeddings").filter("label is not null").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("pcm"))
    w = Window.partitionBy("label").orderBy("vec_id")
    v = v.withColumns({"k": (F.row_number().over(w) - 1).cast("long"), "next": F.lead("pcm").over(w)}).filter("next is not null")
    odd = lambda n: F.col("vec_id") % n == 0
    changed = F.when(odd(17), F.transform("next", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("next"))
    v = v.withColumn("samples", F.concat("pcm", changed)).withColumn("begin", F.col("k") * HOP + F.when(odd(11), 3).when(odd(13), -3).otherwise(0))
    return v.select(F.col("label").alias("run_id"), "k", "begin", (F.col("begin") + F.when(odd(23), 2 * HOP - 1).otherwise(2 * HOP)).alias("end"), "samples", F.when(odd(19), F.lit("x")).otherwise(lanes.digest(F.col("samples"))).alias("sha256"), F.when(odd(29), 1).otherwise(2 * HOP).alias("provenance"))


@query("q_window_ledger", f"""
WITH v AS (SELECT vec_id AS i, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::INTEGER) AS pcm FROM embeddings WHERE label IS NOT NULL), n AS (SELECT *, row_number() OVER w - 1 AS k, lead(pcm) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY label ORDER BY i)),
s AS (SELECT i, label, k, pcm AS head, CASE WHEN i % 17 = 0 THEN [nxt[1] + 1] || nxt[2:] ELSE nxt END AS tail, k * {HOP} + CASE WHEN i % 11 = 0 THEN 3 WHEN i % 13 = 0 THEN -3 ELSE 0 END AS b FROM n WHERE nxt IS NOT NULL),
l AS (SELECT *, lag(b) OVER w AS b0, lag(tail) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY label ORDER BY k))
SELECT label AS run_id, k, unnest(list_filter([CASE WHEN i % 23 = 0 THEN 'size' END, CASE WHEN i % 29 = 0 THEN 'provenance' END, CASE WHEN i % 19 = 0 THEN 'digest' END, CASE WHEN b > b0 + {HOP} THEN 'gap' END, CASE WHEN b < b0 + {HOP} THEN 'overlap' END, CASE WHEN head <> t0 THEN 'changed' END], lambda x: x IS NOT NULL)) AS label FROM l""")
def q_window_ledger(spark, sf_dir):
    """Windows that do not make one stream: a gap, an overlap, a changed sample, another size or digest each give a row."""
    return lanes.window_violations(windows(spark, sf_dir), 2 * HOP, HOP)


AHEAD = 640


@query("q_joint_readiness", f"""
WITH p AS (SELECT l_orderkey AS run_id, row_number() OVER w AS n, sum((l_quantity * 100)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
t AS (SELECT run_id, max(e)::BIGINT AS total, max(n) AS n, run_id % 7 <> 0 AS eof FROM p GROUP BY run_id),
k AS (SELECT run_id, total, n, unnest(range(0, CASE WHEN eof THEN ceil(total / 2560.0) ELSE greatest(floor((total - {AHEAD}) / 2560.0), 0) END::BIGINT)) AS step_id FROM t)
SELECT run_id, step_id::BIGINT AS step_id, (step_id * 2560)::BIGINT AS begins, least((step_id + 1) * 2560, total)::BIGINT AS processed_until,
  CASE WHEN (step_id + 1) * 2560 + {AHEAD} > total THEN n * 0.5::DOUBLE ELSE (SELECT min(p.n) FROM p WHERE p.run_id = k.run_id AND p.e >= (step_id + 1) * 2560 + {AHEAD}) * 0.5::DOUBLE END AS ready_at FROM k""")
def q_joint_readiness(spark, sf_dir):
    """When each batch of both lanes is ready: its samples and those that it looks ahead have come, or the stream has ended."""
    p = packets(spark, sf_dir)
    w = Window.partitionBy("run_id").orderBy("at")
    rows = p.select("run_id", F.row_number().over(w).cast("long").alias("seq"), "at", (F.col("end") - F.coalesce(F.lag("end").over(w), F.lit(0))).alias("samples"), "eof")
    return ledger.readiness_batch(rows, ahead=AHEAD)


def ledger_calls(spark, sf_dir) -> DataFrame:
    """Users' views, clicks and purchases append samples, errors and signups move one of two consumers on."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    moves = F.col("event_type").isin("error", "signup")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("run_id"), seq.alias("seq"), F.when(moves, "advance").otherwise("append").alias("kind"), F.when(F.col("event_type") == "error", "a").when(moves, "b").alias("consumer"),
                    F.when(moves, (F.col("event_id") % 7 + 2) * 100).otherwise((F.col("event_id") % 5 + 1) * 100).alias("samples"))


@query("q_sample_ledger", """
WITH RECURSIVE e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS seq, event_type AS t, CASE WHEN event_type IN ('error', 'signup') THEN (event_id % 7 + 2) * 100 ELSE (event_id % 5 + 1) * 100 END AS n FROM events),
r(run_id, seq, fin, a, b, kept, said) AS (
  SELECT DISTINCT run_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT)[], []::STRUCT(action VARCHAR, s BIGINT, e BIGINT, held BIGINT)[] FROM e
  UNION ALL
  SELECT run_id, seq, CASE WHEN stores THEN fin + n ELSE fin END, a2, b2, CASE WHEN stores THEN list_append(kept, {'s': fin, 'e': fin + n}) ELSE list_filter(kept, lambda x: x.e > least(a2, b2)) END,
    CASE WHEN stores THEN [{'action': 'stored', 's': fin, 'e': fin + n, 'held': held + n}] WHEN appends THEN [{'action': 'refused', 's': fin, 'e': fin + n, 'held': held}]
      ELSE list_transform(list_filter(kept, lambda x: x.e <= least(a2, b2)), lambda y: {'action': 'evicted', 's': y.s, 'e': y.e, 'held': held - coalesce(list_sum(list_transform(list_filter(kept, lambda z: z.e <= y.e), lambda v: v.e - v.s)), 0)::BIGINT}) END
  FROM (SELECT *, appends AND held + n <= 1500 AS stores, CASE WHEN t = 'error' THEN least(fin, a + n) ELSE a END AS a2, CASE WHEN t = 'signup' THEN least(fin, b + n) ELSE b END AS b2 FROM (
    SELECT e.*, r.* EXCLUDE (run_id, seq), t NOT IN ('error', 'signup') AS appends, coalesce(list_sum(list_transform(kept, lambda x: x.e - x.s)), 0)::BIGINT AS held FROM r JOIN e ON e.run_id = r.run_id AND e.seq = r.seq + 1)))
SELECT run_id, seq, s.action AS action, s.s AS start, s.e AS stop, s.held AS held FROM (SELECT run_id, seq, unnest(said) AS s FROM r)""")
def q_sample_ledger(spark, sf_dir):
    """What becomes of users' samples between two consumers: stored, refused for want of room, evicted when the slower one has passed."""
    return ledger.ledger_batch(ledger_calls(spark, sf_dir), ("a", "b"), 1500)
