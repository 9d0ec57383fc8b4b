"""Joins, set operations and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.operators import joins as J
from riverbed.operators import metrics as M
from riverbed.operators import sequence as S
from riverbed.sources.tables import events, table

DAY = 86_400_000_000
U = (["user_id"], ["us", "event_id"])


@query("q_asof_backward", """
WITH v AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id, v.event_id AS view_id, p.us - v.us AS staleness FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.us""")
def q_asof_backward(spark, sf_dir):
    """Each purchase with the latest view of the user at or before it."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").filter(F.col("event_type").isin("view", "purchase"))
    e = e.withColumn("v", J.asof(e, *U, F.struct("event_id", "us"), F.col("event_type") == "view")).filter("event_type = 'purchase'")
    return e.select("event_id", F.col("v.event_id").alias("view_id"), (F.col("us") - F.col("v.us")).alias("staleness"))


@query("q_asof_forward", """
WITH v AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'view'), c AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'click')
SELECT v.event_id, c.event_id AS click_id, c.us - v.us AS wait FROM v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.us <= c.us""")
def q_asof_forward(spark, sf_dir):
    """Each view with the first click of the user at or after it."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").filter(F.col("event_type").isin("view", "click"))
    e = e.withColumn("c", J.asof(e, *U, F.struct("event_id", "us"), F.col("event_type") == "click", forward=True)).filter("event_type = 'view'")
    return e.select("event_id", F.col("c.event_id").alias("click_id"), (F.col("c.us") - F.col("us")).alias("wait"))


@query("q_barrier_join", """
SELECT user_id, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2
HAVING count(*) FILTER (WHERE event_type = 'view') = 1 AND count(*) FILTER (WHERE event_type = 'click') = 1""")
def q_barrier_join(spark, sf_dir):
    e = events(spark, sf_dir, "user_id", "event_type").withColumn("day", F.floor(F.col("us") / DAY))
    return J.barrier(e, ["user_id", "day"], "event_type", ["view", "click"])


@query("q_semi_provenance", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id FROM e c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND v.k = c.k AND v.us < c.us)""")
def q_semi_provenance(spark, sf_dir):
    """Clicks with an earlier view of the same user and k: only the first view of each key matters, so the join is on the key alone."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k")).filter(F.col("event_type").isin("view", "click"))
    first = F.min(F.when(F.col("event_type") == "view", F.col("us"))).over(Window.partitionBy("user_id", "k"))
    return e.withColumn("first_view", first).filter("event_type = 'click' and first_view < us").select("event_id")


@query("q_anti_reuse", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events)
SELECT event_id FROM e s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'error' AND r.user_id = s.user_id AND r.us > s.us AND r.us <= s.us + 86400000000)""")
def q_anti_reuse(spark, sf_dir):
    """Signups without an error of the user in the next day; the nearest later error decides."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").filter(F.col("event_type").isin("signup", "error"))
    nxt = F.min(F.when(F.col("event_type") == "error", F.col("us"))).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(1, DAY))
    return e.withColumn("next_error", nxt).filter("event_type = 'signup' and next_error is null").select("event_id")


@query("q_plan_vs_actual", """
SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both, count(*) FILTER (WHERE l.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS right_only
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def q_plan_vs_actual(spark, sf_dir):
    return J.coverage(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("q_cross_plan", "SELECT r_name, count(*) AS planned, count(*) FILTER (WHERE n_regionkey = r_regionkey) AS own FROM region CROSS JOIN nation GROUP BY 1")
def q_cross_plan(spark, sf_dir):
    """Every region with every nation, 5 x 25 rows of two dimension tables of fixed size, and how many belong together."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.crossJoin(n).groupBy("r_name").agg(F.count("*").alias("planned"), F.count_if(F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


@query("q_trace_diff", """
SELECT conv_id, turn, text AS left_value, text || '!' AS right_value FROM conversations WHERE turn = 1
UNION ALL SELECT conv_id, turn, text, NULL FROM conversations WHERE turn = 4""")
def q_trace_diff(spark, sf_dir):
    """Conversations against a copy whose turn 1 has a mark more and whose turn 4 is missing."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    other = c.filter("turn <> 4").withColumn("text", F.when(F.col("turn") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return J.trace_diff(c, other, ["conv_id", "turn"], "text")


@query("q_index_join", """
SELECT c_mktsegment, count(c_custkey) AS n, count(*) - count(c_custkey) AS missing, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def q_index_join(spark, sf_dir):
    """Orders looked up in customers, and how many keys are missing; orders are summed by customer before the join."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum(M.units(F.col("o_totalprice"), 100)).alias("t"))
    j = o.join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    found = F.when(F.col("c_custkey").isNotNull(), F.col("k")).otherwise(0)
    return j.groupBy("c_mktsegment").agg(F.sum(found).alias("n"), F.sum(F.col("k") - found).alias("missing"), (F.sum("t").cast("double") / 100).alias("total"))


@query("q_union_sorted", """
WITH u AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, event_type, epoch_us(ts) FROM events WHERE event_type IN ('view', 'error'))
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS position, us FROM u""")
def q_union_sorted(spark, sf_dir):
    """A bag union in two-key order within each user."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    u = e.filter("event_type = 'view'").unionByName(e.filter("event_type in ('view', 'error')"))
    return u.select("user_id", "event_id", "event_type", F.row_number().over(S.by(*U)).cast("long").alias("position"), "us")


@query("q_tumbling_160ms", "SELECT epoch_us(ts) // 160000 AS bucket, count(*) AS n, sum(round(value * 1000000)::BIGINT)::DOUBLE / 1000000 AS total FROM events GROUP BY 1")
def q_tumbling_160ms(spark, sf_dir):
    e = events(spark, sf_dir, "value")
    return e.groupBy(F.floor(F.col("us") / 160_000).alias("bucket")).agg(F.count("*").alias("n"), M.exact_sum(F.col("value")).alias("total"))


@query("q_module_projection", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS value FROM events""")
def q_module_projection(spark, sf_dir):
    """Each kind of event without the fields that it must not show."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    lane = F.col("event_type").isin("view", "click")
    return e.select("event_id", F.when(lane, F.get_json_object("props", "$.k")).alias("k"), F.when(~lane, F.col("value")).alias("value"))


@query("q_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(round(l_quantity * 100)::BIGINT)::DOUBLE / 100 AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(spark, sf_dir):
    """Platform breadth: subtotals."""
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), M.exact_sum(F.col("l_quantity"), 100).alias("quantity"))


@query("q_cube", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY CUBE (event_type, k)")
def q_cube(spark, sf_dir):
    """Platform breadth: all subtotals."""
    return table(spark, sf_dir, "events", "event_type", "props").select("event_type", F.get_json_object("props", "$.k").alias("k")).cube("event_type", "k").agg(F.count("*").alias("n"))


@query("q_sessions", """
WITH s AS (SELECT user_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600000000)::INT, 1) AS new, event_id FROM events),
n AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM n GROUP BY 1, 2""")
def q_sessions(spark, sf_dir):
    """Platform breadth: sessions that an hour without events ends."""
    e = events(spark, sf_dir, "event_id", "user_id")
    e = e.withColumn("new", F.coalesce(F.col("us") - F.lag("us").over(S.by(*U)) >= 3_600_000_000, F.lit(True)))
    e = e.withColumn("session", S.running_count(F.col("new"), S.by(*U)))
    return e.groupBy("user_id", "session").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
