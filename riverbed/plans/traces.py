"""Audits and folds over ordered traces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.operators import sequence as S
from riverbed.operators.prefixes import prefix_hashes
from riverbed.operators.scans import Running, scan
from riverbed.sources.tables import events, table

DAY = 86_400_000_000
U = (["user_id"], ["us", "event_id"])
LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query("q_sequence_gaps", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected FROM conversations WHERE turn <> 2)
SELECT conv_id, turn, expected FROM r WHERE turn <> expected""")
def q_sequence_gaps(spark, sf_dir):
    return S.sequence_gaps(table(spark, sf_dir, "conversations", "conv_id", "turn").filter("turn <> 2"), ["conv_id"], "turn")


def growth(c):
    """What each turn adds to the text of its conversation so far."""
    return F.concat(F.when(F.col("turn") > 0, " ").otherwise(""), c)


@query("q_append_only", """
WITH k AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN upper(t) ELSE t END AS t FROM k),
l AS (SELECT conv_id, turn, t, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM m)
SELECT conv_id, turn FROM l WHERE NOT starts_with(t, b)""")
def q_append_only(spark, sf_dir):
    """Rewrites of a growing text, after turn 3 was changed to upper case. Prefix hashes of both spellings are compared, so that no row holds the text so far.

    At turn 3 the text before must be the same in upper case, after it what had become upper case must have been so.
    """
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    plain = prefix_hashes(c, ["conv_id"], ["turn"], growth(F.col("text")))
    both = prefix_hashes(plain.withColumnsRenamed({"chars": "n", "a": "x", "b": "y"}), ["conv_id"], ["turn"], F.upper(growth(F.col("text"))))
    same = (F.col("n") == F.col("chars")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    told = both.withColumn("same", same).withColumn("same_before", F.lag("same").over(S.by(["conv_id"], ["turn"]))).withColumn("before", F.lag("turn").over(S.by(["conv_id"], ["turn"])))
    rewritten = F.when(F.col("turn") == 3, ~F.col("same_before")).when(F.col("before") == 3, ~F.col("same_before"))
    return told.filter(F.coalesce(rewritten, F.lit(False))).select("conv_id", "turn")


@query("q_running_groups", "SELECT event_id, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS groups FROM events")
def q_running_groups(spark, sf_dir):
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return e.select("event_id", S.running_count(F.col("event_type") == "purchase", S.by(*U)).alias("groups"))


@query("q_prefix_delta", "SELECT conv_id, turn, (length(text) + CASE WHEN turn = 0 THEN 0 ELSE 1 END)::BIGINT AS delta_length FROM conversations")
def q_prefix_delta(spark, sf_dir):
    """The length of what each turn adds to the text so far: its own and one for the blank before it."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    so_far = scan(c.select("conv_id", "turn", F.length(growth(F.col("text"))).cast("long").alias("n")), ["conv_id"], ["turn"], {"chars": Running("sum", F.col("n"))})
    return so_far.select("conv_id", "turn", (F.col("chars") - F.coalesce(F.lag("chars").over(S.by(["conv_id"], ["turn"])), F.lit(0))).alias("delta_length"))


@query("q_carry_forward", """
WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS us, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, true) AS ch FROM events)
SELECT event_id, last_value(CASE WHEN ch THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS changed_us FROM c""")
def q_carry_forward(spark, sf_dir):
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    e = e.withColumn("changes", F.coalesce(F.lag("event_type").over(S.by(*U)) != F.col("event_type"), F.lit(True)))
    return e.select("event_id", S.carry_forward(F.col("us"), F.col("changes"), S.by(*U)).alias("changed_us"))


@query("q_version_sequence", """
WITH v AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version, event_id % 7 + 1 AS claimed FROM events)
SELECT event_id, version, claimed FROM v WHERE version <> claimed""")
def q_version_sequence(spark, sf_dir):
    """Versions of a user's type that are not one more than the publications before."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    v = e.withColumn("version", F.row_number().over(S.by(["user_id", "event_type"], U[1])).cast("long")).withColumn("claimed", F.col("event_id") % 7 + 1)
    return v.filter("version <> claimed").select("event_id", "version", "claimed")


SPANS = """WITH o AS (SELECT *, sum(l_quantity) OVER w AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING)),"""


def spans(spark, sf_dir):
    """Lines of an order as consecutive spans of quantity: start, stop."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", *LINES)
    stop = F.sum("l_quantity").over(S.so_far(S.by(["l_orderkey"], LINES)))
    return l.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("l_quantity"))


@query("q_ledger_overlap", SPANS + """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, stop - l_quantity - l_linenumber AS start, stop - l_linenumber AS stop_at,
  lag(stop - l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS previous_end FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, start, previous_end FROM s WHERE start < previous_end""")
def q_ledger_overlap(spark, sf_dir):
    """Spans, each moved back by its line number, that start before the one before has ended."""
    s = spans(spark, sf_dir).withColumn("start", F.col("start") - F.col("l_linenumber")).withColumn("stop", F.col("stop") - F.col("l_linenumber"))
    return S.overlaps(s, ["l_orderkey"], LINES, "start", "stop").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start", "previous_end")


@query("q_span_slice", SPANS + """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, stop - l_quantity AS start, stop FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(start, 10) - 10 AS slice_start, least(stop, 50) - 10 AS slice_stop FROM s WHERE start < 50 AND stop > 10""")
def q_span_slice(spark, sf_dir):
    from riverbed.operators.joins import slice_spans

    return slice_spans(spans(spark, sf_dir), 10, 50).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "slice_start", "slice_stop")


@query("q_role_merge", """
WITH c AS (SELECT * FROM conversations WHERE length(text) % 3 <> 0),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS ch FROM c),
g AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f)
SELECT conv_id, run::BIGINT AS run, role, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY 1, 2, 3""")
def q_role_merge(spark, sf_dir):
    return S.merge_runs(table(spark, sf_dir, "conversations").filter(F.length("text") % 3 != 0), ["conv_id"], "turn", "role", "text")


@query("q_lifecycle", """
WITH a AS (SELECT event_id, user_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events)
SELECT event_id, user_id, event_type, active FROM a WHERE (event_type = 'signup' AND active > 1) OR (event_type = 'purchase' AND active < 0)""")
def q_lifecycle(spark, sf_dir):
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    return S.lifecycle_violations(e, *U, F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "user_id", "event_type", "active")


@query("q_latest_snapshot", "SELECT user_id, max(epoch_us(ts)) AS us, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type FROM events GROUP BY 1")
def q_latest_snapshot(spark, sf_dir):
    return S.latest(events(spark, sf_dir, "event_id", "user_id", "event_type"), *U)


@query("q_batches_of_three", """
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT user_id, step // 3 AS batch, count(*) AS n, string_agg(event_type, ',' ORDER BY step) AS types FROM s GROUP BY 1, 2""")
def q_batches_of_three(spark, sf_dir):
    """Three steps at a time with their types in order; an incomplete last one stays."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("step", F.row_number().over(S.by(*U)) - 1)
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "event_type"))), lambda x: x["event_type"]), ",")
    return e.groupBy("user_id", F.floor(F.col("step") / 3).alias("batch")).agg(F.count("*").alias("n"), types.alias("types"))


@query("q_eos_decode", """
WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS us, event_id, event_type FROM events),
p AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d)
SELECT user_id, day, string_agg(event_type, ',' ORDER BY us, event_id) AS tokens, NOT bool_or(event_type = 'purchase') AS missing_end FROM p WHERE seen = 0 GROUP BY 1, 2""")
def q_eos_decode(spark, sf_dir):
    """Types of a user-day up to its first purchase, and whether that is missing."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("day", F.floor(F.col("us") / DAY))
    before = S.by(["user_id", "day"], U[1]).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("seen", F.coalesce(F.count_if(F.col("event_type") == "purchase").over(before), F.lit(0))).filter("seen = 0")
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return e.groupBy("user_id", "day").agg(tokens.alias("tokens"), (~F.bool_or(F.col("event_type") == "purchase")).alias("missing_end"))


@query("q_cancelled_anti", """
WITH d AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day FROM events)
SELECT event_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.event_type = 'error' AND e.user_id = d.user_id AND e.day = d.day AND e.us > d.us)""")
def q_cancelled_anti(spark, sf_dir):
    """Events that no later error of the same user-day cancels."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("day", F.floor(F.col("us") / DAY))
    last = F.max(F.when(F.col("event_type") == "error", F.col("us"))).over(Window.partitionBy("user_id", "day"))
    return e.withColumn("last_error", last).filter("last_error is null or last_error <= us").select("event_id")


@query("q_violations_joint", """
WITH b AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, row_number() OVER w AS step, lag(epoch_us(ts)) OVER w AS last_us, lag(value) OVER w AS last_value, lag(event_type) OVER w AS last_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, 'early_start' AS label FROM b WHERE us - last_us < 60000000
UNION ALL SELECT event_id, 'cursor_regressed' FROM b WHERE value < last_value - 100
UNION ALL SELECT event_id, 'repeated_state' FROM b WHERE event_type = last_type AND event_type = 'signup'
UNION ALL SELECT event_id, 'not_positive' FROM b WHERE value <= 0
UNION ALL SELECT event_id, 'bad_first' FROM b WHERE step = 1 AND event_type = 'purchase'""")
def q_violations_joint(spark, sf_dir):
    """Rules of a joint batch over one window: a row for each rule that a step breaks. One pass, not one filter for each rule."""
    e = events(spark, sf_dir)
    w = S.by(*U)
    b = e.select("event_id", "event_type", "value", "us", F.row_number().over(w).alias("step"), *[F.lag(c).over(w).alias(f"last_{c}") for c in ("us", "value", "event_type")])
    from riverbed.operators.metrics import gate

    rules = {
        "early_start": F.col("us") - F.col("last_us") < 60_000_000, "cursor_regressed": F.col("value") < F.col("last_value") - 100,
        "repeated_state": (F.col("event_type") == F.col("last_event_type")) & (F.col("event_type") == "signup"), "not_positive": F.col("value") <= 0,
        "bad_first": (F.col("step") == 1) & (F.col("event_type") == "purchase"),
    }
    return gate(b, ["event_id"], rules).withColumnRenamed("failure", "label")


@query("q_consume_deltas", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s(user_id, n, event_id, busy, pending, action) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, false, 0::BIGINT, NULL::VARCHAR FROM events
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, CASE WHEN k = 'purchase' AND NOT busy THEN pending > 0 WHEN k IN ('error', 'click') THEN false ELSE busy END,
    CASE WHEN k = 'view' THEN pending + 1 WHEN k = 'purchase' AND NOT busy THEN 0 ELSE pending END,
    CASE WHEN k = 'view' THEN 'delta' WHEN k = 'purchase' AND busy THEN 'busy' WHEN k = 'purchase' AND pending > 0 THEN 'start' WHEN k = 'purchase' THEN 'empty' WHEN k IN ('error', 'click') AND busy THEN 'cancel' WHEN k IN ('error', 'click') THEN 'idle' ELSE 'ignored' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, action FROM s WHERE n > 0""")
def q_consume_deltas(spark, sf_dir):
    """Decisions of the delta consumer over each user's events: a fold in order, the batch twin of the streaming one."""
    from riverbed.streaming.consumer import consume

    return consume(events(spark, sf_dir, "event_id", "user_id", "event_type"))
