"""Rules and folds of streams: cursors, ledgers, windows, receipts, replies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.functions.scalars import ceil_div
from riverbed.operators import joins as J
from riverbed.operators import rules as R
from riverbed.operators import sequence as S
from riverbed.sources.tables import events, table

U = (["user_id"], ["us", "event_id"])
W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("q_cursors", f"""
WITH c AS (SELECT user_id, epoch_us(ts) AS us, event_id, value, event_id % 50 AS place, lag(value) OVER w AS v, lag(event_id % 50) OVER w AS p FROM events {W})
SELECT user_id, us, event_id, 'value_fell' AS failure FROM c WHERE value < v UNION ALL SELECT user_id, us, event_id, 'place_did_not_rise' FROM c WHERE place <= p""")
def q_cursors(spark, sf_dir):
    """Two cursors of a user: one that must not fall, one that must rise."""
    e = events(spark, sf_dir, "user_id", "event_id", "value").withColumn("place", F.col("event_id") % 50)
    return R.cursor_violations(e, *U, ["value"], ["place"])


@query("q_frame_ledger", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, (l_linenumber * 300)::BIGINT AS start_sample, (l_quantity * 7)::BIGINT AS samples,
  (l_linenumber * 300 + CASE WHEN l_partkey % 9 = 0 THEN 0.5 WHEN l_partkey % 9 = 1 THEN 1 ELSE 0 END)::DOUBLE / 16000 AS time FROM lineitem),
g AS (SELECT *, coalesce(lag(start_sample + samples) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), 0) AS before FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'overlap' AS failure FROM g WHERE start_sample < before
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'frame_size' FROM g WHERE NOT (samples > 0 AND samples <= 320)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'frame_time' FROM g WHERE round_even(time * 16000, 0)::BIGINT <> start_sample""")
def q_frame_ledger(spark, sf_dir):
    """Lines of an order as played frames: order, size and time of each."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    start = (F.col("l_linenumber") * 300).cast("long")
    late = F.when(F.col("l_partkey") % 9 == 0, 0.5).when(F.col("l_partkey") % 9 == 1, 1.0).otherwise(0.0)
    f = l.withColumn("start_sample", start).withColumn("samples", (F.col("l_quantity") * 7).cast("long")).withColumn("time", (start + late).cast("double") / 16000)
    return R.ledger_violations(f, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


@query("q_word_times", f"""
WITH t AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value - 5 END AS s, value - 5 + event_id % 5 - 1 AS e FROM events),
b AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM t)
SELECT user_id, us, event_id, 'not_finite' AS failure FROM b WHERE NOT isfinite(s) UNION ALL SELECT user_id, us, event_id, 'negative' FROM b WHERE s < 0
UNION ALL SELECT user_id, us, event_id, 'ends_before_start' FROM b WHERE e < s UNION ALL SELECT user_id, us, event_id, 'start_fell' FROM b WHERE s < before""")
def q_word_times(spark, sf_dir):
    """Word times that are not finite, negative, reversed or fall."""
    start = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 5)
    e = events(spark, sf_dir, "user_id", "event_id", "value").withColumn("s", start).withColumn("e", F.col("value") - 5 + F.col("event_id") % 5 - 1)
    return R.word_time_violations(e, *U, "s", "e")


@query("q_generations", f"""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, event_id, (row_number() OVER w) // 3 AS b, (row_number() OVER w) // 3 + CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 0 ELSE 1 END AS a FROM events {W}),
l AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM g)
SELECT user_id, us, event_id, 'not_continued' AS failure FROM l WHERE b <> before UNION ALL SELECT user_id, us, event_id, 'bad_step' FROM l WHERE a - b NOT IN (0, 1)""")
def q_generations(spark, sf_dir):
    """A reset counter that each row should take up from the row before and raise by one at most."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type")
    b = F.floor(F.row_number().over(S.by(*U)) / 3)
    after = F.col("generation_before") + F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 0).otherwise(1)
    return R.generation_violations(e.withColumn("generation_before", b).withColumn("generation_after", after), *U)


@query("q_context_windows", """
WITH f AS (SELECT doc_id, n_chars AS total, unnest(range((n_chars + 1279) // 1280)) AS frame FROM documents)
SELECT doc_id, frame, greatest(frame * 1280 - 200, 0) AS begin, least((frame + 1) * 1280 + 200, total) AS stop, greatest(200 - frame * 1280, 0) AS left_padding, greatest((frame + 1) * 1280 + 200 - total, 0) AS right_padding FROM f""")
def q_context_windows(spark, sf_dir):
    """Windows of 1680 around hops of 1280, over n_chars as the length of a stream."""
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", F.inline(R.context_windows(F.col("n_chars"))))


@query("q_batch_readiness", """
WITH f AS (SELECT doc_id, n_chars AS total, unnest(range((n_chars + 2559) // 2560)) AS batch FROM documents)
SELECT doc_id, batch, batch * 2560 AS start, least(2, (total - batch * 2560 + 1279) // 1280) AS frames, least(batch * 2560 + 2760, total) AS needed, batch * 2560 + 2760 > total AS flush FROM f""")
def q_batch_readiness(spark, sf_dir):
    """What each batch of 2560 waits for, with what it reads ahead, and its frames."""
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", F.inline(R.batch_readiness(F.col("n_chars"))))


@query("q_buffer_windows", """
WITH f AS (SELECT doc_id, n_chars AS total, unnest(range((n_chars + 2559) // 2560)) AS batch FROM documents)
SELECT doc_id, batch, batch * 2560 - 15360 AS lookback, batch * 2560 AS main, (batch + 1) * 2560 AS lookahead, (batch + 1) * 2560 + 640 AS stop, least((batch + 1) * 2560, total) AS processed_until FROM f""")
def q_buffer_windows(spark, sf_dir):
    """A buffer of 18560 samples that moves by 2560: where its look-back, main and look-ahead parts lie in the stream, and the last real sample of the main part."""
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars").filter("n_chars > 0")
    d = d.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(F.col("n_chars"), R.BATCH) - 1)))
    main = F.col("batch") * R.BATCH
    return d.select("doc_id", "batch", (main - 15360).alias("lookback"), main.alias("main"), (main + R.BATCH).alias("lookahead"), (main + R.BATCH + 640).alias("stop"), F.least(main + R.BATCH, F.col("n_chars")).alias("processed_until"))


@query("q_reset_cursor", f"""
WITH r AS (SELECT event_id, user_id, ts, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation,
  CASE WHEN event_type = 'error' OR row_number() OVER w = 1 THEN 1920 ELSE 2560 END AS advance FROM events {W})
SELECT event_id, generation, advance::BIGINT AS advance, sum(advance) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS processed FROM r""")
def q_reset_cursor(spark, sf_dir):
    """A cursor that an error resets: the first batch after it is shorter."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type")
    return R.reset_cursor(e, *U, F.col("event_type") == "error").select("event_id", "generation", "advance", "processed")


@query("q_receipts", """
WITH r AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type AS lane, epoch_us(ts) // 86400000000 AS step, event_id % 7 AS epoch, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, us, event_id, 'stale' AS failure FROM r WHERE epoch <> 0 UNION ALL SELECT user_id, us, event_id, 'early' FROM r WHERE us % 1000 < 100 UNION ALL SELECT user_id, us, event_id, 'duplicate' FROM r WHERE n > 1""")
def q_receipts(spark, sf_dir):
    """Receipts of a barrier that are of another epoch, early, or come twice for a lane and step (a day)."""
    e = events(spark, sf_dir, "user_id", "event_id", F.col("event_type").alias("lane")).withColumn("step", F.floor(F.col("us") / 86_400_000_000))
    e = e.withColumns({"epoch": F.col("event_id") % 7, "current_epoch": F.lit(0).cast("long"), "completed_at": F.col("us") % 1000, "ready_at": F.lit(100).cast("long")})
    return R.receipt_violations(e, *U)


@query("q_key_lifecycle", """
WITH a AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_id % 11 AS k, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'close' ELSE 'release' END AS a FROM events),
b AS (SELECT *, lag(a) OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS b, sum(CASE a WHEN 'open' THEN 1 WHEN 'release' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS held FROM a)
SELECT user_id, us, event_id, 'opened_twice' AS failure FROM b WHERE a = 'open' AND b IS NOT NULL UNION ALL SELECT user_id, us, event_id, 'closed_unopened' FROM b WHERE a = 'close' AND b IS DISTINCT FROM 'open'
UNION ALL SELECT user_id, us, event_id, 'released_unclosed' FROM b WHERE a = 'release' AND b IS DISTINCT FROM 'close' UNION ALL SELECT user_id, us, event_id, 'too_many' FROM b WHERE a = 'open' AND held > 2""")
def q_key_lifecycle(spark, sf_dir):
    """Keys of a user that open, close and are released out of turn, or more than two at a time."""
    action = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "close").otherwise("release")
    e = events(spark, sf_dir, "user_id", "event_id", "event_type").withColumn("k", F.col("event_id") % 11).withColumn("action", action)
    return R.key_lifecycle(e, ["k"], U[1], "action", 2, U[0])


@query("q_capacity", """
WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN -20 ELSE event_id % 10 END AS amount FROM events),
h AS (SELECT event_id, amount, coalesce(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM a)
SELECT event_id, amount::BIGINT AS amount, held::BIGINT AS held FROM h WHERE amount > 0 AND held + amount > 30""")
def q_capacity(spark, sf_dir):
    """Requests that would take what a user holds beyond 30, told before they are granted."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type").withColumn("amount", F.when(F.col("event_type") == "error", -20).otherwise(F.col("event_id") % 10).cast("long"))
    return R.capacity_violations(e, *U, "amount", 30).select("event_id", "amount", "held")


@query("q_bounded_state", """
WITH k AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chars, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bytes FROM conversations)
SELECT conv_id, turn, chars::BIGINT AS chars, bytes::BIGINT AS bytes FROM k WHERE chars > 1500 OR bytes > 1800""")
def q_bounded_state(spark, sf_dir):
    """Turns after which a conversation's text is beyond its limits of characters and bytes."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = S.so_far(S.by(["conv_id"], ["turn"]))
    return c.select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("chars"), F.sum(F.octet_length("text")).over(w).alias("bytes")).filter("chars > 1500 or bytes > 1800")


@query("q_evict", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS stop FROM lineitem),
c AS (SELECT o_orderkey, least(o_custkey % 60, o_custkey % 45) AS cursor FROM orders WHERE o_orderkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, stop FROM s LEFT JOIN c ON l_orderkey = o_orderkey WHERE cursor IS NULL OR stop > cursor""")
def q_evict(spark, sf_dir):
    """Spans of an order that the slower of two consumers has not passed."""
    from riverbed.plans.traces import spans

    o = table(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey").filter("l_orderkey % 3 <> 0")
    cursors = o.select("l_orderkey", F.explode(F.array(F.col("o_custkey") % 60, F.col("o_custkey") % 45)).alias("cursor"))
    return R.evict(spans(spark, sf_dir), cursors, ["l_orderkey"], "stop").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stop")


@query("q_consume_states", """
WITH k AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS t, length(text) % 5 <> 0 AS accepted, CASE WHEN role = 'user' THEN 'user_complete' WHEN turn % 4 = 3 THEN 'user_nonidle' ELSE 'user_idle' END AS token FROM conversations),
u AS (SELECT *, coalesce(max(CASE WHEN accepted AND token = 'user_complete' THEN length(t) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k),
d AS (SELECT *, CASE WHEN accepted AND token = 'user_complete' THEN regexp_replace(substr(t, used + 1), '^\\s+|\\s+$', '', 'g') END AS delta FROM u)
SELECT conv_id, turn, CASE WHEN delta <> '' THEN 'start' WHEN delta = '' THEN 'complete_without_new_text' WHEN accepted AND token = 'user_nonidle' THEN 'cancel' ELSE 'none' END AS action, delta FROM d""".replace("\\\\", "\\"))
def q_consume_states(spark, sf_dir):
    """Each published state of a growing text consumed once: starts with what is new, cancels, or nothing."""
    from riverbed.plans.traces import growth

    c = table(spark, sf_dir, "conversations")
    token = F.when(F.col("role") == "user", "user_complete").when(F.col("turn") % 4 == 3, "user_nonidle").otherwise("user_idle")
    c = c.select("conv_id", "turn", (F.length("text") % 5 != 0).alias("accepted"), token.alias("token"), growth(F.col("text")).alias("delta"))
    return R.consume_deltas(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "action", "delta")


@query("q_start_replies", """
WITH c AS (SELECT event_id, user_id, ts, event_type IN ('view', 'click', 'signup') AS s, event_type = 'signup' AS blank FROM events),
b AS (SELECT *, coalesce(last_value(CASE WHEN s AND NOT blank THEN true WHEN NOT s THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS busy FROM c),
o AS (SELECT *, CASE WHEN NOT s THEN CASE WHEN busy THEN 'ended' ELSE 'nothing_active' END WHEN blank THEN 'blank_ignored' WHEN busy THEN 'duplicate_start_ignored' ELSE 'started' END AS outcome FROM b),
n AS (SELECT *, count(*) FILTER (WHERE outcome = 'started') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT event_id, outcome, CASE WHEN outcome = 'started' THEN 't-r' || n END AS request_id, CASE WHEN outcome = 'started' THEN n + 99 END AS seed FROM n""")
def q_start_replies(spark, sf_dir):
    """Commands to a reply session: which starts count, their ids and seeds."""
    starts = F.col("event_type").isin("view", "click", "signup")
    e = events(spark, sf_dir, "user_id", "event_id", "event_type")
    e = e.withColumn("kind", F.when(starts, "start").otherwise("end")).withColumn("text", F.when(F.col("event_type") == "signup", " ").otherwise(F.col("event_type")))
    return R.start_replies(e, *U, seed=100).select("event_id", "outcome", "request_id", "seed")


@query("q_final_entries", r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END AS text, turn % 6 = 0 AS pending FROM conversations)
SELECT conv_id, turn, text FROM c WHERE regexp_matches(text, '\S') OR pending""")
def q_final_entries(spark, sf_dir):
    """Finished replies that enter the history: with text, or empty while a repair is to come."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("text", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")))
    return R.final_entries(c.withColumn("repair_pending", F.col("turn") % 6 == 0)).select("conv_id", "turn", "text")


@query("q_speaking", f"""
WITH r AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, sum(CASE WHEN event_type = 'view' THEN event_id % 3 ELSE 0 END) AS played, bool_or(event_type = 'error') AS cancelled, bool_or(event_type = 'signup') AS ended FROM events GROUP BY 1, 2)
SELECT user_id, day, NOT ended AS busy, played > 0 AND NOT cancelled AND NOT ended AS speaking FROM r""")
def q_speaking(spark, sf_dir):
    """Requests (a user's days) that are active, and those heard and not cancelled."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    r = e.groupBy("user_id", "day").agg(F.sum(F.when(F.col("event_type") == "view", F.col("event_id") % 3).otherwise(0)).alias("played"), F.bool_or(F.col("event_type") == "error").alias("cancelled"), F.bool_or(F.col("event_type") == "signup").alias("ended"))
    return r.select("user_id", "day", (~F.col("ended")).alias("busy"), ((F.col("played") > 0) & ~F.col("cancelled") & ~F.col("ended")).alias("speaking"))


@query("q_playback", f"""
WITH p AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'queue' WHEN 'purchase' THEN 'played' ELSE 'finish' END AS a FROM events),
b AS (SELECT *, coalesce(last_value(CASE a WHEN 'begin' THEN true WHEN 'finish' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS active,
  sum(CASE a WHEN 'queue' THEN 1 WHEN 'played' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS queued FROM p)
SELECT user_id, us, event_id, 'begun_while_active' AS failure FROM b WHERE a = 'begin' AND active UNION ALL SELECT user_id, us, event_id, 'finished_unbegun' FROM b WHERE a = 'finish' AND NOT active
UNION ALL SELECT user_id, us, event_id, 'completed_before_drained' FROM b WHERE a = 'finish' AND queued > 0""")
def q_playback(spark, sf_dir):
    """Playback of one request at a time, which completes once its queue is empty."""
    from riverbed.operators.metrics import gate

    a = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "queue").when(F.col("event_type") == "purchase", "played").otherwise("finish")
    e = events(spark, sf_dir, "user_id", "event_id", "event_type").withColumn("a", a)
    w = S.by(*U)
    active = F.last(F.when(F.col("a") == "begin", True).when(F.col("a") == "finish", False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("active", F.coalesce(active, F.lit(False))).withColumn("queued", F.sum(F.when(F.col("a") == "queue", 1).when(F.col("a") == "played", -1).otherwise(0)).over(S.so_far(w)))
    finish = F.col("a") == "finish"
    return gate(e, ["user_id", "us", "event_id"], {"begun_while_active": (F.col("a") == "begin") & F.col("active"), "finished_unbegun": finish & ~F.col("active"), "completed_before_drained": finish & (F.col("queued") > 0)})


@query("q_concat_spans", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS stop FROM lineitem)
SELECT l_orderkey, count(*) AS n, max(stop) AS total, coalesce(max(CASE WHEN l_linenumber % 4 <> 3 THEN stop END), -1.0) AS real_end, max(stop) - coalesce(max(CASE WHEN l_linenumber % 4 <> 3 THEN stop END), -1.0) AS unprocessed FROM s GROUP BY 1""")
def q_concat_spans(spark, sf_dir):
    """Spans put one after another: their total, the end of the last real one (line numbers other than 3, 7), and what is left after it."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    s = R.concat_spans(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_quantity")
    out = s.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("stop").alias("total"), R.real_end(F.col("l_linenumber") % 4 != 3, F.col("stop"), F.lit(-1.0)).alias("real_end"))
    return out.withColumn("unprocessed", F.col("total") - F.col("real_end"))


@query("q_lateness", f"""
WITH l AS (SELECT user_id, epoch_us(ts) AS us, event_id, (row_number() OVER w - 1) * 1280 AS sent, first_value(epoch_us(ts)) OVER w AS began FROM events {W})
SELECT event_id, round((us - began - (sent + 1280) * 1000000 / 16000) / 1000.0, 3)::DOUBLE AS late_ms FROM l""")
def q_lateness(spark, sf_dir):
    """How late each packet of 1280 samples comes: arrival less start less the time that its samples take, in milliseconds; early ones are negative."""
    e = events(spark, sf_dir, "user_id", "event_id")
    w = S.by(*U)
    sent = (F.row_number().over(w).cast("long") - 1) * 1280
    due = F.first("us").over(S.so_far(w)) + (sent + 1280) * 1_000_000 / 16000
    return e.select("event_id", F.round((F.col("us") - due) / 1000.0, 3).alias("late_ms"))


@query("q_zip_rows", """
WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS position FROM conversations)
SELECT u.conv_id, u.position, u.text AS asked, a.text AS answer FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.position = a.position AND u.role = 'user' AND a.role = 'assistant'""")
def q_zip_rows(spark, sf_dir):
    """User and assistant turns of a conversation by position."""
    c = table(spark, sf_dir, "conversations")
    side = lambda role, name: c.filter(F.col("role") == role).select("conv_id", "turn", F.col("text").alias(name))
    return J.zip_rows(side("user", "asked"), side("assistant", "answer"), ["conv_id"], "turn")


@query("q_running_union", """
SELECT event_id, array_to_string(list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))), ',') AS labels FROM events""")
def q_running_union(spark, sf_dir):
    """Types of a user-day so far."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return e.select("event_id", F.array_join(R.running_union(F.col("event_type"), ["user_id", "day"], U[1]), ",").alias("labels"))


@query("q_progress", """
SELECT user_id, count(*) AS n, sum(count(*)) OVER (ORDER BY user_id)::BIGINT AS done, sum(count(*) FILTER (WHERE event_type = 'purchase')) OVER (ORDER BY user_id)::BIGINT AS successes FROM events GROUP BY 1""")
def q_progress(spark, sf_dir):
    """Cumulative results after each case, in order of cases. The ordered pass reads one row for each user."""
    n = table(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("ok"))
    w = Window.orderBy("user_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select("user_id", "n", F.sum("n").over(w).alias("done"), F.sum("ok").over(w).alias("successes"))


@query("q_lag_points", f"""
WITH p AS (SELECT user_id, row_number() OVER w - 1 AS step, value, event_type FROM events {W})
SELECT user_id, step, round(value * 1000, 3) AS lag_ms FROM p WHERE event_type <> 'error'""")
def q_lag_points(spark, sf_dir):
    """The points of a plot of lag by step; batches that were not published (errors) are left out, and steps keep their numbers."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "value").withColumn("step", (F.row_number().over(S.by(*U)) - 1).cast("long"))
    return e.filter("event_type <> 'error'").select("user_id", "step", F.round(F.col("value") * 1000, 3).alias("lag_ms"))
