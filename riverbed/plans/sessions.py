"""Folds that a stream runs too: growing texts, periodic analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.sources.tables import events, table
from riverbed.streaming import analysis, growing, replies

HALF_DAY_MS = 43_200_000


def deltas(spark, sf_dir) -> DataFrame:
    """Turns as growing texts: cut into deltas of equal width, which differs from turn to turn. A system's turn is blank, some are cancelled instead of done, and after some one more delta comes."""
    c = table(spark, sf_dir, "conversations")
    number, salt = F.col("conv_id") * 31 + F.col("turn") * 17, F.col("conv_id") + F.col("turn")
    text = F.when(F.col("role") == "system", F.repeat(F.lit(" "), F.length("text"))).otherwise(F.col("text"))
    c = c.select(F.concat_ws(":", "conv_id", "turn").alias("key"), text.alias("t"), (1 + number % 23).cast("int").alias("w"), (salt % 13 == 0).alias("cancelled"), (salt % 17 == 0).alias("more"))
    n = F.ceil(F.length("t") / F.col("w")).cast("int")
    part = lambda k: F.struct(k.cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substr("t", k * F.col("w") + 1, F.col("w")).alias("text"))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), part)).otherwise(F.array().cast("array<struct<seq:bigint,kind:string,text:string>>"))
    last = F.struct(n.cast("long").alias("seq"), F.when(F.col("cancelled"), "cancel").otherwise("done").alias("kind"), F.lit(None).cast("string").alias("text"))
    after = F.struct((n + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.lit("more").alias("text"))
    rows = F.concat(parts, F.array(last), F.when(F.col("more"), F.array(after)).otherwise(F.array().cast("array<struct<seq:bigint,kind:string,text:string>>")))
    return c.select("key", F.explode(rows).alias("r")).select("key", "r.*")


_END = r"""CASE WHEN m <> '' AND b + length(m) <= lim THEN b + length(m) WHEN length(pending) > lim THEN CASE WHEN j BETWEEN 1 AND lim THEN lim + 1 - j ELSE lim END WHEN closing THEN length(pending) END"""


@query("q_growing_segments", rf"""
WITH RECURSIVE c AS (SELECT conv_id || ':' || turn AS key, CASE WHEN role = 'system' THEN repeat(' ', length(text)) ELSE text END AS t, (1 + (conv_id * 31 + turn * 17) % 23)::INTEGER AS w,
  (conv_id + turn) % 13 = 0 AS cancelled, (conv_id + turn) % 17 = 0 AS more FROM conversations),
d AS (SELECT *, ceil(length(t) / w)::INTEGER AS n, trim(t) <> '' AS worded FROM c),
r(key, i, k, pending, pos, piece, closing) AS (
  SELECT key, 0, 0, '', 0::BIGINT, NULL::VARCHAR, false FROM d
  UNION ALL
  SELECT key, i + 1, CASE WHEN e IS NULL AND k < n THEN k + 1 ELSE k END, CASE WHEN e IS NOT NULL THEN substr(pending, e + 1) WHEN k < n THEN pending || substr(t, k * w + 1, w) ELSE pending END,
    pos + CASE WHEN e IS NOT NULL AND regexp_matches(left(pending, e), '\S') THEN 1 ELSE 0 END, CASE WHEN e IS NOT NULL THEN regexp_replace(left(pending, e), '^\s+|\s+$', '', 'g') END, closing OR (e IS NULL AND k = n)
  FROM (SELECT *, CASE WHEN pending <> '' THEN {_END} END AS e FROM (
    SELECT r.*, d.n, d.t, d.w, d.cancelled, regexp_extract(pending, '[.!?](?:\s+|$)') AS m, length(regexp_extract(pending, '(?s)^(.*?)[.!?](?:\s+|$)', 1)) AS b,
      CASE WHEN pos = 0 THEN 20 ELSE 40 END AS lim, strpos(reverse(left(pending, CASE WHEN pos = 0 THEN 21 ELSE 41 END)), ' ') AS j FROM r JOIN d USING (key)))
  WHERE e IS NOT NULL OR k < n OR NOT (closing OR cancelled)),
z AS (SELECT key, max(pos) AS pos FROM r GROUP BY key)
SELECT key, pos - 1 AS pos, piece AS segment, 'segment' AS kind FROM r WHERE piece <> ''
UNION ALL SELECT key, pos, NULL, CASE WHEN cancelled THEN 'cancelled' WHEN worded THEN 'end' ELSE 'empty' END FROM z JOIN d USING (key)
UNION ALL SELECT key, pos, 'more', 'after_end' FROM z JOIN d USING (key) WHERE more""")
def q_growing_segments(spark, sf_dir):
    """Segments of turns whose text comes delta by delta, with a row for each end, empty or cancelled text, and delta that came too late."""
    return growing.segments_batch(deltas(spark, sf_dir))


def analysis_events(spark, sf_dir) -> DataFrame:
    """Events as those of analysis tasks: a signup requests, a view updates, clicks and purchases are returns, errors returns or noise."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "ts")
    odd = F.col("event_id") % 2 == 1
    kind = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "view", "update").when((F.col("event_type") == "error") & odd, "audio").otherwise("return")
    progress = F.when(F.col("event_type") == "click", "continue").when(F.col("event_type") == "purchase", "done").when((F.col("event_type") == "error") & (F.col("event_id") % 6 == 0), "lost").when(F.col("event_type") == "error", "await_input")
    result = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 != 0), F.concat(F.lit("r"), F.col("event_id")))
    return e.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "us", F.col("event_id").alias("id"), kind.alias("kind"), progress.alias("progress"), result.alias("result"))


_ACT = lambda us, i, action, task, cycle, read, detail="NULL": f"{{'us': {us}, 'id': {i}, 'action': '{action}', 'task': {task}, 'cycle': {cycle}, 'based_on': {read}, 'detail': {detail}}}"
_TIMEOUT = HALF_DAY_MS * 1000


@query("q_analysis_cycles", f"""
WITH RECURSIVE e AS (SELECT user_id AS session, epoch_us(ts) AS us, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p,
  CASE WHEN event_type = 'signup' THEN 'request' WHEN event_type = 'view' THEN 'update' WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'audio' ELSE 'return' END AS kind,
  CASE event_type WHEN 'click' THEN 'continue' WHEN 'purchase' THEN 'done' WHEN 'error' THEN CASE WHEN event_id % 6 = 0 THEN 'lost' ELSE 'await_input' END ELSE '' END AS progress,
  CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN 'r' || event_id END AS result FROM events),
r(session, p, status, task, cycle, read, position, started, version, acts) AS (
  SELECT DISTINCT session, 0::BIGINT, 'idle', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(us BIGINT, id BIGINT, action VARCHAR, task BIGINT, cycle BIGINT, based_on BIGINT, detail VARCHAR)[] FROM e
  UNION ALL
  SELECT session, p, CASE WHEN run THEN 'running' WHEN go THEN 'idle' WHEN back THEN CASE WHEN progress = 'await_input' THEN 'waiting' ELSE 'idle' END ELSE st END, task2, CASE WHEN run THEN cycle1 + 1 ELSE cycle1 END,
    CASE WHEN run THEN pos2 ELSE read END, pos2, CASE WHEN run THEN us ELSE started END, version2,
    list_filter([CASE WHEN ex THEN {_ACT(f"started + {_TIMEOUT}", "NULL", "timed_out", "task", "cycle", "read")} END, CASE WHEN kind = 'request' AND st <> 'idle' THEN {_ACT("us", "id", "request_merged", "task", "cycle", "read")} END,
      CASE WHEN kind = 'return' AND NOT back THEN {_ACT("us", "id", "stray_return", "task", "cycle", "read")} END, CASE WHEN back AND progress = 'await_input' AND NOT unread THEN {_ACT("us", "id", "waiting", "task", "cycle", "read")} END,
      CASE WHEN back AND progress = 'done' AND result IS NOT NULL AND unread THEN {_ACT("us", "id", "result_withheld", "task", "cycle", "read", "result")} END, CASE WHEN published THEN {_ACT("us", "id", "result_published", "task", "cycle", "read", "version2 || ':' || result")} END,
      CASE WHEN back AND (progress = 'lost' OR progress = 'done' AND result IS NULL) THEN {_ACT("us", "id", "failed", "task", "cycle", "read")} END, CASE WHEN go AND NOT run THEN {_ACT("us", "id", "budget_spent", "task2", "cycle1", "read")} END,
      CASE WHEN run THEN {_ACT("us", "id", "cycle_started", "task2", "cycle1 + 1", "pos2")} END], lambda a: a IS NOT NULL)
  FROM (SELECT *, go AND cycle1 < 3 AS run, version + published::INTEGER AS version2 FROM (
    SELECT *, kind = 'request' AND st = 'idle' OR kind = 'update' AND st = 'waiting' OR back AND (progress = 'continue' OR unread AND (progress = 'await_input' OR progress = 'done' AND result IS NOT NULL)) AS go,
      back AND progress = 'done' AND result IS NOT NULL AND NOT unread AS published, task + (kind = 'request' AND st = 'idle')::INTEGER AS task2, CASE WHEN kind = 'request' AND st = 'idle' THEN 0 ELSE cycle END AS cycle1 FROM (
      SELECT *, kind = 'return' AND st = 'running' AS back FROM (
        SELECT e.*, r.* EXCLUDE (session, p), status = 'running' AND (started + {_TIMEOUT}) // 1000 < us // 1000 AS ex, CASE WHEN status = 'running' AND (started + {_TIMEOUT}) // 1000 < us // 1000 THEN 'idle' ELSE status END AS st,
          position + (kind = 'update')::INTEGER AS pos2, position > read AS unread FROM r JOIN e ON e.session = r.session AND e.p = r.p + 1))))),
h AS (SELECT max(us) // 1000 AS h FROM e), z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY p DESC) = 1)
SELECT session, a.us AS us, a.id AS id, a.action AS action, a.task AS task, a.cycle AS cycle, a.based_on AS based_on, a.detail AS detail FROM (SELECT session, unnest(acts) AS a FROM r)
UNION ALL SELECT session, started + {_TIMEOUT}, NULL, 'timed_out', task, cycle, read, NULL FROM z, h WHERE status = 'running' AND (started + {_TIMEOUT}) // 1000 < h""")
def q_analysis_cycles(spark, sf_dir):
    """What becomes of each user's analysis tasks: calls, results published or withheld, tasks that wait, fail, run out of calls or of time."""
    return analysis.analysis_batch(analysis_events(spark, sf_dir), budget=3, timeout_ms=HALF_DAY_MS)


def reply_events(spark, sf_dir) -> DataFrame:
    """Events as those of reply sessions: views, clicks and purchases publish states, errors play, signups complete or repair. Some states repeat a step, some claim another text before."""
    i, kind = F.col("event_id"), F.col("event_type")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("is_state", kind.isin("view", "click", "purchase"))
    delta = F.when(kind == "view", F.concat(F.lit("w"), i, F.lit(" "))).when((kind == "purchase") & (i % 3 != 0), F.concat(F.lit("p"), i)).otherwise("")
    e = e.withColumn("delta", delta).withColumn("counted", F.col("is_state") & (i % 31 != 0) & (i % 37 != 0))
    n = F.count_if("counted").over(so_far)
    chars = F.coalesce(F.sum(F.when(F.col("counted"), F.length("delta"))).over(before), F.lit(0))
    asked = F.greatest(F.lit(1), F.count_if((kind == "purchase") & (i % 3 != 0)).over(so_far))
    e = e.withColumns({"step_id": F.when(F.col("counted") | (i % 31 == 0), n - 1).otherwise(n), "chars": F.when(F.col("counted") | (i % 31 == 0), chars).otherwise(-1), "seq": F.row_number().over(w), "asked": asked})
    state = F.col("is_state")
    kinds = F.when(state, "state").when(kind == "error", "played").when(i % 2 == 0, "completed").otherwise("repaired")
    none = lambda c, t: F.when(state, c).cast(t)
    return e.select(
        F.col("user_id").alias("session"), F.col("seq").cast("long").alias("seq"), kinds.alias("kind"), none(F.col("step_id"), "long").alias("step_id"), none(F.when(kind == "purchase", "user_complete").when(kind == "click", "user_nonidle").otherwise("user_idle"), "string").alias("token"),
        none((kind != "click") | (i % 2 == 0), "boolean").alias("accepted"), none(F.col("delta"), "string").alias("delta"), none(F.col("chars"), "long").alias("chars"), F.lit(None).cast("long").alias("crc"), F.when(~state, F.concat(F.lit("r"), F.col("asked"))).alias("request"),
        F.when(~state, F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("heard "), i))).alias("text"), F.when(kinds == "played", i % 3 * 160).cast("long").alias("tail"), F.when(kinds == "repaired", F.when(i % 5 == 0, 2).otherwise(1)).cast("long").alias("version"),
    )


_SAY = lambda action, request="NULL", text="NULL", version="NULL": f"{{'action': '{action}', 'request': {request}, 'text': {text}, 'version': {version}}}"


@query("q_reply_session", f"""
WITH RECURSIVE a AS (SELECT user_id AS session, event_id AS i, event_type AS t, row_number() OVER w AS seq, event_type IN ('view', 'click', 'purchase') AS st, event_type IN ('view', 'click', 'purchase') AND event_id % 31 <> 0 AND event_id % 37 <> 0 AS counted,
    CASE WHEN event_type = 'view' THEN 'w' || event_id || ' ' WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 'p' || event_id ELSE '' END AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
b AS (SELECT *, count(*) FILTER (WHERE counted) OVER w AS n, coalesce(sum(length(delta)) FILTER (WHERE counted) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS len,
    'r' || greatest(1, count(*) FILTER (WHERE t = 'purchase' AND i % 3 <> 0) OVER w) AS req FROM a WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT session, seq, i, t, st, delta, CASE WHEN counted OR i % 31 = 0 THEN n - 1 ELSE n END AS step_id, CASE WHEN counted OR i % 31 = 0 THEN len ELSE -1 END AS claimed, req, CASE WHEN i % 4 = 0 THEN '' ELSE 'heard ' || i END AS txt FROM b),
r(session, seq, step, chars, pending, counter, cur, spoken, tail, role, waiting, said) AS (
  SELECT DISTINCT session, 0::BIGINT, -1::BIGINT, 0::BIGINT, '', 0::BIGINT, '', '', 0::BIGINT, '', []::STRUCT(r VARCHAR, s VARCHAR)[], []::STRUCT(action VARCHAR, request VARCHAR, text VARCHAR, version BIGINT)[] FROM e
  UNION ALL
  SELECT session, seq, CASE WHEN ok THEN step + 1 ELSE step END, CASE WHEN ok THEN chars + length(delta) ELSE chars END, CASE WHEN starts THEN '' ELSE pend END, counter + starts::INTEGER,
    CASE WHEN starts THEN 'r' || (counter + 1) WHEN stops OR ends THEN '' ELSE cur END, CASE WHEN stops OR ends THEN '' WHEN plays THEN txt ELSE spoken END, CASE WHEN stops OR ends THEN 0 WHEN plays THEN i % 3 * 160 ELSE tail END,
    CASE WHEN starts THEN 'user' WHEN (stops OR ends) AND (trim(spoken) <> '' OR stops AND tail > 0) THEN 'assistant' ELSE role END,
    CASE WHEN stops AND tail > 0 THEN list_append(waiting, {{'r': cur, 's': trim(spoken)}}) WHEN fixes THEN list_filter(waiting, lambda x: x.r <> req) ELSE waiting END,
    list_filter([CASE WHEN st AND step_id <> step + 1 THEN {_SAY("missing_step")} END, CASE WHEN st AND step_id = step + 1 AND claimed <> chars THEN {_SAY("prefix_changed")} END, CASE WHEN ok AND t = 'purchase' AND NOT starts THEN {_SAY("complete_without_new_text")} END,
      CASE WHEN stops THEN {_SAY("cancelled", "cur", "CASE WHEN t = 'click' THEN 'nonidle' ELSE 'new_complete' END")} END, CASE WHEN stops AND tail > 0 THEN {_SAY("history_pending", "cur", "NULL", "1")} END,
      CASE WHEN (stops OR ends) AND (trim(spoken) <> '' OR stops AND tail > 0) THEN {_SAY("assistant_entry", "cur", "trim(spoken)")} END,
      CASE WHEN starts AND CASE WHEN stops AND (trim(spoken) <> '' OR tail > 0) THEN 'assistant' ELSE role END = 'user' THEN {_SAY("user_merged", "'r' || (counter + 1)", "trim(pend)")} WHEN starts THEN {_SAY("user_entry", "'r' || (counter + 1)", "trim(pend)")} END,
      CASE WHEN starts THEN {_SAY("reply_started", "'r' || (counter + 1)", "trim(pend)")} END, CASE WHEN t = 'error' AND NOT plays THEN {_SAY("late_audio_discarded", "req")} END,
      CASE WHEN ends THEN {_SAY("completed", "req")} WHEN t = 'signup' AND i % 2 = 0 THEN {_SAY("stray_completion", "req")} END,
      CASE WHEN fixes THEN {_SAY("history_repaired", "req", "trim(list_filter(waiting, lambda x: x.r = req)[1].s || ' ' || txt)", "1")} WHEN t = 'signup' AND i % 2 = 1 THEN {_SAY("repair_stale", "req")} END], lambda x: x IS NOT NULL)
  FROM (SELECT *, cur <> '' AND (starts OR ok AND t = 'click' AND i % 2 = 0) AS stops FROM (SELECT *, ok AND t = 'purchase' AND trim(pend) <> '' AS starts FROM (
    SELECT *, CASE WHEN ok THEN pending || delta ELSE pending END AS pend FROM (
      SELECT e.*, r.* EXCLUDE (session, seq), st AND step_id = step + 1 AND claimed = chars AS ok, t = 'error' AND req = cur AS plays, t = 'signup' AND i % 2 = 0 AND req = cur AS ends,
        t = 'signup' AND i % 2 = 1 AND i % 5 <> 0 AND len(list_filter(waiting, lambda x: x.r = req)) > 0 AS fixes FROM r JOIN e ON e.session = r.session AND e.seq = r.seq + 1)))))
SELECT session, seq, s.action AS action, s.request AS request, s.text AS text, s.version AS version FROM (SELECT session, seq, unnest(said) AS s FROM r)""")
def q_reply_session(spark, sf_dir):
    """What becomes of users' replies: started, merged, cancelled, completed, repaired, and what came out of turn."""
    return replies.replies_batch(reply_events(spark, sf_dir))
