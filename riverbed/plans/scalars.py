"""Scalars, projections, ordered choices and scores, row by row or by small groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.functions import scalars as C
from riverbed.operators import metrics as M
from riverbed.operators import rules as R
from riverbed.operators import sequence as S
from riverbed.sources.tables import events, table

U = (["user_id"], ["us", "event_id"])
W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
DAY = 86_400_000_000


@query("q_regex_extract", r"""
SELECT event_id, regexp_extract(props, '"k":\s*([0-9.eE+-]+)', 1)::DOUBLE AS k, len(regexp_extract_all(props || ts::VARCHAR, '[0-9]+')) AS n_numbers FROM events""")
def q_regex_extract(spark, sf_dir):
    """A number after a label, and how many runs of digits a line holds."""
    e = table(spark, sf_dir, "events", "event_id", "props", "ts")
    line = F.concat("props", F.col("ts").cast("string"))
    return e.select("event_id", F.regexp_extract("props", r'"k":\s*([0-9.eE+-]+)', 1).cast("double").alias("k"), F.size(F.regexp_extract_all(line, F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"))


@query("q_find_all", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]{9,}'), ',') AS found FROM documents")
def q_find_all(spark, sf_dir):
    """All long runs of a capital and small ASCII letters of a text, in order."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0)), ",").alias("found"))


@query("q_base64", "SELECT doc_id, sha256(base64(encode(text))) AS digest, length(base64(encode(text))) AS n, decode(from_base64(base64(encode(text)))) = text AS same FROM documents")
def q_base64(spark, sf_dir):
    """Texts as base64 and back."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("b", F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", ""))
    return d.select("doc_id", F.sha2("b", 256).alias("digest"), F.length("b").cast("long").alias("n"), (F.decode(F.unbase64("b"), "utf-8") == F.col("text")).alias("same"))


@query("q_half_even", "SELECT event_id, round_even(event_id / 2.0::DOUBLE, 0)::BIGINT AS half, round_even(event_id * 22050::DOUBLE / 16000, 0)::BIGINT AS frames, round_even(event_id * 22050::DOUBLE / 16000, 0) > event_id + 3000 AS beyond FROM events")
def q_half_even(spark, sf_dir):
    """Halves rounded to even, and windows cropped from one rate to another that their source does not cover."""
    e = table(spark, sf_dir, "events", "event_id")
    frames = C.crop_frames(F.col("event_id").cast("double"), F.lit(22050), F.lit(16000))
    return e.select("event_id", C.half_even(F.col("event_id") / 2.0).alias("half"), frames.alias("frames"), (frames > F.col("event_id") + 3000).alias("beyond"))


@query("q_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS at FROM events")
def q_utc_text(spark, sf_dir):
    return events(spark, sf_dir, "event_id").select("event_id", C.utc_text(F.col("us")).alias("at"))


@query("q_gain", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE x END::DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM v)
SELECT vec_id, CASE WHEN rms = 0 THEN 1.0 ELSE round(least(0.05::DOUBLE / rms, 0.9::DOUBLE / peak), 6) END AS gain FROM m""")
def q_gain(spark, sf_dir):
    """What brings vectors, as samples, to a level without clipping; every tenth is silent."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    quiet = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x.cast("double")))
    return v.select("vec_id", F.round(C.gain(quiet), 6).alias("gain"))


@query("q_struct_edit", """
SELECT event_id, to_json({event_id: event_id, lane: 'joint', value: CASE WHEN event_type = 'error' THEN -1.0 ELSE value END}) AS merged, to_json({event_type: event_type, props: props}) AS kept,
  event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND props IS NOT DISTINCT FROM lag(props) OVER w AS same FROM events """ + W)
def q_struct_edit(spark, sf_dir):
    """Structs merged so that the later value wins, without some fields, and compared on the fields that remain."""
    e = events(spark, sf_dir)
    row = F.struct("event_id", F.lit("single").alias("lane"), "value", "event_type", "props")
    merged = row.withField("lane", F.lit("joint")).withField("value", F.when(F.col("event_type") == "error", -1.0).otherwise(row["value"])).dropFields("event_type", "props")
    kept = row.dropFields("event_id", "lane", "value")
    same = kept.eqNullSafe(F.lag(kept).over(S.by(*U)))
    return e.select("event_id", F.to_json(merged).alias("merged"), F.to_json(kept).alias("kept"), same.alias("same"))


@query("q_control_projection", """
WITH a AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_type, event_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS text, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, a.text = b.text AS equal FROM a JOIN a b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = b.event_type AND b.n = a.n + 1""")
def q_control_projection(spark, sf_dir):
    """Neighbouring controls of a lane compared without their ids, and without text where it may be left out (errors)."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "props").withColumn("day", F.floor(F.col("us") / DAY))
    text = F.when(F.col("event_type") == "error", "").otherwise(F.col("props"))
    after = F.lead(text).over(S.by(["user_id", "day", "event_type"], U[1]))
    return e.select("event_id", (text == after).alias("equal")).filter("equal is not null")


@query("q_strict_types", r"""
WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '-3' WHEN 2 THEN '1e3' WHEN 3 THEN 'NaN' WHEN 4 THEN '1e999' WHEN 5 THEN NULL WHEN 6 THEN event_id::VARCHAR ELSE value::DECIMAL(12, 2)::VARCHAR END AS token FROM events),
x AS (SELECT event_id, token, CASE WHEN regexp_full_match(token, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND token <> '1e999' THEN token::DOUBLE END AS v FROM t)
SELECT event_id, coalesce(regexp_full_match(token, '-?[0-9]+'), false) AS is_integer, coalesce(isfinite(v), false) AS is_finite, coalesce(isfinite(v) AND v >= 0, false) AS is_natural FROM x""")
def q_strict_types(spark, sf_dir):
    """Tokens that are integers (true is none), finite numbers, and such from 0 on."""
    e = table(spark, sf_dir, "events", "event_id", "value")
    k = F.col("event_id") % 8
    token = F.when(k == 0, "true").when(k == 1, "-3").when(k == 2, "1e3").when(k == 3, "NaN").when(k == 4, "1e999").when(k == 5, F.lit(None)).when(k == 6, F.col("event_id").cast("string")).otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    return e.select("event_id", *[c.alias(n) for n, c in R.strict_number(token).items()])


@query("q_identifiers", "SELECT page_id, regexp_full_match(url, 'https?://[a-z0-9.-]+(/[A-Za-z0-9._-]*)*') AS valid FROM pages")
def q_identifiers(spark, sf_dir):
    """Addresses that match a pattern from end to end."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", R.full_match(F.col("url"), "https?://[a-z0-9.-]+(/[A-Za-z0-9._-]*)*").alias("valid"))


@query("q_distinct_sorted", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS labels, count(DISTINCT event_type) = 5 AS complete FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def q_distinct_sorted(spark, sf_dir):
    """The sorted set of a user's types, and whether it holds all."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter("event_id % 3 = 0")
    labels = F.sort_array(F.collect_set("event_type"))
    return e.groupBy("user_id").agg(F.array_join(labels, ",").alias("labels"), (F.size(labels) == 5).alias("complete"))


@query("q_first_text", r"SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE regexp_matches(text, '\S') AND role <> 'system' GROUP BY 1")
def q_first_text(spark, sf_dir):
    """The first text of a conversation that is not blank."""
    c = table(spark, sf_dir, "conversations").filter(F.col("text").rlike(r"\S") & (F.col("role") != "system"))
    return c.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))


@query("q_real_time_factor", "SELECT user_id, round(sum(round(value * 1000000)::BIGINT)::DOUBLE / 1000000 / 1000 / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 0), 12) AS factor FROM events GROUP BY 1")
def q_real_time_factor(spark, sf_dir):
    """Seconds of compute (value in milliseconds) for each second of a user's stream; null for a stream without length."""
    seconds = (F.max("us") - F.min("us")) / 1_000_000
    return events(spark, sf_dir, "user_id", "value").groupBy("user_id").agg(F.round(F.try_divide(M.exact_sum(F.col("value")) / 1000, seconds), 12).alias("factor"))


@query("q_first_appearance", """
WITH f AS (SELECT user_id, event_type, min((epoch_us(ts), event_id)) AS first, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f""")
def q_first_appearance(spark, sf_dir):
    """A user's types in order of their first appearance."""
    f = events(spark, sf_dir, "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.min(F.struct("us", "event_id")).alias("first"), F.count("*").alias("n"))
    return f.select("user_id", "event_type", "n", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("place"))


@query("q_failure_labels", f"""
WITH p AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) - 1 AS i, event_type, value FROM events),
l AS (SELECT user_id, day, i, 0 AS k, i || ':error' AS label FROM p WHERE event_type = 'error' UNION ALL SELECT user_id, day, i, 1, i || ':low' FROM p WHERE value < 5)
SELECT user_id, day, string_agg(label, ',' ORDER BY i, k) AS failures FROM l GROUP BY 1, 2""")
def q_failure_labels(spark, sf_dir):
    """The failures of a user's day as index:label, in order of rows, then of rules."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "value").withColumn("day", F.floor(F.col("us") / DAY))
    e = e.withColumn("i", F.row_number().over(S.by(["user_id", "day"], U[1])) - 1)
    rules = F.array_compact(F.array(F.when(F.col("event_type") == "error", F.struct("i", F.lit(0).alias("k"), F.lit("error").alias("label"))), F.when(F.col("value") < 5, F.struct("i", F.lit(1).alias("k"), F.lit("low").alias("label")))))
    rows = e.select("user_id", "day", F.explode(rules).alias("r")).groupBy("user_id", "day").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return rows.select("user_id", "day", F.array_join(F.transform("rs", lambda r: F.concat(r["i"].cast("string"), F.lit(":"), r["label"])), ",").alias("failures"))


@query("q_ordered_choice", """
WITH want(place, event_type) AS (VALUES (0, 'purchase'), (1, 'signup'), (2, 'view'))
SELECT user_id, arg_min(event_id, (place, event_id)) AS event_id, arg_min(event_type, (place, event_id)) AS event_type, array_to_string(list_sort(list(DISTINCT place)), ',') = '0,1,2' AS all_there FROM events JOIN want USING (event_type) GROUP BY 1""")
def q_ordered_choice(spark, sf_dir):
    """The first event of a user by a fixed list's order, and whether all of the list are there in that order."""
    place = F.array_position(F.array(*map(F.lit, ("purchase", "signup", "view"))), F.col("event_type")) - 1
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumn("place", place).filter("place >= 0")
    order = F.struct("place", "event_id")
    there = F.sort_array(F.collect_set("place")) == F.array(*[F.lit(k).cast("long") for k in range(3)])
    return e.groupBy("user_id").agg(F.min_by("event_id", order).alias("event_id"), F.min_by("event_type", order).alias("event_type"), there.alias("all_there"))


@query("q_tail", "SELECT doc_id, right(text, 4096) AS tail, length(text) > 4096 AS cut FROM documents")
def q_tail(spark, sf_dir):
    """The last 4096 characters of each text."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.expr("right(text, 4096)").alias("tail"), (F.length("text") > 4096).alias("cut"))


SCORED = """
t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'smooth_turn_taking' WHEN 1 THEN 'user_interruption' ELSE 'pause_handling' END AS task, [value, value + 1.5] AS times, event_id % 5 AS n, value - 1 + event_id % 4 AS first, (value - 1 + event_id % 4) + event_id % 7 * 0.25 AS last FROM events),
o AS (SELECT *, CASE task WHEN 'smooth_turn_taking' THEN times[1] WHEN 'user_interruption' THEN times[2] END AS origin, n > 0 AND (last - first >= 1 OR n > 3) AS took FROM t)"""


def _scored(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "value")
    k = F.col("event_id") % 3
    e = e.withColumn("task", F.when(k == 0, "smooth_turn_taking").when(k == 1, "user_interruption").otherwise("pause_handling"))
    e = e.withColumn("origin", C.turn_origin(F.col("task"), F.array("value", F.col("value") + 1.5))).withColumn("n", F.col("event_id") % 5).withColumn("first", F.col("value") - 1 + F.col("event_id") % 4)
    last = F.col("first") + F.col("event_id") % 7 * 0.25
    return e.withColumn("took", (F.col("n") > 0) & ((last - F.col("first") >= 1) | (F.col("n") > 3)))


@query("q_turn_scores", f"WITH {SCORED} SELECT event_id, task, took::INTEGER AS took_turn, CASE WHEN took AND origin IS NOT NULL THEN round(greatest(first - origin, 0), 6) END AS latency, CASE WHEN n > 0 THEN round(first - origin, 6) END AS raw_latency FROM o")
def q_turn_scores(spark, sf_dir):
    """Scores of turns by task: where they count from, whether a turn was taken, the latency, and the one that is not gated."""
    s = _scored(spark, sf_dir)
    raw = F.round(C.raw_latency(F.col("first"), F.col("origin")), 6)
    gated = F.round(C.clamp_low(F.col("first") - F.col("origin"), 0.0), 6)
    return s.select("event_id", "task", F.col("took").cast("int").alias("took_turn"), F.when(F.col("took"), gated).alias("latency"), F.when(F.col("n") > 0, raw).alias("raw_latency"))


@query("q_turn_aggregates", f"""
WITH {SCORED} SELECT task, count(*) AS n, sum(took::INTEGER)::BIGINT AS successes, round(avg(took::INTEGER), 6) AS rate, count(*) FILTER (WHERE took AND origin IS NOT NULL) AS latency_n,
  ((2 * sum(round(greatest(first - origin, 0) * 1000000)::BIGINT) FILTER (WHERE took AND origin IS NOT NULL) + count(*) FILTER (WHERE took AND origin IS NOT NULL))
    // (2 * nullif(count(*) FILTER (WHERE took AND origin IS NOT NULL), 0)))::DOUBLE / 1e6 AS latency_mean, count(*) FILTER (WHERE took AND first < origin) AS early FROM o GROUP BY 1""")
def q_turn_aggregates(spark, sf_dir):
    """Rates and mean latencies by task over all planned turns, and successes whose first word comes before they count."""
    s = _scored(spark, sf_dir)
    latency = F.when(F.col("took"), C.clamp_low(F.col("first") - F.col("origin"), 0.0))
    return s.groupBy("task").agg(*M.success_report(F.col("took"), latency), F.count_if(F.col("took") & (F.col("first") < F.col("origin"))).alias("early"))


@query("q_list_equal", """
WITH p AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1)
SELECT conv_id, roles, roles = 'user,assistant' OR roles = 'system,user,assistant' AS as_planned FROM p""")
def q_list_equal(spark, sf_dir):
    """Whether the roles of a conversation, in order, are one of two planned lists."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    roles = F.transform("r", lambda x: x["role"])
    plans = [F.array(*map(F.lit, p)) for p in (["user", "assistant"], ["system", "user", "assistant"])]
    return c.select("conv_id", F.array_join(roles, ",").alias("roles"), ((roles == plans[0]) | (roles == plans[1])).alias("as_planned"))


@query("q_derived_lags", """
WITH e AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS t, value FROM events)
SELECT event_id, round((t - 10 - event_id * 1280.0::DOUBLE / 16000) * 1000, 3) AS main_lag, round(value * 1000, 3) AS compute_ms, round((t - 10 - event_id * 1280.0::DOUBLE / 16000) * 1000 - (t - (t - value)) * 1000, 3) AS state_lag FROM e""")
def q_derived_lags(spark, sf_dir):
    """Lag behind the stream, duration, and the lag of a state that was available (value seconds) before its release."""
    e = events(spark, sf_dir, "event_id", "value").withColumn("at", F.col("us") / 1_000_000 - 1_704_067_200)
    main = C.lag_ms(F.col("at"), F.lit(10.0), F.col("event_id") * 1280)
    return e.select("event_id", F.round(main, 3).alias("main_lag"), F.round(F.col("value") * 1000, 3).alias("compute_ms"), F.round(C.state_lag_ms(main, F.col("at"), F.col("at") - F.col("value")), 3).alias("state_lag"))


@query("q_closed_groups", """
WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day, event_type FROM events),
g AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM t),
c AS (SELECT user_id, day, grp, bool_or(event_type = 'purchase') AS closed, string_agg(left(event_type, 1), '' ORDER BY us, event_id) FILTER (WHERE event_type <> 'purchase') AS word FROM g GROUP BY 1, 2, 3)
SELECT user_id, day, count(*) FILTER (WHERE closed) AS groups, coalesce(string_agg(coalesce(word, ''), ' ' ORDER BY grp) FILTER (WHERE closed), '') AS text FROM c GROUP BY 1, 2""")
def q_closed_groups(spark, sf_dir):
    """Groups of a user's day that a purchase closes, decoded (first letters) and joined; an open one is no text yet, so the text only grows."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").withColumn("day", F.floor(F.col("us") / DAY))
    end = F.col("event_type") == "purchase"
    before = S.by(["user_id", "day"], U[1]).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("grp", F.coalesce(F.count_if(end).over(before), F.lit(0)))
    letters = F.array_sort(F.collect_list(F.when(~end, F.struct("us", "event_id", F.left("event_type", F.lit(1)).alias("l")))))
    groups = e.groupBy("user_id", "day", "grp").agg(F.bool_or(end).alias("closed"), F.array_join(F.transform(letters, lambda x: x["l"]), "").alias("word"))
    words = F.array_sort(F.collect_list(F.when(F.col("closed"), F.struct("grp", "word"))))
    return groups.groupBy("user_id", "day").agg(F.count_if("closed").alias("groups"), F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"))


@query("q_timing_summary", f"""
WITH e AS (SELECT event_type, value * 1000 AS ms, row_number() OVER w AS step FROM events {W})
SELECT event_type, count(*) AS all_n, round(quantile_cont(ms, 0.5), 6) AS all_p50, round(quantile_cont(ms, 0.95), 6) AS all_p95, max(ms) AS all_max, count(*) FILTER (WHERE step > 1) AS stable_n,
  round(quantile_cont(ms, 0.5) FILTER (WHERE step > 1), 6) AS stable_p50, round(quantile_cont(ms, 0.95) FILTER (WHERE step > 1), 6) AS stable_p95, max(ms) FILTER (WHERE step > 1) AS stable_max FROM e GROUP BY 1""")
def q_timing_summary(spark, sf_dir):
    """Distribution of a stage's times, of all steps and of those after a user's first, by stage."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "value").withColumn("ms", F.col("value") * 1000).withColumn("step", F.row_number().over(S.by(*U)))
    named = lambda prefix, x: [c.alias(f"{prefix}_{n}") for c, n in zip(M.distribution(x), ("n", "p50", "p95", "max"))]
    return e.groupBy("event_type").agg(*named("all", F.col("ms")), *named("stable", F.when(F.col("step") > 1, F.col("ms"))))


@query("q_resume", """
WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(props, (ts, event_id)) AS p FROM events GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t, arg_max(props, (ts, event_id)) AS p FROM events WHERE event_id % 10 <> 0 GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN a.t <> b.t THEN 'type' END, CASE WHEN a.p <> b.p THEN 'props' END) AS changed FROM a JOIN b USING (user_id) WHERE a.t <> b.t OR a.p <> b.p""")
def q_resume(spark, sf_dir):
    """Saved states that a run must not resume from, as it differs in one of its identities."""
    e = events(spark, sf_dir, "user_id", "event_id", "event_type", "props")
    last = lambda df, n: S.latest(df, *U).select("user_id", F.col("event_type").alias(f"t{n}"), F.col("props").alias(f"p{n}"))
    both = last(e, 1).join(last(e.filter("event_id % 10 <> 0"), 2), "user_id")
    rules = F.array_compact(F.array(F.when(F.col("t1") != F.col("t2"), "type"), F.when(F.col("p1") != F.col("p2"), "props")))
    return both.select("user_id", F.array_join(rules, ",").alias("changed")).filter("changed <> ''")


@query("q_sample_digest")
def q_sample_digest(spark, sf_dir):
    """SHA-256 of each vector's samples as little-endian 32-bit floats. Spark has no function for the bytes of a float, so batches of vectors go through numpy."""
    @F.pandas_udf("string")
    def digest(v: pd.Series) -> pd.Series:
        return v.map(lambda x: hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest())

    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", digest("embedding").alias("digest"))
