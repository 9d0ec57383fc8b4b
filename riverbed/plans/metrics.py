"""Distributions, success metrics, gates and counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.functions.scalars import clamp_low
from riverbed.operators import metrics as M
from riverbed.operators.joins import asof
from riverbed.operators.quantiles import PART_ROWS, exact_quantiles
from riverbed.operators.sequence import by, dealt
from riverbed.sources.tables import events, table

DAY, HOUR = 86_400_000_000, 3_600_000_000
TYPES = ["click", "error", "purchase", "signup", "view"]


@query("q_turn_report", """
WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
v AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
m AS (SELECT v.event_id, v.us, min(c.us) AS hit FROM v LEFT JOIN c ON c.user_id = v.user_id AND c.us >= v.us AND c.us <= v.us + 43200000000 GROUP BY v.event_id, v.us)
SELECT us // 86400000000 AS day, count(*) AS n, sum(CASE WHEN hit IS NULL THEN 0 ELSE 1 END)::BIGINT AS successes,
  round(avg(CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 6) AS rate, count(hit) AS latency_n,
  ((2 * sum(greatest(hit - us, 0)) + count(hit)) // (2 * nullif(count(hit), 0)))::DOUBLE / 1e6 AS latency_mean
FROM m GROUP BY 1""")
def turn_report(spark, sf_dir):
    """For each view the first click of the user within 12 hours: success rate over all views, mean latency over successes, by day."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type").filter(F.col("event_type").isin("view", "click"))
    hit = asof(e, ["user_id"], ["us", "event_id"], F.col("us"), F.col("event_type") == "click", forward=True)
    v = e.withColumn("hit", hit).filter("event_type = 'view'")
    v = v.withColumn("hit", F.when(F.col("hit") <= F.col("us") + 12 * HOUR, F.col("hit")))
    latency = clamp_low((F.col("hit") - F.col("us")) / F.lit(1e6), 0.0)
    return v.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(*M.success_report(F.col("hit").isNotNull(), latency))


@query("q_distribution", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY 1")
def q_distribution(spark, sf_dir):
    """Of each type, by rank selection: a type has a fifth of all events, too many for one buffer."""
    return exact_quantiles(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("q_distribution_empty", "SELECT count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max FROM events WHERE value < 0")
def q_distribution_empty(spark, sf_dir):
    return table(spark, sf_dir, "events", "value").filter("value < 0").agg(*M.distribution("value"))


@query("q_gap_distribution", """
WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS gap FROM events)
SELECT user_id, count(gap) AS n, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.95), 3) AS p95, max(gap) AS max FROM g GROUP BY 1""")
def q_gap_distribution(spark, sf_dir):
    e = dealt(events(spark, sf_dir, "event_id", "user_id"), ["user_id"], table(spark, sf_dir, "events").count(), PART_ROWS)
    gap = (F.col("us") - F.lag("us").over(by(["user_id"], ["us", "event_id"]))).cast("double")
    return exact_quantiles(e.select("user_id", gap.alias("gap")), ["user_id"], "gap", {"p50": 0.5, "p95": 0.95}, 3, dealt=True)


@query("q_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("q_coverage_flags", "SELECT user_id, " + ", ".join(f"bool_or(event_type = '{t}') AS has_{t}" for t in TYPES) + ", bool_and(value > 0) AS all_positive FROM events GROUP BY 1")
def q_coverage_flags(spark, sf_dir):
    flags = [F.bool_or(F.col("event_type") == t).alias(f"has_{t}") for t in TYPES]
    return table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id").agg(*flags, F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("q_missing_labels", """
WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), t AS (SELECT DISTINCT event_type FROM events)
SELECT user_id, day, event_type AS missing FROM d CROSS JOIN t EXCEPT SELECT user_id, epoch_us(ts) // 86400000000, event_type FROM events""")
def q_missing_labels(spark, sf_dir):
    """Types that a user-day lacks: the complement within a fixed list, without building the plan of all combinations."""
    e = events(spark, sf_dir, "user_id", "event_type")
    seen = e.groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.collect_set("event_type").alias("seen"))
    return seen.select("user_id", "day", F.explode(F.array_except(F.array(*map(F.lit, TYPES)), F.col("seen"))).alias("missing"))


@query("q_gate_failures", """
WITH m AS (SELECT user_id, count(*) AS n, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1)
SELECT user_id, 'p95_high' AS failure FROM m WHERE p95 > 136 UNION ALL SELECT user_id, 'too_few' FROM m WHERE n < 60""")
def q_gate_failures(spark, sf_dir):
    m = table(spark, sf_dir, "events", "user_id", "value").groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("value", 0.95).alias("p95"))
    return M.gate(m, ["user_id"], {"p95_high": F.col("p95") > 136, "too_few": F.col("n") < 60})


SOURCES = [f"src{k}" for k in range(20)]


@query("q_pivot_counts", "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE source = '{s}') AS {s}" for s in SOURCES) + " FROM documents GROUP BY 1")
def q_pivot_counts(spark, sf_dir):
    return M.pivot_counts(table(spark, sf_dir, "documents", "lang", "source"), "lang", "source", SOURCES)


@query("q_first_encounter", """
SELECT event_type, json_extract_string(props, '$.k') AS k, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2""")
def q_first_encounter(spark, sf_dir):
    """The first event of each (type, k); min_by combines before the shuffle."""
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type", "k").agg(F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("q_drift", "SELECT user_id, round(arg_max(value, (epoch_us(ts), event_id)) - arg_min(value, (epoch_us(ts), event_id)), 6) AS drift FROM events GROUP BY 1")
def q_drift(spark, sf_dir):
    e = events(spark, sf_dir, "user_id", "event_id", "value")
    return e.groupBy("user_id").agg(F.round(M.drift("value", F.struct("us", "event_id")), 6).alias("drift"))


@query("q_prefix_budget", """
WITH r AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents)
SELECT doc_id, n_chars, least(n_chars, 100000 - s)::BIGINT AS taken FROM r WHERE s < 100000""")
def q_prefix_budget(spark, sf_dir):
    return M.budget_prefix(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", "n_chars", 100_000)


@query("q_peaks", "SELECT l_returnflag, max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY 1")
def q_peaks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return l.groupBy("l_returnflag").agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))


@query("q_topk_worst", """
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, max(gap) AS worst FROM g GROUP BY 1 ORDER BY worst DESC, user_id LIMIT 5""")
def q_topk_worst(spark, sf_dir):
    e = events(spark, sf_dir, "event_id", "user_id")
    gap = F.col("us") - F.lag("us").over(by(["user_id"], ["us", "event_id"]))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("worst")).orderBy(F.desc("worst"), "user_id").limit(5)


@query("q_lane_wait", """
WITH f AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_type AS lane, min(epoch_us(ts)) AS us FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3)
SELECT user_id, day, lane, max(us) OVER (PARTITION BY user_id, day) - us AS wait FROM f""")
def q_lane_wait(spark, sf_dir):
    """How long each lane of a user-day waits for the last one."""
    e = events(spark, sf_dir, "user_id", "event_type").filter(F.col("event_type").isin("view", "click"))
    first = e.groupBy("user_id", F.floor(F.col("us") / DAY).alias("day"), F.col("event_type").alias("lane")).agg(F.min("us").alias("us"))
    return first.select("user_id", "day", "lane", (F.max("us").over(Window.partitionBy("user_id", "day")) - F.col("us")).alias("wait"))


@query("q_distinct_bytes", "WITH d AS (SELECT DISTINCT lang, sha256(text) AS h, n_chars FROM documents) SELECT lang, sum(n_chars)::BIGINT AS chars, count(*) AS texts FROM d GROUP BY 1")
def q_distinct_bytes(spark, sf_dir):
    """Characters of each distinct text once."""
    d = table(spark, sf_dir, "documents", "lang", "text", "n_chars").select("lang", F.sha2("text", 256).alias("h"), "n_chars").distinct()
    return d.groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("texts"))


@query("q_acceptance", """
WITH r AS (SELECT CASE WHEN event_type NOT IN ('click', 'purchase', 'view', 'signup') THEN 'unknown_state' WHEN event_type = 'click' AND value < 10 THEN 'far_field'
  WHEN event_type = 'purchase' AND value < 20 THEN 'complete_without_speech' ELSE 'accepted' END AS reason FROM events)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def q_acceptance(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    reason = F.when(~t.isin("click", "purchase", "view", "signup"), "unknown_state").when((t == "click") & (v < 10), "far_field").when((t == "purchase") & (v < 20), "complete_without_speech").otherwise("accepted")
    return table(spark, sf_dir, "events", "event_type", "value").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("q_fd_conflict", "SELECT sha256(text) AS digest, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def q_fd_conflict(spark, sf_dir):
    """Texts that stand in several sources; only digests are shuffled."""
    d = table(spark, sf_dir, "documents", "text", "source").select(F.sha2("text", 256).alias("digest"), "source")
    return d.groupBy("digest").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).filter("sources > 1")


@query("q_distinct_supervision", "SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS distinct_n FROM events GROUP BY 1")
def q_distinct_supervision(spark, sf_dir):
    """Rows and distinct canonical supervision of each type."""
    from riverbed.functions.scalars import canonical_json

    e = table(spark, sf_dir, "events", "event_type", "props")
    signature = canonical_json(F.map_concat(F.create_map(F.lit("event_type"), F.col("event_type")), F.from_json("props", "map<string,string>")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(signature).alias("distinct_n"))


@query("q_report_rows", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, '| ' || event_id || ' | ' || replace(event_type || '|' || props, '|', '／') || ' |' AS line FROM events""")
def q_report_rows(spark, sf_dir):
    """The lines of a markdown table for each user, pipes replaced by their full-width form, in order of time; a line is a row, so no report is one string."""
    e = events(spark, sf_dir)
    line = F.concat(F.lit("| "), F.col("event_id").cast("string"), F.lit(" | "), F.replace(F.concat_ws("|", "event_type", "props"), F.lit("|"), F.lit("／")), F.lit(" |"))
    return e.select("user_id", F.row_number().over(by(["user_id"], ["us", "event_id"])).cast("long").alias("position"), line.alias("line"))
