"""Queues, prefix hashes and pluggable decoders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.operators import decode, prefixes, queues
from riverbed.operators.audit import EOS
from riverbed.plans.scans import PART_ROWS
from riverbed.sources.tables import events, table

MINUTE, HOUR = 60_000_000, 3_600_000_000


@query("q_queue_waits", f"""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, event_id % 40 * {MINUTE} AS service FROM events), s AS (SELECT *, sum(service) OVER w AS s FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, max(us - (s - service)) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS m FROM s)
SELECT event_id, event_type, (m + s - service)::BIGINT AS start, (m + s)::BIGINT AS finish, (m + s - service - us)::BIGINT AS wait, m + s - service - us > {HOUR} AS missed FROM m""")
def q_queue_waits(spark, sf_dir):
    """Waiting times of events served one at a time for each type, and those beyond an hour; a type has a fifth of all rows and is spread over all tasks."""
    e = events(spark, sf_dir, "event_id", "event_type").withColumn("service", F.col("event_id") % 40 * MINUTE)
    out = queues.waits(e, ["event_type"], ["us", "event_id"], "us", "service", HOUR, PART_ROWS)
    return out.select("event_id", "event_type", "start", "finish", "wait", "missed")


@query("q_queue_bounded", f"""
WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS arrival, event_id AS id, event_id % 24 * {HOUR} AS service, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events),
r(key, p, arrival, id, free, a, b, outcome, start) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, -4611686018427387904, -4611686018427387904, -4611686018427387904, NULL::VARCHAR, NULL::BIGINT FROM e
  UNION ALL
  SELECT e.key, e.p, e.arrival, e.id, CASE WHEN a > e.arrival AND b > e.arrival THEN free ELSE greatest(e.arrival, free) + service END, CASE WHEN a > e.arrival AND b > e.arrival THEN a ELSE b END,
    CASE WHEN a > e.arrival AND b > e.arrival THEN b ELSE greatest(e.arrival, free) END, CASE WHEN a > e.arrival AND b > e.arrival THEN 'refused' WHEN greatest(e.arrival, free) - e.arrival > {12 * HOUR} THEN 'late' ELSE 'taken' END,
    CASE WHEN a > e.arrival AND b > e.arrival THEN NULL ELSE greatest(e.arrival, free) END FROM r JOIN e ON e.key = r.key AND e.p = r.p + 1)
SELECT key, arrival, id, outcome, start FROM r WHERE p > 0""")
def q_queue_bounded(spark, sf_dir):
    """What becomes of each event in its user's queue of two: taken, late, or refused."""
    e = events(spark, sf_dir, F.col("user_id").alias("key"), F.col("event_id").alias("id")).select("key", F.col("us").alias("arrival"), "id", (F.col("id") % 24 * HOUR).alias("service"))
    return queues.bounded_batch(e, 12 * HOUR)


_HASH = "list_reduce([0::BIGINT] || list_reverse(list_transform(string_split(so_far, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * {base} + c) % {prime})"


@query("q_prefix_hashes", f"""
WITH k AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations)
SELECT conv_id, turn, length(so_far)::BIGINT AS chars, {_HASH.format(base=prefixes.BASES[0], prime=prefixes.PRIMES[0])} AS a, {_HASH.format(base=prefixes.BASES[1], prime=prefixes.PRIMES[1])} AS b FROM k""")
def q_prefix_hashes(spark, sf_dir):
    """Length and hash of the text so far at each turn, from the turns alone."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    delta = F.concat(F.when(F.col("turn") > 0, " ").otherwise(""), F.col("text"))
    return prefixes.prefix_hashes(c, ["conv_id"], ["turn"], delta, PART_ROWS).drop("text")


def emits(spark, sf_dir):
    """Tokens of each event; some have no end, a control token before it, nothing, or too many."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    i, kind = F.col("event_id"), F.col("event_type")
    plain = F.array(300 + i % 50, 400 + i % 7)
    body = F.when((kind == "signup") & (i % 3 == 0), F.array(300 + i % 50, F.lit(32).cast("long"))).when((kind == "view") & (i % 11 == 0), F.array().cast("array<bigint>")).when((kind == "click") & (i % 13 == 0), F.array_repeat(F.lit(500).cast("long"), 64)).otherwise(plain)
    tokens = F.concat(body, F.when((kind == "error") & (i % 2 == 0), F.array().cast("array<bigint>")).otherwise(F.array(F.lit(EOS).cast("long"))))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    return e.select(F.col("user_id").cast("string").alias("key"), seq.alias("seq"), tokens.cast("array<int>").alias("tokens"))


@query("q_closed_groups_decoded", f"""
WITH e AS (SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS seq, event_id AS i, event_type AS k FROM events),
f AS (SELECT *, CASE WHEN k = 'signup' AND i % 3 = 0 THEN 'control_token' WHEN k = 'view' AND i % 11 = 0 THEN 'empty' WHEN k = 'click' AND i % 13 = 0 THEN 'too_long' WHEN k = 'error' AND i % 2 = 0 THEN 'no_eos' END AS failure FROM e),
d AS (SELECT 'numbers' AS decoder, *, CASE WHEN failure IS NULL THEN (300 + i % 50) || ' ' || (400 + i % 7) END AS part FROM f UNION ALL SELECT 'letters', *, CASE WHEN failure IS NULL THEN chr((97 + (300 + i % 50) % 26)::INTEGER) || chr((97 + (400 + i % 7) % 26)::INTEGER) END FROM f),
p AS (SELECT *, CASE WHEN part IS NOT NULL THEN count(part) OVER w - 1 END AS pos FROM d WINDOW w AS (PARTITION BY decoder, key ORDER BY seq ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN part IS NOT NULL THEN CASE WHEN pos > 0 THEN ' ' ELSE '' END || part END AS delta FROM p)
SELECT decoder, key, seq, pos, delta, coalesce(sum(length(delta)) OVER (PARTITION BY decoder, key ORDER BY seq ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS chars, failure FROM q""")
def q_closed_groups_decoded(spark, sf_dir):
    """The text that users' tokens add up to, by two decoders and the same operator."""
    e = emits(spark, sf_dir)
    parts = [decode.closed_groups(e, name).withColumn("decoder", F.lit(name)) for name in ("numbers", "letters")]
    return parts[0].unionByName(parts[1])
