"""Running values over few and large keys: the types of events, a fifth of all rows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverbed.catalog import query
from riverbed.operators.scans import Running, asof_scan, scan
from riverbed.sources.tables import events

#: Small, so that the keys span many parts at any size.
PART_ROWS = 20_000


@query("q_scan_types", """
WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS us, round(value * 100)::BIGINT AS cents FROM events)
SELECT event_id, event_type, sum(cents) OVER w::BIGINT AS spent, count(*) FILTER (WHERE cents > 5000) OVER w AS large, max(cents) OVER w AS most, min(cents) OVER w AS least, last_value(CASE WHEN user_id % 7 = 0 THEN user_id END IGNORE NULLS) OVER w AS last_seventh
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def q_scan_types(spark, sf_dir):
    """Sums, counts, extremes and last values so far of each type of event, no type in one task."""
    e = events(spark, sf_dir, "event_id", "event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    c = F.col("cents")
    out = scan(e, ["event_type"], ["us", "event_id"], {
        "spent": Running("sum", c), "large": Running("count", c > 5000), "most": Running("max", c), "least": Running("min", c), "last_seventh": Running("last", F.when(F.col("user_id") % 7 == 0, F.col("user_id"))),
    }, PART_ROWS)
    return out.drop("user_id", "us", "cents")


@query("q_scan_asof", """
WITH e AS (SELECT event_id, event_type, user_id % 2 AS half, epoch_us(ts) AS us FROM events)
SELECT event_id, half, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY half ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS before,
  first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY half ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM e""")
def q_scan_asof(spark, sf_dir):
    """The nearest purchase before and after each event among half of all users: two keys, each spread over all tasks."""
    e = events(spark, sf_dir, "event_id", "event_type", (F.col("user_id") % 2).alias("half"))
    bought = F.col("event_type") == "purchase"
    back = asof_scan(e, ["half"], ["us", "event_id"], F.col("event_id"), bought, "before", part_rows=PART_ROWS)
    return asof_scan(back, ["half"], ["us", "event_id"], F.col("event_id"), bought, "after", forward=True, part_rows=PART_ROWS).select("event_id", "half", "before", "after")
