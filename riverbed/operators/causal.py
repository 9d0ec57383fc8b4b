"""Rules of a causally correct corpus: every one is a query whose rows break it.

events: source_id, branch_id, id, at_ms, kind, text. decisions: source_id, branch_id, id, module, read_ms, finish_ms, seen array<string>, scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source_id", "branch_id", "id"]


def _label(df: DataFrame, label: str) -> DataFrame:
    return df.select(*KEYS, F.lit(label).alias("label"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def seen_events(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each entry of seen, in its order (pos), with the event; e_* is null for an unknown id."""
    s = decisions.select(*KEYS, "module", "read_ms", "finish_ms", "scope", F.posexplode("seen").alias("pos", "event_id"))
    e = events.select("source_id", "branch_id", F.col("id").alias("event_id"), F.col("at_ms").alias("e_at_ms"), F.col("kind").alias("e_kind"), F.col("text").alias("e_text"))
    return s.join(e, ["source_id", "branch_id", "event_id"], "left")


def visibility(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """What a decision may read: known events up to read_ms, each once, never a script, one front-end row at least; a controller sees no analysis but in its own scope."""
    # an entry of its own (pos 0) stands for the decision, seen or not, so that one join and one count tell all of its labels
    s = seen_events(decisions.withColumn("seen", F.concat(F.array(F.lit(None).cast("string")), F.coalesce("seen", F.array().cast("array<string>")))), events)
    entry = F.col("pos") > 0
    rules = {
        "unknown_event": F.col("e_at_ms").isNull(), "future_event": F.col("e_at_ms") > F.col("read_ms"), "script_visible": F.col("e_kind") == "script",
        "analysis_visible": (F.col("module") == "controller") & (F.col("e_kind") == "analysis") & ~F.col("scope").eqNullSafe(F.lit("future_control")),
    }
    n = s.groupBy(*KEYS).agg(*[F.count_if(entry & c).alias(k) for k, c in rules.items()], F.count_if(~entry).alias("rows"), F.count_if(entry & (F.col("e_kind") == "frontend")).alias("front"))
    n = n.withColumn("no_frontend", F.when(F.col("front") == 0, F.col("rows")).otherwise(0))
    labels = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.col(k).cast("int")) for k in (*rules, "no_frontend")]))
    return _all([
        _label(decisions.filter(F.size(F.array_distinct("seen")) < F.size("seen")), "duplicate_seen"), _label(decisions.filter("finish_ms < read_ms"), "finished_before_read"),
        n.select(*KEYS, F.explode(labels).alias("label")),
    ])


def latest_frontend(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """As-of join: the latest front-end row that a decision has seen; a tie goes to the first in seen."""
    s = seen_events(decisions, events).filter("e_kind = 'frontend' and e_at_ms <= read_ms")
    return s.groupBy(*KEYS).agg(F.max_by(F.struct("event_id", "e_at_ms", "e_text"), F.struct("e_at_ms", (-F.col("pos")).alias("p"))).alias("f")).select(*KEYS, "f.*")
