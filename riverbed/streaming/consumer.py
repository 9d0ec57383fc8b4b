"""The exactly-once delta consumer: a fold over each key's steps, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, action string"
STATE = "last_us long, last_id long, busy boolean, pending int"


def advance(state: tuple[int, int, bool, int], us: int, event_id: int, kind: str) -> tuple[tuple[int, int, bool, int], str]:
    """One step. A view adds a delta; a purchase that finds a delta and nothing running starts and uses up the deltas; an error or a click cancels what runs; steps that are not later than the last are duplicates."""
    last_us, last_id, busy, pending = state
    if (us, event_id) <= (last_us, last_id):
        return state, "duplicate"
    if kind == "view":
        return (us, event_id, busy, pending + 1), "delta"
    if kind == "purchase":
        if busy:
            return (us, event_id, busy, pending), "busy"
        return (us, event_id, pending > 0, 0), "start" if pending else "empty"
    if kind in ("error", "click"):
        return (us, event_id, False, pending), "cancel" if busy else "idle"
    return (us, event_id, busy, pending), "ignored"


START = (-(1 << 62), -1, False, 0)


def _fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    actions = []
    for us, event_id, kind in zip(rows["us"], rows["event_id"], rows["event_type"]):
        state, action = advance(state, int(us), int(event_id), kind)
        actions.append(action)
    return state, rows.assign(action=actions)[["user_id", "event_id", "action"]]


def consume(events: DataFrame) -> DataFrame:
    """user_id, event_id, action for every event (us, event_id, user_id, event_type).

    State runs along a user's sorted rows within their partition, so no user's rows are gathered in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, START
        for batch in batches:
            for who, rows in batch.groupby("user_id", sort=False):
                if who != user:
                    user, state = who, START
                state, out = _fold(state, rows)
                yield out

    rows = events.select("user_id", "us", "event_id", "event_type").repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return rows.mapInPandas(run, OUTPUT)


def consume_stream(events: DataFrame) -> DataFrame:
    """The same decisions over a stream whose micro-batches bring a user's events in order; late and repeated ones count as duplicates."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        now, out = _fold(now, rows)
        state.update((int(now[0]), int(now[1]), bool(now[2]), int(now[3])))
        yield out

    return events.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and type; a window is final once the watermark has passed it."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def barrier_stream(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Pairs of two lanes on their keys within the bound of lateness; state older than that is let go."""
    l = left.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    r = right.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(ts).alias("r_ts"))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    near = (F.col("r_ts") >= F.col(ts) - F.expr(f"interval {late}")) & (F.col("r_ts") <= F.col(ts) + F.expr(f"interval {late}"))
    return l.join(r, [*same, near], "inner").select(*keys, F.col(ts).alias("left_ts"), F.col("r_ts").alias("right_ts"))


def once(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the bound of lateness."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
