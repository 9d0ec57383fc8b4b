"""Queues with one server: waiting times as a running maximum, and a bounded queue that refuses what it has no room for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators.scans import Running, scan
from riverbed.streaming.folds import Fold, fold_batch, fold_stream


def waits(jobs: DataFrame, keys: list[str], order: list[str], arrival: str, service: str, deadline: int, part_rows: int = 1_000_000) -> DataFrame:
    """jobs with start, finish, wait and missed (the wait is longer than deadline) of a queue of any length for each key, first come first served.

    A job starts when it has come and the one before it is done, which makes start = max(arrival, finish before): with S the service of all jobs so far, finish - S is the running
    maximum of arrival - S before. So two scans do, and no key is in one task.
    """
    summed = scan(jobs, keys, order, {"_s": Running("sum", F.col(service))}, part_rows)
    free = F.col(arrival) - (F.col("_s") - F.col(service))
    out = scan(summed, keys, order, {"_m": Running("max", free)}, part_rows)
    out = out.withColumn("start", F.col("_m") + F.col("_s") - F.col(service)).withColumns({"finish": F.col("_m") + F.col("_s"), "wait": F.col("start") - F.col(arrival)})
    return out.withColumn("missed", F.col("wait") > deadline).drop("_s", "_m")


class Bounded(Fold):
    """JOBS (key, arrival, id, service) in, first come first served; out come arrival, id, outcome and start. At most two jobs wait: a third is refused. One that could
    start only after its deadline is taken, and told as late."""

    keys, order, columns = ["key"], ["arrival", "id"], ["arrival", "id", "service"]
    state = "arrival long, id long, free long, first long, second long"
    output = "arrival long, id long, outcome string, start long"
    start = (-(1 << 62), -1, -(1 << 62), -(1 << 62), -(1 << 62))

    def __init__(self, deadline: int):
        self.deadline_ = deadline

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last_at, last_id, free, first, second = state
        at, i = int(row.arrival), int(row.id)
        if (at, i) <= (last_at, last_id):
            return state, []
        # the two accepted last wait while their starts lie ahead; no others can
        if first > at and second > at:
            return (at, i, free, first, second), [(at, i, "refused", None)]
        begins = max(at, free)
        return (at, i, begins + int(row.service), second, begins), [(at, i, "late" if begins - at > self.deadline_ else "taken", begins)]


def bounded_batch(jobs: DataFrame, deadline: int) -> DataFrame:
    return fold_batch(jobs, Bounded(deadline))


def bounded_stream(jobs: DataFrame, deadline: int) -> DataFrame:
    return fold_stream(jobs, Bounded(deadline))
