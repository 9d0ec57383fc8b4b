"""A lane by itself: when its steps may run, what it delivers beyond the joint run, and whether its windows fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.operators.metrics import gate
from riverbed.operators.rules import broken
from riverbed.operators.scans import asof_scan
from riverbed.operators.sequence import by
from riverbed.sources.scratch import Tables

BATCH = 2560


def single_lane(packets: DataFrame, batch: int = BATCH, part_rows: int = 1_000_000) -> DataFrame:
    """run_id, step_id, begins, processed_until, ready_at of a lane that waits for no other: packets (run_id, end, at, eof), end being the samples so far.

    A step is ready with the first packet that ends at or beyond what it needs, and needs no samples ahead; the last step is ready with the end of the stream. A run
    whose end has not come has full steps only. Packets and steps are one sorted sequence of places, so no pairs are made.
    """
    # written once: they are read for the totals, the count, the ranges and the rows
    packets = Tables(packets.sparkSession).save(packets.select("run_id", "end", "at", "eof"))
    total = packets.groupBy("run_id").agg(F.max("end").alias("total"), F.bool_or("eof").alias("eof"), F.max(F.when(F.col("eof"), F.col("at"))).alias("ended"))
    n = F.when(F.col("eof"), F.ceil(F.col("total") / batch)).otherwise(F.floor(F.col("total") / batch)).cast("long")
    steps = total.filter(n > 0).select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("step_id"), "total", "ended")
    full = (F.col("step_id") + 1) * batch
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    places = steps.select("run_id", F.least(full, "total").alias("place"), F.lit(0).alias("kind"), "step_id", none("at", "double"), F.when(full > F.col("total"), F.col("ended")).alias("ended"))
    rows = places.unionByName(packets.select("run_id", F.col("end").alias("place"), F.lit(1).alias("kind"), none("step_id", "long"), "at", none("ended", "double")))
    # packets of no samples end where the one before them did: the earliest counts
    order = ["place", "kind", "at", "step_id"]
    met = asof_scan(rows, ["run_id"], order, F.col("at"), F.col("kind") == 1, "ready_at", forward=True, part_rows=part_rows).filter("kind = 0")
    return met.select("run_id", "step_id", (F.col("step_id") * batch).alias("begins"), F.col("place").alias("processed_until"), F.coalesce("ended", "ready_at").alias("ready_at"))


def surplus(lane: DataFrame, joint: DataFrame) -> DataFrame:
    """(run_id, step_id, label): steps (run_id, step_id, processed_until) that a lane delivers and the joint run lacks, and, as the lane alone must do at least as much, those that it lacks itself or where it is behind."""
    l, j = (df.select("run_id", "step_id", F.col("processed_until").alias(name)) for df, name in ((lane, "l"), (joint, "j")))
    both = l.join(j, ["run_id", "step_id"], "full_outer")
    return gate(both, ["run_id", "step_id"], {"only_in_lane": F.col("j").isNull(), "missing_in_lane": F.col("l").isNull(), "behind": F.col("l") < F.col("j")}).withColumnRenamed("failure", "label")


def digest(samples: Column) -> Column:
    """SHA-256 of samples as decimal numbers joined by commas."""
    return F.sha2(F.array_join(samples.cast("array<string>"), ",").cast("binary"), 256)


def window_violations(windows: DataFrame, size: int, hop: int) -> DataFrame:
    """(run_id, k, label) of windows (run_id, k, begin, end, samples array<int>, sha256, provenance (samples that their spans account for)) that do not make one stream.

    A window holds size samples, all accounted for, with the digest that was sent. It begins a hop after the one before: later is a gap, earlier an overlap. And it begins with the samples
    that the one before ended with, by the digests of that part, so a sample that changed between two windows is found without either's samples beside the other's.
    """
    shared = size - hop
    told = windows.select("run_id", "k", "begin", "end", "provenance", F.size("samples").alias("n"), (digest(F.col("samples")) == F.col("sha256")).alias("intact"), digest(F.slice("samples", 1, shared)).alias("head"), digest(F.slice("samples", hop + 1, shared)).alias("tail"))
    w = by(["run_id"], ["k"])
    told = told.withColumns({"begin_before": F.lag("begin").over(w), "tail_before": F.lag("tail").over(w)})
    return gate(told, ["run_id", "k"], {
        "size": broken((F.col("n") == size) & (F.col("end") - F.col("begin") == size)), "provenance": broken(F.col("provenance") == size), "digest": broken(F.col("intact")), "gap": F.col("begin") > F.col("begin_before") + hop,
        "overlap": F.col("begin") < F.col("begin_before") + hop, "changed": F.col("head") != F.col("tail_before"),
    }).withColumnRenamed("failure", "label")
