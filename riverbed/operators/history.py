"""Replies that are played, cancelled and repaired, and the history they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def played(ledger: DataFrame, segments: DataFrame) -> DataFrame:
    """How much of each request was heard: ledger (request_id, start_sample, samples), segments (request_id, pos, text, samples).

    committed_text joins the segments that were played in full, committed is their samples, tail what was played beyond them.
    """
    heard = ledger.groupBy("request_id").agg(F.sum("samples").alias("played"))
    w = Window.partitionBy("request_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = segments.withColumn("until", F.sum("samples").over(w)).join(heard, "request_id", "left").withColumn("played", F.coalesce("played", F.lit(0)))
    full = F.col("until") <= F.col("played")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(full, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    out = s.groupBy("request_id", "played").agg(text.alias("committed_text"), F.coalesce(F.max(F.when(full, F.col("until"))), F.lit(0)).alias("committed"))
    return out.withColumn("tail", F.col("played") - F.col("committed"))


def history(turns: DataFrame) -> DataFrame:
    """What a model sees after cancellations: turns (conv_id, turn, role, text, cancelled, played_samples).

    A cancelled reply that nobody heard goes; one that was heard keeps all its text. Blank turns go. Then consecutive turns of a role are
    one, in order: conv_id, run, role, n, text.
    """
    from riverbed.operators.sequence import merge_runs

    unheard = F.coalesce(F.col("cancelled"), F.lit(False)) & (F.coalesce(F.col("played_samples"), F.lit(0)) == 0)
    return merge_runs(turns.filter(~unheard & F.col("text").rlike(r"\S")), ["conv_id"], "turn", "role", "text")


def repair(current: DataFrame, repairs: DataFrame, key: str = "request_id") -> DataFrame:
    """Texts replaced by late repairs (key, version, text) where the version is still that of current; of several the last by text order wins."""
    r = repairs.groupBy(key, "version").agg(F.max("text").alias("_text"))
    return current.join(r, [key, "version"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text").select(current.columns)


def resource_stops(samples: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(condition, resource, peak, stop) of peaks beyond their limits; a peak at the limit passes."""
    peaks = samples.groupBy("condition").agg(*[F.max(c).alias(c) for c in limits])
    long = peaks.select("condition", F.explode(F.array(*[F.struct(F.lit(c).alias("resource"), F.col(c).cast("long").alias("peak"), F.lit(v).cast("long").alias("stop")) for c, v in limits.items()])).alias("x"))
    return long.select("condition", "x.*").filter("peak > stop")
