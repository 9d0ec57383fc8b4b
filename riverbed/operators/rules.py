"""More rules over ordered rows, and small folds that a window expresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.metrics import gate
from riverbed.operators.sequence import by, running_count, so_far

# Samples of a step, of the context on each side, and what is read ahead.
HOP, SIDE, BATCH, AHEAD = 1280, 200, 2560, 2760
RATE = 16_000


def broken(c: Column) -> Column:
    """A comparison with a missing value counts as broken."""
    return F.coalesce(~c, F.lit(True))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def strict_number(token: Column) -> dict[str, Column]:
    """What a JSON token is: an integer (no boolean), a finite number, one from 0 on."""
    x = F.when(token.rlike(r"\A-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"), token.try_cast("double"))
    return {"is_integer": F.coalesce(token.rlike(r"\A-?[0-9]+\z"), F.lit(False)), "is_finite": F.coalesce(finite(x), F.lit(False)), "is_natural": F.coalesce(finite(x) & (x >= 0), F.lit(False))}


def full_match(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def cursor_violations(df: DataFrame, keys: list[str], order: list[str], steady: list[str], rising: list[str]) -> DataFrame:
    """(keys, order, failure): cursors of steady must not fall, those of rising must rise."""
    w = by(keys, order)
    told = df.withColumns({f"_{c}": F.lag(c).over(w) for c in [*steady, *rising]})
    rules = {f"{c}_fell": F.col(c) < F.col(f"_{c}") for c in steady} | {f"{c}_did_not_rise": F.col(c) <= F.col(f"_{c}") for c in rising}
    return gate(told, [*keys, *order], rules)


def ledger_violations(df: DataFrame, keys: list[str], order: list[str], most: int = 320, rate: int = RATE) -> DataFrame:
    """(keys, order, failure) of played frames (start_sample, samples, time): they follow each other, hold 1 to most samples, and start at time, rounded half to even."""
    end = F.lag(F.col("start_sample") + F.col("samples")).over(by(keys, order))
    told = df.withColumn("_end", F.coalesce(end, F.lit(0)))
    rules = {
        "overlap": broken(F.col("start_sample") >= F.col("_end")),
        "frame_size": broken((F.col("samples") > 0) & (F.col("samples") <= most)),
        "frame_time": broken(finite(F.col("time")) & (F.bround(F.col("time") * rate, 0).cast("long") == F.col("start_sample"))),
    }
    return gate(told, [*keys, *order], rules)


def word_time_violations(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """(keys, order, failure) of word times: finite, 0 <= start <= end, starts that never fall."""
    told = df.withColumn("_before", F.lag(start).over(by(keys, order)))
    s, e = F.col(start), F.col(end)
    return gate(told, [*keys, *order], {"not_finite": ~(finite(s) & finite(e)), "negative": s < 0, "ends_before_start": e < s, "start_fell": s < F.col("_before")})


def generation_violations(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, failure) of a reset counter (generation_before, generation_after): it goes on from the row before, and by one at most."""
    before = F.lag("generation_after").over(by(keys, order))
    step = F.col("generation_after") - F.col("generation_before")
    return gate(df.withColumn("_before", before), [*keys, *order], {"not_continued": F.col("generation_before") != F.col("_before"), "bad_step": broken((step == 0) | (step == 1))})


def context_windows(total: Column) -> Column:
    """Windows of a stream of total samples, one for each hop, with a context on both sides: frame, begin, stop, left_padding, right_padding; begin and stop stay in the stream."""
    window = lambda i: F.struct(
        i.alias("frame"), F.greatest(i * HOP - SIDE, F.lit(0).cast("long")).alias("begin"), F.least((i + 1) * HOP + SIDE, total).alias("stop"),
        F.greatest(SIDE - i * HOP, F.lit(0).cast("long")).alias("left_padding"), F.greatest((i + 1) * HOP + SIDE - total, F.lit(0).cast("long")).alias("right_padding"),
    )
    last = F.floor((total + (HOP - 1)) / HOP).cast("long") - 1
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), window)).otherwise(F.array().cast("array<struct<frame:bigint,begin:bigint,stop:bigint,left_padding:bigint,right_padding:bigint>>"))


def reset_cursor(df: DataFrame, keys: list[str], order: list[str], reset: Column, first: int = 1920, batch: int = BATCH) -> DataFrame:
    """Adds generation (resets so far), advance (first after a reset, and at the start, else batch) and processed (their sum so far)."""
    w = by(keys, order)
    advance = F.when(reset | (F.row_number().over(w) == 1), first).otherwise(batch)
    told = df.withColumn("generation", running_count(reset, w)).withColumn("advance", advance.cast("long"))
    return told.withColumn("processed", F.sum("advance").over(so_far(w)))


def batch_readiness(total: Column) -> Column:
    """Batches of a stream: batch, start, frames (hops of it, two but at the end), needed (samples that must have come, all of them at the end), flush (whether only the end of the stream releases it)."""
    last = F.floor((total + (BATCH - 1)) / BATCH).cast("long") - 1
    one = lambda i: F.struct(
        i.alias("batch"), (i * BATCH).alias("start"), F.least(F.lit(2).cast("long"), F.floor((total - i * BATCH + (HOP - 1)) / HOP).cast("long")).alias("frames"),
        F.least(i * BATCH + AHEAD, total).alias("needed"), (i * BATCH + AHEAD > total).alias("flush"),
    )
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), one)).otherwise(F.array().cast("array<struct<batch:bigint,start:bigint,frames:bigint,needed:bigint,flush:boolean>>"))


def receipt_violations(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, failure) of receipts (lane, epoch, current_epoch, completed_at, ready_at): of the current epoch, not early, one of each lane and step."""
    first = F.row_number().over(by([*keys, "step", "lane"], order)) == 1
    told = df.withColumn("_first", first)
    return gate(told, [*keys, *order], {"stale": F.col("epoch") != F.col("current_epoch"), "early": F.col("completed_at") < F.col("ready_at"), "duplicate": ~F.col("_first")})


def key_lifecycle(df: DataFrame, keys: list[str], order: list[str], action: str, most: int, scope: list[str]) -> DataFrame:
    """(scope, order, failure): a key opens once, closes while open, is released once closed; at most `most` keys of a scope are held at a time."""
    w = by([*scope, *keys], order)
    before = F.lag(action).over(w)
    a = F.col(action)
    held = F.sum(F.when(a == "open", 1).when(a == "release", -1).otherwise(0)).over(so_far(by(scope, order)))
    told = df.withColumn("_before", before).withColumn("_held", held)
    b = F.col("_before")
    rules = {"opened_twice": (a == "open") & b.isNotNull(), "closed_unopened": (a == "close") & ~b.eqNullSafe(F.lit("open")), "released_unclosed": (a == "release") & ~b.eqNullSafe(F.lit("close")), "too_many": (a == "open") & (F.col("_held") > most)}
    return gate(told, [*scope, *order], rules)


def capacity_violations(df: DataFrame, keys: list[str], order: list[str], amount: str, most: int) -> DataFrame:
    """Rows whose request, checked before anything is allocated, would take what is held (the sum of amounts so far; negative ones free) beyond most: adds held."""
    held = F.coalesce(F.sum(amount).over(by(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("held", held).filter((F.col(amount) > 0) & (F.col("held") + F.col(amount) > most))


def evict(df: DataFrame, cursors: DataFrame, keys: list[str], stop: str) -> DataFrame:
    """Rows that a consumer may still read: those that do not stop at or before the smallest cursor (keys, cursor) of their key; without one, all."""
    least = cursors.groupBy(*keys).agg(F.min("cursor").alias("_cursor"))
    return df.join(least, keys, "left").filter(F.col("_cursor").isNull() | (F.col(stop) > F.col("_cursor"))).drop("_cursor")


def consume_states(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a consumer does at each published state (accepted, token, text, which only grows): adds action and delta.

    An accepted complete state with new text starts a reply with that text and uses it up; an accepted nonidle one cancels; all others, and a
    complete one without new text, do nothing. Text used up is that of the complete state before: where that had nothing new, it was white space, which is trimmed.
    """
    w = by(keys, order)
    complete = F.col("accepted") & (F.col("token") == "user_complete")
    used = F.coalesce(F.max(F.when(complete, F.length("text"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    delta = F.regexp_replace(F.substr(F.col("text"), used + 1), r"^\s+|\s+$", "")
    told = df.withColumn("delta", F.when(complete, delta))
    action = F.when(complete & (F.col("delta") != ""), "start").when(complete, "complete_without_new_text").when(F.col("accepted") & (F.col("token") == "user_nonidle"), "cancel").otherwise("none")
    return told.withColumn("action", action)


def consume_deltas(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """consume_states for states that bring what is new (delta) instead of the text so far: adds action, and delta is what a complete state starts with.

    What came since the complete state before is put together once, so the work grows with the text, not with its square.
    """
    w = by(keys, order)
    complete = F.col("accepted") & (F.col("token") == "user_complete")
    part = F.coalesce(F.count_if(complete).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = df.withColumn("_part", part).withColumn("_complete", complete)
    new = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("delta").alias("_d")))), lambda x: x["_d"]), "")
    ends = F.max(F.when(F.col("_complete"), F.struct(*order)))
    groups = told.groupBy(*keys, "_part").agg(ends.alias("_o"), F.regexp_replace(new, r"^\s+|\s+$", "").alias("_new")).filter("_o is not null").select(*keys, "_o.*", "_new")
    told = told.drop("delta").join(groups, [*keys, *order], "left").withColumn("delta", F.when(F.col("_complete"), F.col("_new")))
    action = F.when(F.col("_complete") & (F.col("delta") != ""), "start").when(F.col("_complete"), "complete_without_new_text").when(F.col("accepted") & (F.col("token") == "user_nonidle"), "cancel").otherwise("none")
    return told.withColumn("action", action).drop("_part", "_complete", "_new")


def start_replies(df: DataFrame, keys: list[str], order: list[str], tag: str = "t", seed: int = 0) -> DataFrame:
    """What happens to each command (kind start, with text, or end): adds outcome, request_id and seed.

    A blank start is ignored; one while a reply is active is a duplicate; others start reply number n of their key, named tag-rn, with seed + n - 1. Any
    start that is not blank leaves a reply active, and an end none, so the last such row tells.
    """
    w = by(keys, order)
    asks = (F.col("kind") == "start") & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    sets = F.when(asks, True).when(F.col("kind") == "end", False)
    busy = F.coalesce(F.last(sets, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    told = df.withColumn("_busy", busy).withColumn("outcome", F.when(F.col("kind") == "end", F.when(F.col("_busy"), "ended").otherwise("nothing_active")).when(~asks, "blank_ignored").when(F.col("_busy"), "duplicate_start_ignored").otherwise("started"))
    n = running_count(F.col("outcome") == "started", w)
    started = F.col("outcome") == "started"
    return told.withColumn("request_id", F.when(started, F.concat(F.lit(f"{tag}-r"), n.cast("string")))).withColumn("seed", F.when(started, n + (seed - 1))).drop("_busy")


def final_entries(df: DataFrame) -> DataFrame:
    """History entries of finished replies (text, repair_pending): those with text, and empty ones while a repair is to come."""
    return df.filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) | F.coalesce(F.col("repair_pending"), F.lit(False)))


def concat_spans(df: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Spans of inputs put one after another: adds start and stop."""
    stop = F.sum(size).over(so_far(by(keys, order)))
    return df.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(size))


def real_end(real: Column, stop: Column, default: Column) -> Column:
    """An aggregate: the largest stop of real spans, else the default."""
    return F.coalesce(F.max(F.when(real, stop)), default)


def running_union(value: Column, keys: list[str], order: list[str]) -> Column:
    """The distinct values so far, in order; for values of a small fixed set."""
    return F.sort_array(F.collect_set(value).over(so_far(by(keys, order))))
