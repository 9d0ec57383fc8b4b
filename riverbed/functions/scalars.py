"""Scalar building blocks over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
HOP, LOOKAHEAD, BATCH = 1280, 200, 2560


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def ceil_div(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by).cast("long")


def clamp_low(x: Column, low: float) -> Column:
    """At least low, null staying null (greatest() alone skips nulls)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def close_to(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Within a tolerance; two nulls are close, a null and a value are not."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def pcm16(x: Column) -> Column:
    """A sample clipped to [-1, 1], scaled and truncated toward zero."""
    return (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int")


def rms(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples)))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def canonical_json(entries: Column) -> Column:
    """Compact JSON of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def frame_windows(total: Column) -> Column:
    """Frames of a stream of total samples: index, start, end, observed_until, padding; the last one is padded at the end of the stream."""
    frame = lambda i: F.struct(
        i.alias("frame"), (i * HOP).alias("start"), F.least((i + 1) * HOP, total).alias("frame_end"),
        F.least((i + 1) * HOP + LOOKAHEAD, total).alias("observed"), F.greatest(F.lit(0).cast("long"), (i + 1) * HOP + LOOKAHEAD - total).alias("padding"),
    )
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), ceil_div(total, HOP) - 1), frame)).otherwise(F.array().cast("array<struct<frame:bigint,start:bigint,frame_end:bigint,observed:bigint,padding:bigint>>"))


def turn_score(starts: Column, ends: Column, origin: Column, short: float = 1.0, few: int = 3) -> Column:
    """(took_turn, latency) of a list of word times: no turn without words, or with few words that last under short seconds in all.

    latency is from origin to the first word, 0 if that comes earlier, and null without a turn.
    """
    n = F.size(starts)
    took = (n > 0) & ~((n <= few) & (F.element_at(ends, -1) - F.element_at(starts, 1) < short))
    return F.struct(took.cast("int").alias("took_turn"), F.when(took, clamp_low(F.element_at(starts, 1) - origin, 0.0)).alias("latency"))


def gain(samples: Column, level: float = 0.05, ceiling: float = 0.9) -> Column:
    """The factor that brings samples to a level (root mean square) without passing a ceiling (peak); 1 for silence, null without samples."""
    r = rms(samples)
    return F.when(r == 0, 1.0).otherwise(F.least(level / r, ceiling / peak(samples)))


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def utc_text(micros_since_1970: Column) -> Column:
    """Date and time in UTC, as 2024-01-31 12:00:00 UTC; the session's time zone does not matter."""
    day, second = F.floor(micros_since_1970 / 86_400_000_000), F.pmod(F.floor(micros_since_1970 / 1_000_000), F.lit(86_400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    date = F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")
    return F.concat(date, F.lit(" "), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second % 3600 / 60)), F.lit(":"), two(second % 60), F.lit(" UTC"))


def turn_origin(task: Column, times: Column) -> Column:
    """Where a score counts from: the first time of a turn-taking task, the second of an interruption, none of a pause."""
    return F.when(task == "smooth_turn_taking", F.get(times, F.lit(0))).when(task == "user_interruption", F.get(times, F.lit(1)))


def raw_latency(first: Column, origin: Column) -> Column:
    """From origin to the first word, whether or not the turn counts; may be negative."""
    return first - origin


def lag_ms(released: Column, started: Column, processed: Column, rate: int = SAMPLE_RATE) -> Column:
    """Milliseconds between the time that samples up to processed take and their release."""
    return (released - started - processed / rate) * 1000


def state_lag_ms(main_lag: Column, released: Column, available: Column) -> Column:
    """A main lag less the time that a state was available before its release."""
    return main_lag - (released - available) * 1000


def crop_frames(frames: Column, rate: Column, input_rate: Column) -> Column:
    """How many frames at one rate last as long as frames at another, halves to even."""
    return half_even(frames * rate / input_rate)
