"""Segments of spoken text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sentence mark with the white space after it, or at the end of the text.
BOUNDARY = r"[.!?](?:\s+|$)"
_MARK = re.compile(BOUNDARY)
TRIMMED = r"^\s+|\s+$"


def cut(text: Column, limit: int, final: bool = True) -> Column:
    """Length of a text's first segment: through the first boundary and its white space if that is within limit; else a text over limit
    is cut after limit characters or before the last blank that allows; else the whole text if it is final, else null."""
    mark = F.regexp_instr(text, F.lit(BOUNDARY))
    end = mark - 1 + F.length(F.regexp_substr(text, F.lit(BOUNDARY)))
    blank = F.lit(limit + 1) - F.instr(F.reverse(F.substr(text, F.lit(1), F.lit(limit + 1))), " ")  # characters before the last blank
    has = F.contains(F.substr(text, F.lit(1), F.lit(limit + 1)), F.lit(" ")) & (blank > 0)
    whole = F.length(text) if final else F.lit(None)
    return F.when((mark > 0) & (end <= limit), end).when(F.length(text) > limit, F.when(has, blank).otherwise(F.lit(limit))).otherwise(whole).cast("int")


def first_segment(df: DataFrame, text: str, limit: int, final: bool = True) -> DataFrame:
    """Adds segment, without white space around it, and rest_length; without a segment: null and the whole text's length."""
    n = cut(F.col(text), limit, final)
    return df.withColumn("segment", F.regexp_replace(F.substr(F.col(text), F.lit(1), n), TRIMMED, "")).withColumn("rest_length", (F.length(text) - F.coalesce(n, F.lit(0))).cast("long"))


def segment_ends(text: str, limit: int, first: int, final: bool = True) -> list[int]:
    """Where cut() ends one segment after another; first is the limit until one that is not blank has come."""
    marks = [m.span() for m in _MARK.finditer(text)]
    begins = [b for b, _ in marks]
    ends, at, room = [], 0, first
    while at < len(text):
        k = bisect_left(begins, at)
        if k < len(marks) and marks[k][1] - at <= room:
            end = marks[k][1]
        elif len(text) - at > room:
            blank = text.rfind(" ", at, at + room + 1)
            end = blank if blank > at else at + room
        elif final:
            end = len(text)
        else:
            break
        if text[at:end].strip():
            room = limit
        ends.append(end)
        at = end
    return ends


#: Characters of segments that a worker holds before it passes them on.
HELD = 1 << 20


def segments(df: DataFrame, text: str, limit: int, first: int | None = None) -> DataFrame:
    """All segments that are not blank, in order (pos from 0). Each cut depends on the one before, so a small kernel runs along each text, over Arrow batches; it passes on segments by HELD characters,
    so that what Python holds grows with a text, not with a batch of them."""
    start = limit if first is None else first
    kept = [c for c in df.columns if c != text]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, texts = batch.select(kept), batch.column(text)
            found: list[tuple[int, int, str]] = []

            def out() -> pa.RecordBatch:
                rows, pos, parts = zip(*found) if found else ((), (), ())
                return pa.RecordBatch.from_arrays([*rest.take(pa.array(rows, pa.int64())).columns, pa.array(pos, pa.int32()), pa.array(parts, pa.string())], [*kept, "pos", "segment"])

            held = 0
            for k in range(batch.num_rows):
                t, at, pos = texts[k].as_py() or "", 0, 0
                for end in segment_ends(t, limit, start):
                    if s := t[at:end].strip():
                        found.append((k, pos, s))
                        pos, held = pos + 1, held + len(s)
                    at = end
                    if held >= HELD:
                        yield out()
                        found, held = [], 0
            yield out()

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("pos", T.IntegerType()), T.StructField("segment", T.StringType())])
    return df.select(*kept, text).mapInArrow(split, schema)


def messages(system: Column, asked: Column, answer: Column, uncertain: Column) -> Column:
    """Three messages of a training row: only the answer's loss counts, and not that of an uncertain one."""
    part = lambda role, content, weight: F.struct(F.lit(role).alias("role"), content.alias("content"), weight.cast("int").alias("loss_weight"))
    return F.array(part("system", system, F.lit(0)), part("user", asked, F.lit(0)), part("assistant", answer, F.when(F.coalesce(uncertain, F.lit(False)), 0).otherwise(1)))
