"""Decoders that callers plug in: closed groups of tokens become text by whichever decoder and joiner is named."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.operators.audit import CONTROL, EOS
from riverbed.streaming.folds import Fold, fold_batch

#: A decoder turns an Arrow array of lists of ids into one of texts; executors run it on whole batches.
Decoder = Callable[[pa.Array], pa.Array]
#: A joiner gets the end of the text so far and a new part; it gives how many characters of the end go, and what comes.
Joiner = Callable[[str, str], tuple[int, str]]

DECODERS: dict[str, Decoder] = {}
JOINERS: dict[str, Joiner] = {"blank": lambda end, part: (0, (" " if end and part else "") + part), "none": lambda end, part: (0, part)}
#: Longest group of tokens, its end among them, and the characters of the text so far that a joiner sees.
MOST_TOKENS, TAIL = 64, 64


def decoder(name: str) -> Callable[[Decoder], Decoder]:
    """Registers a decoder."""

    def add(f: Decoder) -> Decoder:
        DECODERS[name] = f
        return f

    return add


@decoder("numbers")
def numbers(ids: pa.Array) -> pa.Array:
    """Ids as decimal numbers."""
    return pa.array([None if x is None else " ".join(map(str, x)) for x in ids.to_pylist()], pa.string())


@decoder("letters")
def letters(ids: pa.Array) -> pa.Array:
    """Each id as a letter, by its place in the alphabet, round and round."""
    return pa.array([None if x is None else "".join(chr(97 + i % 26) for i in x) for x in ids.to_pylist()], pa.string())


def decoded(ids: Column, name: str) -> Column:
    """Texts of lists of ids by the decoder of that name, batch by batch."""
    run = DECODERS[name]
    return F.arrow_udf(lambda column: run(column), "string")(ids)


def eos_bounded(tokens: Column) -> Column:
    """ids (up to the end token, without it) and failure: no_eos if there is none (it is never invented), control_token if one stands before it, too_long beyond MOST_TOKENS, empty."""
    at = F.array_position(tokens, EOS)
    ids = F.when(at > 0, F.slice(tokens, 1, F.greatest(at - 1, F.lit(0)).cast("int")))
    failure = F.when((at > MOST_TOKENS) | ((at == 0) & (F.size(tokens) >= MOST_TOKENS)), "too_long").when(at == 0, "no_eos").when(F.exists(ids, lambda t: t.isin([c for c in CONTROL if c != EOS])), "control_token").when(at == 1, "empty")
    return F.struct(F.when(failure.isNull(), ids).alias("ids"), failure.alias("failure"))


def register(spark: SparkSession) -> None:
    """The decoders in SQL: SELECT * FROM decode_groups(ids, 'letters'), a table function whose columns are fixed whatever the decoder."""
    table = dict(DECODERS)

    @F.udtf(returnType="decoder string, n int, text string")
    class DecodeGroups:
        def eval(self, ids, name):
            if name not in table:
                raise ValueError(f"no decoder is named {name}")
            yield name, len(ids or []), table[name](pa.array([ids], pa.list_(pa.int64())))[0].as_py()

    spark.udtf.register("decode_groups", DecodeGroups)


class Joined(Fold):
    """Closed groups (key, seq, part, failure) in; out come seq, pos, delta, chars (so far) and failure: what each group adds to the text, or rewrote if a joiner
    takes characters back, which leaves the text as it was. Of the text only its end is held."""

    keys, order, columns = ["key"], ["seq"], ["seq", "part", "failure"]
    state = "seq long, pos long, chars long, tail string"
    output = "seq long, pos long, delta string, chars long, failure string"
    start = (-1, 0, 0, "")

    def __init__(self, joiner: Joiner):
        self.joiner = joiner

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last, pos, chars, tail = state
        seq = int(row.seq)
        if seq <= last:
            return state, []
        if row.failure:
            return (seq, pos, chars, tail), [(seq, None, None, chars, row.failure)]
        back, delta = self.joiner(tail, (row.part or "").strip())
        if back:
            return (seq, pos, chars, tail), [(seq, None, None, chars, "rewrote")]
        chars += len(delta)
        return (seq, pos + 1, chars, (tail + delta)[-TAIL:]), [(seq, pos, delta, chars, None)]


def closed_groups(emits: DataFrame, decode: str, joiner: str = "blank") -> DataFrame:
    """key, seq, pos, delta, chars, failure: the text that emitted tokens (key, seq, tokens array<int>) add up to, group by group, by any registered decoder and joiner."""
    checked = emits.withColumn("g", eos_bounded(F.col("tokens")))
    parts = checked.select("key", "seq", decoded(F.col("g.ids").cast("array<bigint>"), decode).alias("part"), F.col("g.failure").alias("failure"))
    return fold_batch(parts, Joined(JOINERS[joiner]))
