"""Samples as they arrive: when batches of them are ready, and what of them is held until all consumers have passed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from riverbed.streaming.folds import Fold, fold_batch, fold_stream

#: One packet a row: samples that came at a time, seq their order, eof with the last one.
PACKETS = "run_id long, seq long, at double, samples long, eof boolean"
#: One call a row: append (samples) or advance (a consumer, by samples).
CALLS = "run_id long, seq long, kind string, consumer string, samples long"


class Readiness(Fold):
    """PACKETS in; out come step, begins, processed_until and ready_at of each batch as soon as its samples, and those that it looks ahead, have come. The end of a stream releases what is left. After the
    end nothing more is taken: such packets are told with a step of -1."""

    keys, order, columns = ["run_id"], ["seq"], ["seq", "at", "samples", "eof"]
    state = "seq long, end long, step long, ended boolean"
    output = "step_id long, begins long, processed_until long, ready_at double"
    start = (-1, 0, 0, False)

    def __init__(self, batch: int = 2560, ahead: int = 640):
        self.batch, self.ahead = batch, ahead

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last, end, step, ended = state
        seq = int(row.seq)
        if seq <= last:
            return state, []
        if ended:
            return (seq, end, step, True), [(-1, end, end, float(row.at))]
        end, ended, out = end + int(row.samples), bool(row.eof), []
        while (step + 1) * self.batch + self.ahead <= end or ended and step * self.batch < end:
            out.append((step, step * self.batch, min((step + 1) * self.batch, end), float(row.at)))
            step += 1
        return (seq, end, step, ended), out


class Ledger(Fold):
    """CALLS in; out come seq, action, start, stop and held. A packet that would take what is held beyond the most is refused before it is stored; a stored one is evicted once the slowest
    consumer has passed its end. A consumer passes no more than has come. So the state holds no more than `most` samples' packets."""

    keys, order, columns = ["run_id"], ["seq"], ["seq", "kind", "consumer", "samples"]
    state = "seq long, end long, cursors string, kept string"
    output = "seq long, action string, start long, stop long, held long"

    def __init__(self, consumers: tuple[str, ...], most: int):
        self.most = most
        self.start = (-1, 0, json.dumps(dict.fromkeys(consumers, 0)), "[]")

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last, end, cursors, kept = state
        seq, samples = int(row.seq), int(row.samples)
        if seq <= last:
            return state, []
        at, packets = json.loads(cursors), json.loads(kept)
        held = sum(b - a for a, b in packets)
        if row.kind == "append":
            place = (end, end + samples)
            if held + samples > self.most:
                return (seq, end, cursors, kept), [(seq, "refused", *place, held)]
            return (seq, place[1], cursors, json.dumps([*packets, place])), [(seq, "stored", *place, held + samples)]
        if row.consumer not in at:
            return (seq, end, cursors, kept), [(seq, "unknown_consumer", None, None, held)]
        at[row.consumer] = min(end, at[row.consumer] + samples)
        floor = min(at.values())
        out = []
        for a, b in packets:
            if b <= floor:
                held -= b - a
                out.append((seq, "evicted", a, b, held))
        return (seq, end, json.dumps(at), json.dumps([p for p in packets if p[1] > floor])), out


def readiness_batch(packets: DataFrame, batch: int = 2560, ahead: int = 640) -> DataFrame:
    return fold_batch(packets, Readiness(batch, ahead))


def readiness_stream(packets: DataFrame, batch: int = 2560, ahead: int = 640, ttl_ms: int | None = None) -> DataFrame:
    return fold_stream(packets, Readiness(batch, ahead), ttl_ms=ttl_ms)


def ledger_batch(calls: DataFrame, consumers: tuple[str, ...], most: int) -> DataFrame:
    return fold_batch(calls, Ledger(consumers, most))


def ledger_stream(calls: DataFrame, consumers: tuple[str, ...], most: int, ttl_ms: int | None = None) -> DataFrame:
    return fold_stream(calls, Ledger(consumers, most), ttl_ms=ttl_ms)
