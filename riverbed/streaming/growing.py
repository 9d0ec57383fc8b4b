"""Segments of texts that still grow: deltas come in, and a segment leaves as soon as it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riverbed.operators.text import segment_ends
from riverbed.streaming.folds import Fold, fold_batch, fold_stream

DELTAS = "key string, seq long, kind string, text string"


class Growing(Fold):
    """DELTAS in, one row a delta: key, seq (its place), kind (delta, done, cancel), text. Out come pos, segment, kind: segment; end after the last
    one; empty for a text that ended without a word; cancelled; after_end for a delta that came when the text had ended.

    What is pending never holds more than a limit's characters after a step, however long the text grows. A sentence mark at the end of what is
    pending ends a segment, so how a text is cut into deltas may decide: `3.` and `14` are two segments, `3.14` is one.
    """

    keys, order, columns = ["key"], ["seq", "kind"], ["seq", "kind", "text"]
    state = "seq long, pending string, pos long, worded boolean, ended boolean"
    output = "pos long, segment string, kind string"
    start = (-1, "", 0, False, False)

    def __init__(self, first: int = 20, limit: int = 40):
        self.first, self.limit = first, limit

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last, pending, pos, worded, ended = state
        seq, kind, text = int(row.seq), row.kind, row.text or ""
        if seq <= last:
            return state, []
        if ended:
            return (seq, "", pos, worded, True), [(pos, text, "after_end")]
        if kind == "cancel":
            return (seq, "", pos, worded, True), [(pos, None, "cancelled")]
        final = kind == "done"
        pending += "" if final else text
        worded = worded or bool(pending.strip())
        if final and not worded:
            return (seq, "", pos, False, True), [(pos, None, "empty")]
        out: list[tuple] = []
        ends = segment_ends(pending, self.limit, self.limit if pos else self.first, final)
        for a, b in zip([0, *ends], ends):
            if segment := pending[a:b].strip():
                out.append((pos, segment, "segment"))
                pos += 1
        if final:
            out.append((pos, None, "end"))
        return (seq, pending[ends[-1] :] if ends else pending, pos, worded, final), out


def segments_stream(deltas: DataFrame, first: int = 20, limit: int = 40, ttl_ms: int | None = None) -> DataFrame:
    """Segments of a stream of DELTAS; first is the limit until one segment has left."""
    return fold_stream(deltas, Growing(first, limit), ttl_ms=ttl_ms)


def segments_batch(deltas: DataFrame, first: int = 20, limit: int = 40) -> DataFrame:
    """The same segments from a table of all deltas."""
    return fold_batch(deltas, Growing(first, limit))
