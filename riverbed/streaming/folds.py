"""Folds along the ordered rows of a key, once as a batch over a table and once as a stateful stream.

A fold is a state, a step for each row, and perhaps a deadline in event time at which a state expires without a row. Both forms run the same
steps; a state past its deadline expires before the key's next row, or when the watermark (a batch: the end of the table) passes it.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Fold(ABC):
    """keys, order and columns name what a step reads; state and output are schemas, output without the keys; start is the state before any row."""

    keys: list[str]
    order: list[str]
    columns: list[str]
    state: str
    output: str
    start: tuple

    @abstractmethod
    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what comes out. A row that is not later than the last one must change nothing: a stream may see it again."""

    def deadline(self, state: tuple) -> int | None:
        """Milliseconds since 1970 after which the state expires by itself."""
        return None

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []

    def at(self, row: object) -> int | None:
        """Milliseconds since 1970 of a row, for folds with a deadline."""
        return None

    def advance(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        out: list[tuple] = []
        due, now = self.deadline(state), self.at(row)
        if due is not None and now is not None and due < now:
            state, out = self.expire(state)
        state, more = self.step(state, row)
        return state, out + more

    def names(self, df: DataFrame) -> tuple[str, list[str]]:
        schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in self.keys) + ", " + self.output
        return schema, [*self.keys, *(part.split()[0] for part in self.output.split(", "))]


def fold_batch(df: DataFrame, fold: Fold, horizon_ms: int | None = None, dealt: bool = False) -> DataFrame:
    """What the fold puts out for all rows of df. State runs along a key's sorted rows within their partition, batch by batch; states past their deadline at horizon_ms expire at the end.
    dealt: a key's rows lie in one partition already, and are not shuffled again."""
    schema, names = fold.names(df)
    n = len(fold.keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state = fold.start

        def ended() -> list[tuple]:
            due = fold.deadline(state) if key is not None and horizon_ms is not None else None
            return [(*key, *x) for x in fold.expire(state)[1]] if due is not None and due < horizon_ms else []

        for batch in batches:
            found: list[tuple] = []
            for row in batch.itertuples(index=False):
                if key != tuple(row[:n]):
                    found += ended()
                    key, state = tuple(row[:n]), fold.start
                state, out = fold.advance(state, row)
                found += [(*key, *x) for x in out]
            yield _frame(found, names)
        yield _frame(ended(), names)

    rows = df.select(*fold.keys, *fold.columns)
    rows = (rows if dealt else rows.repartition(*fold.keys)).sortWithinPartitions(*fold.keys, *fold.order)
    return rows.mapInPandas(run, schema)


def _frame(found: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=names, dtype=object)  # else a column of integers and nulls becomes one of doubles


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str], ttl_ms: int | None):
        self.fold, self.names, self.ttl_ms = fold, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state, ttlDurationMs=self.ttl_ms) if self.ttl_ms else handle.getValueState("state", self.fold.state)

    def _out(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return _frame([(*key, *x) for x in found], self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.fold.start
        found: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(self.fold.order, kind="stable").itertuples(index=False):
            state, out = self.fold.advance(state, row)
            found += out
        self.state.update(state)
        if (due := self.fold.deadline(state)) is not None:
            self.handle.registerTimer(due + 1)
        yield self._out(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.fold.start
        due, found = self.fold.deadline(state), []
        if due is not None and due < expiredTimerInfo.getExpiryTimeInMs():  # else the timer is that of an earlier state
            state, found = self.fold.expire(state)
            self.state.update(state)
        yield self._out(key, found)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, fold: Fold, ts: str | None = None, late: str = "0 seconds", ttl_ms: int | None = None) -> DataFrame:
    """The same over a stream whose micro-batches bring a key's rows in order. ts is the event time of deadlines, which fire as the watermark passes them; without
    one, ttl_ms of processing time lets idle keys leave the state. Needs the RocksDB state store."""
    schema, names = fold.names(df)
    rows = df.select(*fold.keys, *fold.columns, *([ts] if ts and ts not in fold.columns else []))
    mode = "EventTime" if ts else "ProcessingTime" if ttl_ms else "None"
    rows = rows.withWatermark(ts, late) if ts else rows
    return rows.groupBy(*fold.keys).transformWithStateInPandas(statefulProcessor=_Processor(fold, names, None if ts else ttl_ms), outputStructType=schema, outputMode="Append", timeMode=mode)


def end_of(df: DataFrame, ts: str) -> int:
    """Milliseconds since 1970 of the last row: the horizon of a batch."""
    return df.agg(F.max(F.unix_millis(F.col(ts).cast("timestamp")))).first()[0] or 0
