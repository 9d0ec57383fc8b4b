"""Keys that open, close and are released, as a stream: state that forgets, and a bound on what is held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = "scope long, us long, id long, key string, action string"
FAILURES = "scope long, us long, id long, failure string"


class Lifecycle(StatefulProcessor):
    """The rules of rules.key_lifecycle for each scope. A key's last action is an entry of its own in the state, which goes when nothing has come for ttl_ms of processing
    time; so the state holds the keys of that time, not of all times. A scope holds at most `most` keys: one opened beyond is told, and so is one that would be entry number `entries`, which is then not kept."""

    def __init__(self, most: int, entries: int, ttl_ms: int | None):
        self.most, self.entries, self.ttl_ms = most, entries, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.last = handle.getMapState("last", "key string", "action string", **ttl)
        self.seen = handle.getValueState("seen", "us long, id long, held long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        us, i, held = tuple(self.seen.get()) if self.seen.exists() else (-(1 << 62), -1, 0)
        found = []
        kept = sum(1 for _ in self.last.keys())
        for row in pd.concat(list(rows)).sort_values(["us", "id"], kind="stable").itertuples(index=False):
            if (int(row.us), int(row.id)) <= (us, i):
                continue
            us, i = int(row.us), int(row.id)
            known = self.last.containsKey((row.key,))
            before = self.last.getValue((row.key,))[0] if known else None
            held += {"open": 1, "release": -1}.get(row.action, 0)
            failures = []
            if row.action == "open" and before is not None:
                failures.append("opened_twice")
            if row.action == "close" and before != "open":
                failures.append("closed_unopened")
            if row.action == "release" and before != "close":
                failures.append("released_unclosed")
            if row.action == "open" and held > self.most:
                failures.append("too_many")
            if known or kept < self.entries:
                self.last.updateValue((row.key,), (row.action,))
                kept += not known
            else:
                failures.append("state_full")
            found += [(key[0], us, i, f) for f in failures]
        self.seen.update((us, i, held))
        yield pd.DataFrame(found, columns=["scope", "us", "id", "failure"])

    def close(self) -> None:
        pass


def lifecycle_stream(actions: DataFrame, most: int, entries: int = 100_000, ttl_ms: int | None = None) -> DataFrame:
    """FAILURES of a stream of ACTIONS whose micro-batches bring a scope's actions in order. Needs the RocksDB state store."""
    return actions.groupBy("scope").transformWithStateInPandas(statefulProcessor=Lifecycle(most, entries, ttl_ms), outputStructType=FAILURES, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
