"""Tasks of periodic analysis: short calls, one at a time, each of which reads a dialogue as it stands and says how to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riverbed.streaming.folds import Fold, end_of, fold_batch, fold_stream

#: kind: request, update (of the dialogue), return (of a call); all others wake nothing. progress of a return: continue, await_input, done, else it failed.
EVENTS = "session long, ts timestamp, us long, id long, kind string, progress string, result string"


class Analysis(Fold):
    """EVENTS in; out come us, id, action, task, cycle, based_on, detail.

    A request starts a task, or is merged with the one that is active. A task's first call reads all updates so far (based_on) and so does each later one; updates during a
    call wait for the next. After `continue` the next call follows, while the budget of calls allows. After `await_input` it follows at once if an update is unread, else the
    task waits for one. After `done` the result is published and the task ends, unless an update is unread: then the result is withheld, and the next call follows. A `done`
    without a result, a failure, an overrun of the budget or of the time that a call may take ends the task without one.
    """

    keys, order, columns = ["session"], ["us", "id"], ["us", "id", "kind", "progress", "result"]
    state = "us long, id long, status string, task long, cycle long, read long, position long, started long, version long"
    output = "us long, id long, action string, task long, cycle long, based_on long, detail string"
    start = (-(1 << 62), -1, "idle", 0, 0, 0, 0, 0, 0)

    def __init__(self, budget: int = 8, timeout_ms: int = 60_000):
        self.budget, self.timeout_us = budget, timeout_ms * 1000

    def at(self, row: object) -> int:
        return int(row.us) // 1000

    def deadline(self, state: tuple) -> int | None:
        return (state[7] + self.timeout_us) // 1000 if state[2] == "running" else None

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        us, i, _, task, cycle, read, position, started, version = state
        return (us, i, "idle", task, cycle, read, position, started, version), [(started + self.timeout_us, None, "timed_out", task, cycle, read, None)]

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last_us, last_id, status, task, cycle, read, position, started, version = state
        us, i = int(row.us), int(row.id)
        if (us, i) <= (last_us, last_id):
            return state, []
        out: list[tuple] = []

        def say(action: str, detail: str | None = None) -> None:
            out.append((us, i, action, task, cycle, read, detail))

        go = False
        if row.kind == "request":
            if status == "idle":
                task, cycle, go = task + 1, 0, True
            else:
                say("request_merged")
        elif row.kind == "update":
            position += 1
            go = status == "waiting"
        elif row.kind == "return" and status != "running":
            say("stray_return")
        elif row.kind == "return":
            unread, status = position > read, "idle"
            if row.progress == "continue" or row.progress == "await_input" and unread:
                go = True
            elif row.progress == "await_input":
                status = "waiting"
                say("waiting")
            elif row.progress == "done" and row.result and unread:
                say("result_withheld", row.result)
                go = True
            elif row.progress == "done" and row.result:
                version += 1
                say("result_published", f"{version}:{row.result}")
            else:
                say("failed")
        if go and cycle >= self.budget:
            status = "idle"
            say("budget_spent")
        elif go:
            status, cycle, read, started = "running", cycle + 1, position, us
            say("cycle_started")
        return (us, i, status, task, cycle, read, position, started, version), out


def analysis_batch(events: DataFrame, budget: int = 8, timeout_ms: int = 60_000) -> DataFrame:
    """Actions over a table of EVENTS; calls that are over their time at its last event have timed out."""
    return fold_batch(events, Analysis(budget, timeout_ms), end_of(events, "ts"))


def analysis_stream(events: DataFrame, budget: int = 8, timeout_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """The same over a stream; a timer in event time ends a call that does not return."""
    return fold_stream(events, Analysis(budget, timeout_ms), "ts", late)
