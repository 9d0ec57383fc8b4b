"""A session of replies: published states start and cancel them, and what was heard of them becomes history."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame

from riverbed.streaming.folds import Fold, fold_batch, fold_stream

#: One row an event, by kind. state: step_id, token, accepted, delta (new text), chars and crc (length and, if known, CRC-32 of the text before it). played: request, text heard, tail (samples heard beyond it).
#: completed: request. repaired: request, version, text.
EVENTS = "session long, seq long, kind string, step_id long, token string, accepted boolean, delta string, chars long, crc long, request string, text string, tail long, version long"
MOST_REPAIRS = 128


class Replies(Fold):
    """EVENTS in; out come seq, action, request, text, version.

    States are consumed once, in steps without a gap, over a text that only grows: a step out of turn and a text before that differs are told and change nothing. An accepted complete
    state with new text starts a reply with it, after cancelling one that is busy; its text is a new entry of the user or joins the one that is the last. An accepted nonidle one cancels.
    A reply that ends or is cancelled leaves what was heard of it, an empty entry too while samples beyond its text wait for repair; a repair counts once, if its version is that of the entry.
    """

    keys, order, columns = ["session"], ["seq"], ["seq", "kind", "step_id", "token", "accepted", "delta", "chars", "crc", "request", "text", "tail", "version"]
    state = "seq long, step long, chars long, crc long, pending string, counter long, current string, spoken string, tail long, last_role string, repairs string"
    output = "seq long, action string, request string, text string, version long"
    start = (-1, -1, 0, 0, "", 0, "", "", 0, "", "{}")

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        last, step, chars, crc, pending, counter, current, spoken, tail, role, repairs = state
        seq = int(row.seq)
        if seq <= last:
            return state, []
        waiting = json.loads(repairs)
        out: list[tuple] = []

        def say(action: str, request: str | None = None, text: str | None = None, version: int | None = None) -> None:
            out.append((seq, action, request, text, version))

        def finish(keep_empty: bool) -> None:
            nonlocal current, spoken, tail, role
            if spoken.strip() or keep_empty:
                say("assistant_entry", current, spoken.strip())
                role = "assistant"
            current, spoken, tail = "", "", 0

        def cancel(reason: str) -> None:
            if not current:
                return
            say("cancelled", current, reason)
            if tail > 0:
                if len(waiting) >= MOST_REPAIRS:
                    say("too_many_repairs", current)
                else:
                    waiting[current] = spoken.strip()
                    say("history_pending", current, None, 1)
            finish(tail > 0)

        if row.kind == "state":
            known = int(row.chars) == chars and (row.crc is None or row.crc != row.crc or int(row.crc) == crc)
            if int(row.step_id) != step + 1 or not known:
                say("missing_step" if int(row.step_id) != step + 1 else "prefix_changed")
            else:
                delta = row.delta or ""
                step, pending, chars, crc = step + 1, pending + delta, chars + len(delta), zlib.crc32(delta.encode(), crc)
                if row.accepted and row.token == "user_nonidle":
                    cancel("nonidle")
                elif row.accepted and row.token == "user_complete" and not pending.strip():
                    say("complete_without_new_text")
                elif row.accepted and row.token == "user_complete":
                    cancel("new_complete")
                    counter, text, pending = counter + 1, pending.strip(), ""
                    current = f"r{counter}"
                    say("user_merged" if role == "user" else "user_entry", current, text)
                    say("reply_started", current, text)
                    role = "user"
        elif row.kind == "played":
            if row.request == current:
                spoken, tail = row.text or "", int(row.tail)
            else:
                say("late_audio_discarded", row.request)
        elif row.kind == "completed":
            if row.request == current:
                finish(False)
                say("completed", row.request)
            else:
                say("stray_completion", row.request)
        elif row.kind == "repaired":
            if row.request in waiting and row.version == 1:
                say("history_repaired", row.request, " ".join(x for x in (waiting.pop(row.request), (row.text or "").strip()) if x), 1)
            else:
                say("repair_stale", row.request)
        return (seq, step, chars, crc, pending, counter, current, spoken, tail, role, json.dumps(waiting)), out


def replies_batch(events: DataFrame) -> DataFrame:
    return fold_batch(events, Replies())


def replies_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return fold_stream(events, Replies(), ttl_ms=ttl_ms)
