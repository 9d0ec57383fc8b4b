"""The state of user turns that readers see: opened, replaced step by step by joint batches that pass every guard, closed, released."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators.joint import SOURCE, WORD, checked
from riverbed.streaming.folds import Fold, fold_batch, fold_stream

#: One row a call: kind (open, batch, close, release), reason of a close, seq the order of calls of a turn, payload of a batch.
CALLS = "session_id string, turn_id string, seq long, kind string, reason string, payload string"


#: Of a frame, what the state before decides on; that its session, turn and step are the batch's is a guard's matter.
_FRAME = ["frame_index", "processed_until", "observed_until", "groups", "progress_at", "decision", "text", "text_available_at", "text_observed_until"]


def with_payload(batches: DataFrame) -> DataFrame:
    """Batches and payload, JSON of what is left to check, which needs the state before: a fraction of the batch, and of a batch that failed the labels only."""
    state, control = F.col("control.state"), F.col("control")
    left = F.struct(
        "step_id", "started_at", "published_at", F.greatest("control.completed_at", "asr.completed_at").alias("done"), state["token"].alias("token"), state["accepted"].alias("accepted"),
        state["processed_until"].alias("cp"), state["observed_until"].alias("co"), state["generation"].alias("generation"), control["generation_after"].alias("generation_after"),
        F.transform(F.col("asr.frames"), lambda x: F.struct(*[x[f].alias(f) for f in _FRAME])).alias("frames"), F.col("staged.text").alias("closed"),
    )
    return checked(batches).withColumn("payload", F.when(F.size("failures") > 0, F.to_json(F.struct("failures"))).otherwise(F.to_json(left)))


def calls(batches: DataFrame, seq: str = "step_id") -> DataFrame:
    """Batches as CALLS."""
    return with_payload(batches).select("session_id", "turn_id", F.col(seq).cast("long").alias("seq"), F.lit("batch").alias("kind"), F.lit(None).cast("string").alias("reason"), "payload")


class Context(Fold):
    """CALLS in; out come seq, kind, label (null where the call took effect) and, for a batch that did, the state that it left.

    A batch that breaks a guard leaves the state as it was, so later ones are out of step until the missing one comes. Text only grows, by one closed group a word frame; progress and
    generations only grow; what a text was available by does not change with it. Text and state are bounded, so a turn's state is.
    """

    keys, order, columns = ["session_id", "turn_id"], ["seq"], ["seq", "kind", "reason", "payload"]
    state = "seq long, status string, step long, text string, groups long, text_at double, text_until long, cp long, co long, ap long, generation long"
    output = "seq long, kind string, label string, step_id long, text string, groups long, token string, accepted boolean, processed_until long, observed_until long, asr_processed_until long, text_available_at double, text_published_at double, published_at double"
    start = (-(1 << 62), "absent", -1, "", 0, None, 0, 0, 0, 0, 0)

    def __init__(self, most_chars: int = 65_536, most_bytes: int = 256 * 1024):
        self.most_chars, self.most_bytes = most_chars, most_bytes

    def step(self, state: tuple, row: object) -> tuple[tuple, list[tuple]]:
        seq, status = int(row.seq), state[1]
        if seq <= state[0]:
            return state, []
        state = (seq, *state[1:])
        say = lambda *labels: (state, [(seq, row.kind, x, *[None] * 11) for x in labels])
        done = lambda now, *rest: ((seq, now, *rest), [(seq, row.kind, *[None] * 12)])
        if row.kind == "open":
            return done("open", *self.start[2:]) if status == "absent" else say("opened_twice")
        if status == "absent":
            return say("unknown_turn")
        if row.kind == "close":
            return done("closed", *state[2:]) if row.reason else say("closed_without_reason")
        if row.kind == "release":
            return done(*self.start[1:]) if status == "closed" else say("released_active")
        batch = json.loads(row.payload)
        if batch.get("failures"):
            return say(*batch["failures"])
        if label := self.broken(state, batch, {"session_id": row.session_id, "turn_id": row.turn_id, "step_id": batch["step_id"]}):
            return say(label)
        last, text = batch["frames"][-1], state[3]
        text_at, until = (last["text_available_at"], last["text_observed_until"]) if last["text"] != text else state[5:7]
        seen = (batch["step_id"], last["text"], last["groups"], batch["token"] if "token" in batch else None, batch["accepted"], batch["cp"], batch["co"], last["processed_until"], text_at, batch["published_at"] if last["text"] != text else None, batch["published_at"])
        if len(last["text"]) > self.most_chars:
            return say("text_limit")
        # a character takes six bytes at most, and all but text and token less than 1024
        if 6 * (len(last["text"]) + len(batch.get("token") or "")) + 1024 > self.most_bytes and len(json.dumps(seen, ensure_ascii=False).encode()) > self.most_bytes:
            return say("state_limit")
        state = (seq, "open", batch["step_id"], last["text"], last["groups"], text_at, until, batch["cp"], batch["co"], last["processed_until"], batch["generation_after"])
        return state, [(seq, "batch", None, *seen)]

    @staticmethod
    def broken(state: tuple, batch: dict, own: dict) -> str | None:
        """The first rule between a batch, whose session, turn and step are own, and the state before it that does not hold."""
        _, status, step, text, groups, text_at, until, cp, co, ap, generation = state
        frames = batch["frames"]
        if status != "open":
            return "closed_turn"
        if batch["step_id"] != step + 1:
            return "out_of_step"
        if batch["cp"] < cp or batch["co"] < co or frames[-1]["processed_until"] <= ap or batch["generation"] != generation:
            return "moved_back"
        closed = []
        for x in frames:
            if x["groups"] != groups + (x["decision"] == WORD):
                return "groups_lost"
            if not x["text"].startswith(text) or x["decision"] != WORD and x["text"] != text:
                return "text_not_appended"
            at, seen = x.get("text_available_at"), x.get("text_observed_until")
            if x["text"] != text:
                fields = ("frame_index", "processed_until", "observed_until", "groups", "text", "text_available_at", "text_observed_until")
                closed.append(own | {f: x.get(f) for f in fields} | {"delta": x["text"][len(text) :], "source": SOURCE})
                if at is None or not batch["started_at"] <= at <= x["progress_at"] or seen != x["observed_until"]:
                    return "text_availability"
            elif (at, seen) != (text_at, until) and not (text_at is None and at is None and not until and not seen):
                return "unchanged_text_moved"
            text, groups, text_at, until = x["text"], x["groups"], at, seen
        if batch.get("closed", []) != closed:
            return "text_callback"
        return "published_early" if batch["published_at"] < batch["done"] else None


def context_batch(rows: DataFrame, dealt: bool = False, **limits: int) -> DataFrame:
    """What becomes of a table of CALLS. dealt: the calls of a turn lie in one partition."""
    return fold_batch(rows, Context(**limits), dealt=dealt)


def context_stream(rows: DataFrame, ttl_ms: int | None = None, **limits: int) -> DataFrame:
    """The same over a stream; released turns start anew, and those idle for ttl_ms leave the state."""
    return fold_stream(rows, Context(**limits), ttl_ms=ttl_ms)
