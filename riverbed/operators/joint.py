"""Joint batches of two lanes: what a batch must satisfy by itself, as columns, before it may replace the state that readers see.

A batch is a step of 160 ms of one user turn. The controller's lane brings a state and the windows of samples that it heard, the recogniser's lane one or two
frames of 80 ms with the text so far; staged is what their callbacks had said before. See streaming/context.py for the rules that need the state before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Samples of a batch, of a frame and what it hears beyond, of the windows; decisions, states of the user and of the service, completions.
BATCH, FRAME, BEYOND, HEARD = 2560, 1280, 200, 1680
WINDOWS = {"main": 2560, "lookback": 15360, "lookahead": 640}
WAIT, WORD = 32, 33
TOKENS = ["user_idle", "user_nonidle", "user_backchannel", "user_complete", "user_incomplete"]
SERVICE = ["idle", "nonidle", "speak", "blank"]
COMPLETIONS = ["model_complete", "wait_fallback"]
MOST_CHARS = 65_536
SOURCE = "streaming_asr"

_ID = "session_id: string, turn_id: string, step_id: bigint"
SPANS = "array<struct<kind: string, samples: bigint, start: bigint, end: bigint, reason: string>>"
STATE = f"struct<{_ID}, token: string, accepted: boolean, available_at: double, processed_until: bigint, observed_until: bigint, generation: bigint, speech: boolean>"
PROGRESS = f"struct<{_ID}, frame_index: bigint, processed_until: bigint, observed_until: bigint, groups: bigint, progress_at: double, decoding: boolean, open_tokens: array<int>, decision: int>"
CLOSED = f"struct<{_ID}, frame_index: bigint, processed_until: bigint, observed_until: bigint, groups: bigint, text: string, delta: string, source: string, text_available_at: double, text_observed_until: bigint>"
FRAMES = (
    f"array<struct<{_ID}, lane: string, frame_index: bigint, processed_until: bigint, observed_until: bigint, groups: bigint, progress_at: double, decoding: boolean, open_tokens: array<int>, decision: int, "
    f"started_at: double, completed_at: double, spans: {SPANS}, text: string, text_available_at: double, text_observed_until: bigint>>"
)
CONTROL = f"struct<{_ID}, lane: string, started_at: double, completed_at: double, processed_until: bigint, generation_after: bigint, service_state: string, completion: string, service_text: string, windows: struct<{', '.join(f'{w}: {SPANS}' for w in WINDOWS)}>, state: {STATE}>"
ASR = f"struct<{_ID}, lane: string, completed_at: double, processed_until: bigint, frames: {FRAMES}>"
STAGED = f"struct<state: {STATE}, progress: array<{PROGRESS}>, text: array<{CLOSED}>>"
COLUMNS = f"session_id string, turn_id string, step_id long, source_start long, source_end long, input_end long, input_eof boolean, input_ready_at double, started_at double, published_at double, control {CONTROL}, asr {ASR}, staged {STAGED}"


def _bad(c: Column) -> Column:
    """True unless c holds; a comparison with a missing value does not hold."""
    return ~F.coalesce(c, F.lit(False))


def _time(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c < float("inf")), F.lit(False))


def _own(part: Column) -> Column:
    return (part["session_id"] == F.col("session_id")) & (part["turn_id"] == F.col("turn_id")) & (part["step_id"] == F.col("step_id"))


def _progress(processed: Column, observed: Column) -> Column:
    return (processed >= 0) & (processed <= observed) & (observed <= F.col("input_end"))


def _real_until(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: F.when(x["kind"] == "real", F.greatest(a, x["end"])).otherwise(a))


def _span_rules(spans: Column, length: int) -> dict[str, Column]:
    """Samples that are real have a range of that length within the input; others have a reason; together they are length."""
    real = lambda x: x["kind"].eqNullSafe(F.lit("real"))
    within = lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.col("input_end")) & (x["end"] - x["start"] == x["samples"])
    reasoned = lambda x: (x["kind"] == "synthetic") & (F.coalesce(x["reason"], F.lit("")) != "")
    return {
        "span_length": _bad(F.forall(spans, lambda x: x["samples"] >= 0)),
        "span_range": _bad(F.forall(spans, lambda x: ~real(x) | F.coalesce(within(x), F.lit(False)))),
        "span_reason": _bad(F.forall(spans, lambda x: real(x) | F.coalesce(reasoned(x), F.lit(False)))),
        "span_cover": _bad(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["samples"]) == length),
    }


def guards() -> dict[str, Column]:
    """A label for each rule that a batch may break by itself; each column is true where it does."""
    c = F.col
    control, asr, staged = c("control"), c("asr"), c("staged")
    state, frames = control["state"], asr["frames"]
    start, end, input_end = c("source_start"), c("source_end"), c("input_end")
    n = F.size(frames)
    both = control.isNotNull() & asr.isNotNull()
    each = lambda rule: F.forall(F.zip_with(frames, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda x, i: F.coalesce(rule(x, i), F.lit(False))), lambda ok: ok)
    pairs = lambda rule: F.when(n > 1, F.forall(F.zip_with(F.slice(frames, 1, n - 1), F.slice(frames, 2, n - 1), lambda a, b: F.coalesce(rule(a, b), F.lit(False))), lambda ok: ok)).otherwise(True)
    until = lambda x, i: (F.least((c("step_id") * 2 + i + 1) * FRAME, end), F.least((c("step_id") * 2 + i + 1) * FRAME + BEYOND, input_end))
    told = ["session_id", "turn_id", "step_id", "frame_index", "processed_until", "observed_until", "groups", "progress_at", "decoding", "open_tokens", "decision"]
    same = lambda x, p: F.struct(*[x[f].alias(f) for f in told]).eqNullSafe(F.struct(*[p[f].alias(f) for f in told]))
    last = F.element_at(frames, -1)
    heard = {w: _real_until(control["windows"][w]) for w in WINDOWS}
    spans = [_span_rules(control["windows"][w], k) for w, k in WINDOWS.items()]
    of_frames = lambda name: _bad(F.forall(frames, lambda x: ~_span_rules(x["spans"], HEARD)[name]))
    spans.append({name: of_frames(name) for name in spans[0]})
    any_of = lambda name: spans[0][name] | spans[1][name] | spans[2][name] | spans[3][name]
    rules = {
        "source_range": _bad((c("step_id") >= 0) & (start == c("step_id") * BATCH) & (start < end) & (end <= start + BATCH) & (end <= input_end) & c("input_eof").isNotNull() & ((end == start + BATCH) | (c("input_eof") & (end == input_end)))),
        "invalid_time": ~(_time(c("input_ready_at")) & _time(c("started_at"))),
        "started_before_ready": c("started_at") < c("input_ready_at"),
        "lane_missing": ~both,
    }
    lanes = {
        "foreign_receipt": _bad(_own(control) & _own(asr) & _own(state) & F.forall(frames, lambda x: _own(x))),
        "lane_incomplete": _bad((control["lane"] == "controller") & (asr["lane"] == "asr") & _time(control["completed_at"]) & _time(asr["completed_at"]) & (control["completed_at"] >= c("started_at")) & (asr["completed_at"] >= c("started_at"))),
        "state_callback": ~staged["state"].eqNullSafe(state),
        "state_outside_run": _bad(_time(state["available_at"]) & _time(control["started_at"]) & (c("started_at") <= control["started_at"]) & (control["started_at"] <= state["available_at"]) & (state["available_at"] <= control["completed_at"])),
        "invalid_state": _bad(state["accepted"].isNotNull() & (~state["accepted"] | state["token"].isin(TOKENS))),
        "invalid_generation": _bad((state["generation"] >= 0) & control["generation_after"].isin(state["generation"], state["generation"] + 1)),
        "state_progress": _bad(_progress(state["processed_until"], state["observed_until"])),
        "native_progress": _bad((control["processed_until"] == state["processed_until"]) & (heard["main"] == state["processed_until"]) & (F.greatest(state["processed_until"], heard["lookahead"]) == state["observed_until"])),
        **{name: any_of(name) for name in spans[0]},
        "frame_count": _bad((n == F.ceil((end - start) / FRAME)) & (F.size(staged["progress"]) == n)),
        "too_many_texts": _bad(F.size(staged["text"]) <= n),
        "frame_progress": _bad(F.forall(frames, lambda x: _progress(x["processed_until"], x["observed_until"]))),
        "frame_step": _bad(each(lambda x, i: (x["frame_index"] == c("step_id") * 2 + i) & (x["lane"] == "asr") & (x["processed_until"] == until(x, i)[0]) & (x["observed_until"] == until(x, i)[1]) & ~x["decoding"] & (F.size(x["open_tokens"]) == 0) & x["decision"].isin(WAIT, WORD) & (x["groups"] >= 0))),
        "frame_spans": _bad(F.forall(frames, lambda x: _real_until(x["spans"]) == x["observed_until"])),
        "frame_time": _bad(F.forall(frames, lambda x: _time(x["started_at"]) & (c("started_at") <= x["started_at"]) & (x["started_at"] <= x["progress_at"]) & (x["progress_at"] <= x["completed_at"]) & (x["completed_at"] <= asr["completed_at"])) & pairs(lambda a, b: a["completed_at"] <= b["started_at"])),
        "frame_groups": _bad(pairs(lambda a, b: b["groups"] == a["groups"] + (b["decision"] == WORD).cast("int"))),
        "progress_callback": F.coalesce((F.size(staged["progress"]) == n) & ~F.forall(F.zip_with(frames, staged["progress"], same), lambda ok: ok), F.lit(False)),
        "receipt_progress": _bad(asr["processed_until"] == last["processed_until"]),
        "text_missing": _bad(F.forall(frames, lambda x: x["text"].isNotNull())),
        "service_result": _bad((control["service_state"].isNull() | control["service_state"].isin(SERVICE)) & (control["completion"].isNull() | control["completion"].isin(COMPLETIONS)) & (F.length(control["service_text"]) <= MOST_CHARS) & state["speech"].isNotNull()),
        "service_completion": _bad(control["completion"].isNull() | (
            (control["service_state"].eqNullSafe(F.lit("speak"))) & ((control["completion"] != "model_complete") | (state["token"].eqNullSafe(F.lit("user_complete")) & state["accepted"] & state["speech"]))
            & ((control["completion"] != "wait_fallback") | ~state["token"].eqNullSafe(F.lit("user_complete"))))),
    }
    return rules | {name: both & rule for name, rule in lanes.items()}


def exploded(df: DataFrame, made: str, name: str, *keep: str) -> DataFrame:
    """keep and a row for each entry of the column made, one with null where it has none. An explode runs what it is given uncompiled, so dear entries are made in a column before; and for an inner
    one the optimizer infers a filter, which would make them again."""
    return df.select(*keep, F.explode_outer(made).alias(name))


def checked(batches: DataFrame) -> DataFrame:
    """batches with failures, the labels of the guards that they break."""
    return batches.withColumn("failures", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in guards().items()])))


def violations(batches: DataFrame) -> DataFrame:
    """session_id, turn_id, step_id, label: a row for each guard that a batch breaks."""
    return exploded(checked(batches), "failures", "label", "session_id", "turn_id", "step_id").filter("label is not null")
