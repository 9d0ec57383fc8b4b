"""Joint batches built from the event table, eight events of a user a turn, some of them spoilt in one place, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.operators import joint as G
from riverbed.operators.sequence import dealt
from riverbed.sources.tables import events, table
from riverbed.streaming import context

STEPS = 8
#: Steps of a task: a batch is dear, its step is not.
PART_ROWS = 50_000
#: Ways to spoil a turn: the step where it happens, and the labels that this must give.
SPOILT = {
    "source_range": (3, ["source_range"]), "invalid_time": (3, ["invalid_time"]), "started_before_ready": (3, ["started_before_ready"]), "lane_missing": (3, ["lane_missing"]), "foreign_receipt": (3, ["foreign_receipt"]),
    "lane_incomplete": (3, ["lane_incomplete"]), "state_callback": (3, ["state_callback"]), "state_outside_run": (3, ["state_outside_run"]), "invalid_state": (3, ["invalid_state"]), "invalid_generation": (3, ["invalid_generation"]),
    "state_progress": (3, ["state_progress", "native_progress"]), "native_progress": (3, ["native_progress"]), "span_length": (3, ["span_length"]), "span_range": (3, ["span_range"]), "span_reason": (3, ["span_reason"]),
    "span_cover": (3, ["span_cover"]), "frame_count": (3, ["frame_count"]), "too_many_texts": (3, ["too_many_texts"]), "frame_progress": (3, ["frame_progress", "frame_step", "frame_spans"]), "frame_step": (3, ["frame_step"]),
    "frame_spans": (3, ["frame_spans"]), "frame_time": (3, ["frame_time"]), "frame_groups": (3, ["frame_groups"]), "progress_callback": (3, ["progress_callback"]), "receipt_progress": (3, ["receipt_progress"]), "text_missing": (3, ["text_missing"]),
    "service_result": (3, ["service_result"]), "service_completion": (3, ["service_completion"]), "moved_back": (3, ["moved_back"]), "groups_lost": (3, ["groups_lost"]), "text_not_appended": (3, ["text_not_appended"]),
    "text_availability": (4, ["text_availability"]), "unchanged_text_moved": (3, ["unchanged_text_moved"]), "text_callback": (4, ["text_callback"]), "published_early": (3, ["published_early"]),
    "closed_turn": (3, ["closed_turn"]), "unknown_turn": (0, ["unknown_turn"]), "opened_twice": (0, ["opened_twice"]), "closed_without_reason": (0, ["closed_without_reason"]), "released_active": (0, ["released_active"]),
}
#: Labels that batches give by themselves, without the state before.
ALONE = list(SPOILT)[: list(SPOILT).index("moved_back")]


def turns(spark, sf_dir) -> DataFrame:
    """session, turn, step, last (step of the turn), fault (what spoils the turn, null for one in so many)."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, sf_dir, "event_id", "user_id").withColumn("n", F.row_number().over(w) - 1)
    e = e.select("user_id", F.floor(F.col("n") / STEPS).alias("turn"), (F.col("n") % STEPS).cast("long").alias("step"))
    e = e.withColumn("last", F.max("step").over(Window.partitionBy("user_id", "turn")))
    kind = (F.col("user_id") * 7 + F.col("turn")) % (len(SPOILT) + 1)
    t = e.select(F.concat(F.lit("s"), F.col("user_id")).alias("session_id"), F.concat(F.lit("t"), F.col("turn")).alias("turn_id"), "step", "last", F.get(F.array(*map(F.lit, SPOILT)), kind.cast("int")).alias("fault"))
    # by turn while rows are small: what is made of them is shuffled no more
    return dealt(t, ["session_id", "turn_id"], table(spark, sf_dir, "events").count(), PART_ROWS)


def batches(steps: DataFrame, *keep: str) -> DataFrame:
    """A batch for each step, and the columns to keep. All numbers follow from the step; the fault of a turn changes one of them."""
    c = F.col
    s, final = c("step"), c("step") == STEPS - 1

    def odd(name: str, bad: Column, good: Column) -> Column:
        return F.when((c("fault") == name) & (s == SPOILT[name][0]), bad).otherwise(good)

    start, full = s * G.BATCH, s * G.BATCH + G.BATCH
    end = F.when(final, start + 1500).otherwise(full)
    input_end = F.when(final, end).otherwise(end + 1000)
    began = 1.0 + s * 0.16
    own = lambda step=s: [c("session_id"), c("turn_id"), step.alias("step_id")]
    lit_long = lambda x: F.lit(x).cast("long")
    span = lambda kind, samples, a=None, b=None, reason=None: F.struct(F.lit(kind).alias("kind"), samples.cast("long").alias("samples"), (lit_long(None) if a is None else a).alias("start"), (lit_long(None) if b is None else b).alias("end"), F.lit(reason).cast("string").alias("reason"))

    def spans(a: Column, b: Column, length: int) -> Column:
        """Real samples from a to b and padding up to length."""
        a = F.greatest(a, lit_long(0))
        real = F.when(b > a, F.array(span("real", b - a, a, b))).otherwise(F.array().cast(G.SPANS))
        rest = length - F.greatest(b - a, lit_long(0))
        return F.concat(real, F.when(rest > 0, F.array(span("synthetic", rest, reason="edge"))).otherwise(F.array().cast(G.SPANS)))

    def spoil(name: str, good: Column, *extra: Column) -> Column:
        return odd(name, F.concat(good, F.array(*extra)), good)

    ahead = F.least(end + 640, input_end)
    main = spoil("span_reason", spoil("span_length", spans(start, end, 2560), span("synthetic", F.lit(-5), reason="x"), span("synthetic", F.lit(5), reason="x")), span("synthetic", F.lit(0), reason=""))
    back = spoil("span_cover", spans(end - 15360, end, 15360), span("synthetic", F.lit(10), reason="x"))
    back = odd("span_range", F.transform(back, lambda x: F.when(x["kind"] == "real", x.withField("start", x["start"] + 1)).otherwise(x)), back)
    generation = F.floor(s / 3) + odd("moved_back", F.lit(1), F.lit(0))
    token = F.when(final, "user_complete").otherwise("user_nonidle")
    state = F.struct(
        *own(), odd("invalid_state", F.lit("user_odd"), token).alias("token"), F.lit(True).alias("accepted"), (began + 0.05).alias("available_at"), end.alias("processed_until"),
        odd("state_progress", input_end + 5, ahead).alias("observed_until"), generation.alias("generation"), F.lit(True).alias("speech"),
    )
    control = F.struct(
        *own(odd("foreign_receipt", s + 1, s)), odd("lane_incomplete", F.lit("asr"), F.lit("controller")).alias("lane"), odd("state_outside_run", began - 0.5, began + 0.001).alias("started_at"), (began + 0.06).alias("completed_at"),
        odd("native_progress", end - 1, end).alias("processed_until"), (F.floor((s + 1) / 3) + odd("moved_back", F.lit(1), F.lit(0)) + odd("invalid_generation", F.lit(2), F.lit(0))).alias("generation_after"),
        F.when(final, "speak").otherwise(odd("service_result", F.lit("odd"), odd("service_completion", F.lit("speak"), F.lit("nonidle")))).alias("service_state"),
        F.when(final, "model_complete").otherwise(odd("service_completion", F.lit("model_complete"), F.lit(None).cast("string"))).alias("completion"), F.lit("").alias("service_text"),
        F.struct(main.alias("main"), back.alias("lookback"), spans(end, ahead, 640).alias("lookahead")).alias("windows"), state.alias("state"),
    )

    # every even step closes a group in its first frame
    closed = F.floor(s / 2) + 1
    when = (closed - 1) * 2  # the step that closed the last group
    words = lambda k: F.array_join(F.transform(F.sequence(lit_long(1), k), lambda x: F.concat(F.lit("w"), x)), " ")
    text_at = 1.0 + when * 0.16 + 0.02
    seen = when * 2 * G.FRAME + G.FRAME + G.BEYOND

    def frame(i: int) -> dict[str, Column]:
        processed = F.least((s * 2 + i + 1) * G.FRAME, end)
        observed = F.least((s * 2 + i + 1) * G.FRAME + G.BEYOND, input_end)
        own_spans = spans(observed - G.HEARD, observed, G.HEARD)
        observed = odd("frame_progress", input_end + 50, observed) if i == 1 else observed
        at = began + 0.01 + 0.03 * i
        word = (s % 2 == 0) if i == 0 else F.lit(False)
        groups = closed + odd("groups_lost", F.lit(1), F.lit(0)) + (odd("frame_groups", F.lit(1), F.lit(0)) if i == 1 else 0)
        text = odd("text_not_appended", F.lit("other"), words(closed))
        return {
            "session_id": c("session_id"), "turn_id": c("turn_id"), "step_id": s, "lane": odd("frame_step", F.lit("controller"), F.lit("asr")) if i == 0 else F.lit("asr"), "frame_index": s * 2 + i, "processed_until": processed, "observed_until": observed,
            "groups": groups, "progress_at": at + 0.015, "decoding": F.lit(False), "open_tokens": F.array().cast("array<int>"), "decision": F.when(word, G.WORD).otherwise(G.WAIT), "started_at": odd("frame_time", began + 0.02, at) if i == 1 else at, "completed_at": at + 0.02,
            "spans": odd("frame_spans", F.array(span("synthetic", F.lit(G.HEARD), reason="x")), own_spans) if i == 0 else own_spans,
            "text": odd("text_missing", F.lit(None).cast("string"), text) if i == 1 else text,
            "text_available_at": odd("text_availability", at + 0.018, odd("unchanged_text_moved", text_at + 0.001, text_at)), "text_observed_until": seen,
        }

    made = [frame(0), frame(1)]
    pack = lambda f: F.struct(*[v.alias(k) for k, v in f.items()])
    frames = F.array(*map(pack, made)).cast(G.FRAMES)
    asr = F.struct(*own(), F.lit("asr").alias("lane"), (began + 0.1).alias("completed_at"), odd("receipt_progress", end - 1, end).alias("processed_until"), frames.alias("frames"))
    told = [n.split(":")[0].strip() for n in G.PROGRESS.removeprefix("struct<").removesuffix(">").split(",")]
    progress = [F.struct(*[(odd("progress_callback", v + 5, v) if k == "groups" and i == 0 else v).alias(k) for k, v in ((k, f[k]) for k in told)]) for i, f in enumerate(made)]
    first = made[0]
    fields = ["session_id", "turn_id", "step_id", "frame_index", "processed_until", "observed_until", "groups", "text"]
    row = F.struct(*[first[k].alias(k) for k in fields], F.when(closed == 1, "w1").otherwise(F.concat(F.lit(" w"), closed)).alias("delta"), F.lit(G.SOURCE).alias("source"), text_at.alias("text_available_at"), seen.alias("text_observed_until"))
    none = F.array().cast(f"array<{G.CLOSED}>")
    texts = odd("too_many_texts", F.array(row, row, row).cast(f"array<{G.CLOSED}>"), odd("text_callback", none, F.when(s % 2 == 0, F.array(row).cast(f"array<{G.CLOSED}>")).otherwise(none)))
    steps_told = odd("frame_count", F.array(progress[0]), F.array(*progress)).cast(f"array<{G.PROGRESS}>")
    said = state.withField("token", odd("state_callback", F.lit("user_idle"), odd("invalid_state", F.lit("user_odd"), token)))
    # made as one value: the guards read it, where the optimizer would else write its expressions into each of them
    made_whole = F.struct(
        "session_id", "turn_id", s.alias("step_id"), odd("source_range", start + 1, start).alias("source_start"), end.alias("source_end"), input_end.alias("input_end"), final.alias("input_eof"),
        odd("invalid_time", F.lit(-1.0), odd("started_before_ready", began + 0.001, began - 0.01)).alias("input_ready_at"), began.alias("started_at"), odd("published_early", began + 0.05, began + 0.12).alias("published_at"),
        control.cast(G.CONTROL).alias("control"), odd("lane_missing", F.lit(None).cast(G.ASR), asr.cast(G.ASR)).alias("asr"), F.struct(said.cast(G.STATE).alias("state"), steps_told.alias("progress"), texts.alias("text")).alias("staged"),
    )
    return G.exploded(steps.select(*keep, F.array(made_whole).alias("made")), "made", "batch", *keep).select(*keep, "batch.*")


_TURNS = f"""
e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1) AS n FROM events),
f(pos, fault, hit, labels) AS (VALUES {", ".join(f"({k}, '{name}', {at}, [{', '.join(repr(x) for x in labels)}])" for k, (name, (at, labels)) in enumerate(SPOILT.items()))}),
t AS (SELECT 's' || user_id AS session_id, 't' || (n // {STEPS}) AS turn_id, n % {STEPS} AS step, max(n % {STEPS}) OVER (PARTITION BY user_id, n // {STEPS}) AS last, (user_id * 7 + n // {STEPS}) % {len(SPOILT) + 1} AS pos FROM e),
u AS (SELECT t.*, fault, hit, labels FROM t LEFT JOIN f USING (pos))"""


@query("q_joint_guards", f"""
WITH {_TURNS} SELECT session_id, turn_id, step AS step_id, unnest(labels) AS label FROM u WHERE step = hit AND fault IN ({", ".join(map(repr, ALONE))})""")
def q_joint_guards(spark, sf_dir):
    """Guards that joint batches break by themselves: those that were spoilt, and no others."""
    return G.violations(batches(turns(spark, sf_dir)))


def calls(spark, sf_dir) -> DataFrame:
    """The calls of all turns: an opening, the batches, a close and a release, and the faults that lie in their order. Made step by step, so that a turn's calls stay where its steps are."""
    s, first = F.col("step_id"), F.col("step_id") == 0
    is_ = lambda name: F.col("fault").eqNullSafe(F.lit(name))
    call = lambda seq, kind, reason=None, payload=None: F.struct(
        (F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(reason).cast("string").alias("reason"), (F.lit(None) if payload is None else payload).cast("string").alias("payload"))
    made = [
        F.when(first & ~is_("unknown_turn"), call(-4, "open")), F.when(first & is_("opened_twice"), call(-3, "open")), F.when(first & is_("closed_without_reason"), call(-2, "close", "")), F.when(first & is_("released_active"), call(-1, "release")),
        call(s * 2, "batch", payload=F.col("payload")), F.when(is_("closed_turn") & (s == 3), call(5, "close", "early")), F.when(first, call(2 * STEPS, "close", "done")), F.when(first, call(2 * STEPS + 1, "release")),
    ]
    rows = context.with_payload(batches(turns(spark, sf_dir), "fault"))
    return G.exploded(rows.withColumn("calls", F.array_compact(F.array(*made))), "calls", "c", "session_id", "turn_id").select("session_id", "turn_id", "c.*")


@query("q_context_states", f"""
WITH {_TURNS}, o AS (SELECT * FROM u WHERE step = 0),
g AS (SELECT *, CASE WHEN fault = 'unknown_turn' THEN ['unknown_turn'] WHEN fault = 'closed_turn' AND step >= 3 THEN ['closed_turn'] WHEN step = hit AND fault NOT IN ('opened_twice', 'closed_without_reason', 'released_active') THEN labels
    WHEN step > hit AND fault NOT IN ('opened_twice', 'closed_without_reason', 'released_active') THEN CASE WHEN fault IN ({", ".join(map(repr, ALONE + ["moved_back", "groups_lost", "text_not_appended", "text_availability", "unchanged_text_moved", "text_callback", "published_early"]))}) THEN ['out_of_step'] END END AS broken FROM u),
p AS (SELECT session_id, turn_id, step, step // 2 + 1 AS k, CASE WHEN step = {STEPS - 1} THEN step * 2560 + 1500 ELSE step * 2560 + 2560 END AS ended FROM g WHERE broken IS NULL),
c AS (SELECT session_id, turn_id, -4 AS seq, 'open' AS kind, NULL AS label FROM o WHERE fault IS DISTINCT FROM 'unknown_turn' UNION ALL SELECT session_id, turn_id, -3, 'open', 'opened_twice' FROM o WHERE fault = 'opened_twice'
  UNION ALL SELECT session_id, turn_id, -2, 'close', 'closed_without_reason' FROM o WHERE fault = 'closed_without_reason' UNION ALL SELECT session_id, turn_id, -1, 'release', 'released_active' FROM o WHERE fault = 'released_active'
  UNION ALL SELECT session_id, turn_id, 5, 'close', NULL FROM u WHERE fault = 'closed_turn' AND step = 3 UNION ALL SELECT session_id, turn_id, 2 * step, 'batch', unnest(broken) FROM g WHERE broken IS NOT NULL
  UNION ALL SELECT session_id, turn_id, {2 * STEPS}, 'close', CASE WHEN fault = 'unknown_turn' THEN 'unknown_turn' END FROM o UNION ALL SELECT session_id, turn_id, {2 * STEPS + 1}, 'release', CASE WHEN fault = 'unknown_turn' THEN 'unknown_turn' END FROM o)
SELECT session_id, turn_id, seq::BIGINT AS seq, kind, label, NULL::BIGINT AS step_id, NULL AS text, NULL::BIGINT AS groups, NULL AS token, NULL::BOOLEAN AS accepted, NULL::BIGINT AS processed_until, NULL::BIGINT AS observed_until, NULL::BIGINT AS asr_processed_until,
  NULL::DOUBLE AS text_available_at, NULL::DOUBLE AS text_published_at, NULL::DOUBLE AS published_at FROM c
UNION ALL SELECT session_id, turn_id, 2 * step, 'batch', NULL, step, array_to_string(list_transform(range(1, k + 1), lambda x: 'w' || x), ' '), k, CASE WHEN step = {STEPS - 1} THEN 'user_complete' ELSE 'user_nonidle' END, true, ended,
  CASE WHEN step = {STEPS - 1} THEN ended ELSE ended + 640 END, ended, round(1.0::DOUBLE + (k - 1) * 2 * 0.16::DOUBLE + 0.02::DOUBLE, 9), CASE WHEN step % 2 = 0 THEN round(1.0::DOUBLE + step * 0.16::DOUBLE + 0.12::DOUBLE, 9) END, round(1.0::DOUBLE + step * 0.16::DOUBLE + 0.12::DOUBLE, 9) FROM p""")
def q_context_states(spark, sf_dir):
    """What becomes of each call: the state that readers see after a batch that took effect, the label of one that did not. A spoilt batch leaves the state, so those after it are out of step."""
    out = context.context_batch(calls(spark, sf_dir), dealt=True)
    return out.withColumns({x: F.round(x, 9) for x in ("text_available_at", "text_published_at", "published_at")})
