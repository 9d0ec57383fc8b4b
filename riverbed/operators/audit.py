"""Audit of recorded two-lane traces: a row (case_id, step_id, label) for each rule that a step breaks.

One row a step: case_id, step_id, released_at, read_at, pcm_bytes, control{started_at, completed_at, state_token, state_available_at},
asr{completed_at, frames[{frame_index, decision, tokens, text, groups, started_at}]}, snapshot{step_id, text, groups, state_token,
state_available_at, state_published_at, state_observed_until, asr_processed_until, published_at, source, open_tokens, decoding}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.metrics import distribution, gate
from riverbed.operators.sequence import dealt

# Decisions and control tokens of the recogniser (and, below, the labels of the rules).
WORD, WAIT, EOS, CONTROL = 33, 32, 2, (1, 2, 32, 33)
MOST_PCM = 4 << 20

TRACE = """case_id string, step_id long, released_at double, read_at double, pcm_bytes long,
control struct<started_at: double, completed_at: double, state_token: string, state_available_at: double>,
asr struct<completed_at: double, frames: array<struct<frame_index: long, decision: int, tokens: array<int>, text: string, groups: long, started_at: double>>>,
snapshot struct<step_id: long, text: string, groups: long, state_token: string, state_available_at: double, state_published_at: double, state_observed_until: long,
asr_processed_until: long, published_at: double, source: string, open_tokens: array<int>, decoding: boolean>"""


def closed_group(tokens: Column) -> Column:
    """A word group: at least two tokens, WORD first, EOS last, no control token between."""
    inner = F.exists(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda t: t.isin(*CONTROL))
    return F.when(F.size(tokens) < 2, F.lit(False)).otherwise((F.get(tokens, F.lit(0)) == WORD) & (F.element_at(tokens, -1) == EOS) & ~inner)


def _broken(c: Column) -> Column:
    """A comparison with a missing value counts as broken."""
    return F.coalesce(c, F.lit(True))


def audit(rows: DataFrame, dual: bool = True, source: str | None = None) -> DataFrame:
    """Violations of the rules of a trace; dual: with the recogniser's lane and the joint snapshot."""
    by_step = Window.partitionBy("case_id").orderBy("step_id")
    told = dealt(rows, ["case_id"], rows.count()).withColumn("position", F.row_number().over(by_step) - 1).withColumn("last_release", F.coalesce(F.lag("released_at").over(by_step), F.lit(0.0)))
    rules = {
        "controller_sequence": _broken((F.col("step_id") != F.col("position")) | (F.col("control.started_at") < F.col("last_release"))),
        "release_before_controller": _broken(F.col("control.completed_at") > F.col("released_at")),
        "pcm_overload": F.coalesce(F.col("pcm_bytes"), F.lit(0)) > MOST_PCM,
    }
    if not dual:
        return gate(told, ["case_id", "step_id"], rules).withColumnRenamed("failure", "label")
    # frames stay in their step's row: what came before the first of them, and what the last ends with, is carried from step to step, so the rows are shuffled once and joined with nothing
    frames = F.coalesce(F.col("asr.frames"), F.array().cast(rows.select("asr.frames").schema[0].dataType))
    before, carried = by_step.rowsBetween(Window.unboundedPreceding, -1), by_step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = lambda xs: F.when(F.exists(xs, lambda x: x["decision"].isNotNull()), F.size(F.filter(xs, lambda x: x["decision"] == WORD)).cast("long"))
    s = told.withColumn("frames", frames).withColumn("words", words(F.col("frames"))).withColumn("end", F.when(F.size("frames") > 0, F.struct(F.element_at("frames", -1)["text"].alias("text"))))
    s = s.withColumn("before_text", F.coalesce(F.last("end", True).over(before)["text"], F.lit(""))).withColumn("before_words", F.sum("words").over(before))
    s = s.withColumns({
        "end_text": F.coalesce(F.last("end.text", True).over(carried), F.lit("")), "end_groups": F.coalesce(F.sum("words").over(carried), F.lit(0)),
    })

    def frame_labels(x: Column, i: Column) -> Column:
        so_far = words(F.slice("frames", 1, i + 1))
        closed = F.when(so_far.isNull(), F.col("before_words")).otherwise(so_far + F.coalesce("before_words", F.lit(0)))
        text = F.when(i == 0, F.col("before_text")).otherwise(F.coalesce(F.get("frames", i - 1)["text"], F.lit("")))
        word, wait = x["decision"] == WORD, x["decision"] == WAIT
        frame_rules = {
            "asr_frame_index": _broken(x["frame_index"] != F.col("position") * 2 + i),
            "invalid_eos": word & ~F.coalesce(closed_group(x["tokens"]), F.lit(False)),
            "invalid_wait": _broken(~word & ~(wait & (x["tokens"] == F.array(F.lit(WAIT))))),
            "text_or_group_integrity": _broken((x["groups"] != closed) | ~x["text"].startswith(text)),
            "wait_changed_text": wait & _broken(x["text"] != text),
        }
        return F.array(*[F.when(c, F.lit(k)) for k, c in frame_rules.items()])

    done, published, snap = F.greatest("control.completed_at", "asr.completed_at"), F.col("snapshot.published_at"), F.col("snapshot")
    joint = (
        (snap["step_id"] == F.col("position")) & (snap["text"] == F.col("end_text")) & (snap["groups"] == F.col("end_groups")) & snap["state_token"].eqNullSafe(F.col("control.state_token"))
        & snap["state_available_at"].eqNullSafe(F.col("control.state_available_at")) & (snap["state_published_at"] == published) & (snap["asr_processed_until"] >= snap["state_observed_until"])
        & (F.size(F.coalesce(snap["open_tokens"], F.array().cast("array<int>"))) == 0) & ~F.coalesce(snap["decoding"], F.lit(False))
    )
    joint = joint & (snap["source"] == source) if source is not None else joint
    late = F.exists("asr.frames", lambda x: x["started_at"] < F.col("last_release"))
    rules |= {
        "asr_sequence": _broken((F.size("asr.frames") < 1) | late),
        "publication_order": _broken(~((done <= published) & (published <= F.col("released_at")) & (F.col("released_at") <= F.col("read_at")))),
        "invalid_joint_snapshot": _broken(~joint),
    }
    labels = F.concat(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), F.flatten(F.transform("frames", frame_labels)))
    return s.select("case_id", "step_id", F.array_compact(labels).alias("labels")).select("case_id", "step_id", F.explode_outer("labels").alias("label")).filter("label is not null")


def incomplete_cases(rows: DataFrame, planned: DataFrame, batch: int = 2560) -> DataFrame:
    """(case_id, frames, expected_frames) of planned cases (case_id, real_samples, passed) that failed or whose rows do not cover their samples."""
    n = rows.groupBy("case_id").agg(F.count("*").alias("frames"))
    both = planned.join(n, "case_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0))).withColumn("expected_frames", F.floor((F.col("real_samples") + batch - 1) / batch))
    return both.filter(~F.coalesce("passed", F.lit(False)) | (F.col("frames") != F.col("expected_frames"))).select("case_id", "frames", "expected_frames")


def lag_summary(rows: DataFrame, lag: Column) -> DataFrame:
    """Distribution of a lag by case, of all steps and of those after the first."""
    told = rows.select("case_id", "step_id", lag.alias("lag"))
    named = lambda prefix, x: [c.alias(f"{prefix}_{n}") for c, n in zip(distribution(x), ("n", "p50", "p95", "max"))]
    return told.groupBy("case_id").agg(*named("all", F.col("lag")), *named("stable", F.when(F.col("step_id") > 0, F.col("lag"))))
