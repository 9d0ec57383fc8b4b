"""One valid trace, one mutation for each rule."""

import copy

import pytest
from pyspark.sql import functions as F

from riverbed.operators import audit as A
from riverbed.operators import history as H


def trace():
    rows, text, groups = [], "", 0
    for k in range(3):
        frames = []
        for offset in range(2):
            word = (k + offset) % 2 == 0
            groups += word
            text += f" w{groups}" if word else ""
            frames.append({"frame_index": 2 * k + offset, "decision": 33 if word else 32, "tokens": [33, 700 + k, 2] if word else [32], "text": text, "groups": groups, "started_at": k + 0.1 + 0.1 * offset})
        rows.append({
            "case_id": "c", "step_id": k, "released_at": k + 0.8, "read_at": k + 0.9, "pcm_bytes": 10,
            "control": {"started_at": k + 0.1, "completed_at": k + 0.4, "state_token": "idle", "state_available_at": k + 0.3}, "asr": {"completed_at": k + 0.5, "frames": frames},
            "snapshot": {"step_id": k, "text": text, "groups": groups, "state_token": "idle", "state_available_at": k + 0.3, "state_published_at": k + 0.6, "state_observed_until": 100 * k,
                         "asr_processed_until": 100 * k, "published_at": k + 0.6, "source": "s", "open_tokens": [], "decoding": False},
        })
    return rows


def labels(spark, rows, **how):
    return {(r["step_id"], r["label"]) for r in A.audit(spark.createDataFrame(rows, A.TRACE), source="s", **how).collect()}


def test_valid_trace(spark):
    assert labels(spark, trace()) == set() == labels(spark, trace(), dual=False)


@pytest.mark.parametrize(
    ("path", "value", "label"),
    [
        (("step_id",), 7, "controller_sequence"), (("control", "started_at"), 0.5, "controller_sequence"), (("control", "completed_at"), 1.9, "release_before_controller"),
        (("pcm_bytes",), (4 << 20) + 1, "pcm_overload"), (("asr", "frames"), [], "asr_sequence"), (("asr", "frames", 0, "started_at"), 0.7, "asr_sequence"),
        (("asr", "frames", 1, "frame_index"), 9, "asr_frame_index"), (("asr", "frames", 1, "tokens"), [33, 2, 5, 2], "invalid_eos"), (("asr", "frames", 1, "tokens"), [33], "invalid_eos"),
        (("asr", "frames", 0, "tokens"), [32, 32], "invalid_wait"), (("asr", "frames", 0, "decision"), 5, "invalid_wait"), (("asr", "frames", 1, "text"), "other", "text_or_group_integrity"),
        (("asr", "frames", 1, "groups"), 5, "text_or_group_integrity"), (("asr", "frames", 0, "text"), " w1 more", "wait_changed_text"), (("snapshot", "published_at"), 1.95, "publication_order"),
        (("snapshot", "published_at"), None, "publication_order"), (("snapshot", "text"), "x", "invalid_joint_snapshot"), (("snapshot", "decoding"), True, "invalid_joint_snapshot"),
        (("snapshot", "open_tokens"), [1], "invalid_joint_snapshot"), (("snapshot", "source"), "t", "invalid_joint_snapshot"), (("snapshot", "asr_processed_until"), 1, "invalid_joint_snapshot"),
    ],
)
def test_mutations(spark, path, value, label):
    rows = copy.deepcopy(trace())
    at = rows[1]
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    assert label in {x for _, x in labels(spark, rows)}


def test_cases_and_lags(spark):
    rows = spark.createDataFrame(trace(), A.TRACE)
    plan = spark.createDataFrame([("c", 3 * 2560 - 1, True), ("d", 1, True), ("e", 0, False)], "case_id string, real_samples long, passed boolean")
    assert {r["case_id"] for r in A.incomplete_cases(rows, plan).collect()} == {"d", "e"}
    r = A.lag_summary(rows, F.col("read_at") - F.col("step_id")).first()
    assert (r["all_n"], r["stable_n"]) == (3, 2)


def test_history(spark):
    ledger = spark.createDataFrame([("r", 0, 320), ("r", 320, 100)], "request_id string, start_sample long, samples long")
    segments = spark.createDataFrame([("r", 0, "One.", 300), ("r", 1, "Two.", 300), ("q", 0, "None.", 5)], "request_id string, pos int, text string, samples long")
    assert {tuple(r) for r in H.played(ledger, segments).select("request_id", "committed_text", "committed", "tail").collect()} == {("r", "One.", 300, 120), ("q", "", 0, 0)}
    turns = [("c", 0, "user", "a", None, None), ("c", 1, "assistant", "unheard", True, 0), ("c", 2, "user", "b", None, None), ("c", 3, "assistant", "heard", True, 5), ("c", 4, "user", "  ", None, None)]
    out = H.history(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string, cancelled boolean, played_samples long")).orderBy("run").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "a b"), ("assistant", "heard")]
    now = spark.createDataFrame([("r", 2, "old"), ("q", 1, "kept")], "request_id string, version int, text string")
    late = spark.createDataFrame([("r", 2, "new"), ("q", 0, "stale")], "request_id string, version int, text string")
    assert {tuple(r) for r in H.repair(now, late).select("request_id", "text").collect()} == {("r", "new"), ("q", "kept")}
    use = spark.createDataFrame([("c", 5, 9), ("c", 7, 1)], "condition string, gpu long, rss long")
    assert [tuple(r) for r in H.resource_stops(use, {"gpu": 6, "rss": 9}).collect()] == [("c", "gpu", 7, 6)]
