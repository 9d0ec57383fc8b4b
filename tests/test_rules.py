"""Rule-sets of corpora and runs: a valid fixture, and one mutation for each rule."""

import pytest
from pyspark.sql import functions as F

from riverbed.functions import scalars as C
from riverbed.operators import joins as J
from riverbed.operators import runs as R
from riverbed.operators import targets as T
from riverbed.operators import text as X
from riverbed.sources import traces


def frame(spark, schema, rows):
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def corpus():
    e = lambda i, at, kind, **x: {"source_id": "s", "branch_id": "b", "id": i, "at_ms": at, "kind": kind, **x}
    d = lambda i, module, read, finish, seen, **x: {"source_id": "s", "branch_id": "b", "id": i, "module": module, "read_ms": read, "finish_ms": finish, "seen": seen, **x}
    out = dict(output_id="o", phase="generated", heard_any=False, played="")
    events = [
        e("f1", 100, "frontend", raw_state="user_incomplete", ready_ms=90, observed_ms=80, effective_complete=False),
        e("f2", 200, "frontend", raw_state="user_complete", ready_ms=190, observed_ms=180, effective_complete=True),
        e("c1", 240, "controller", scope="future_control", basis_frontend="f2", intervention="clarification_opportunity", judgment="j"),
        e("t1", 260, "task", task_id="t", state="active"),
        e("a1", 300, "analysis", task_id="t", basis_frontend="f2", read_ms=270, finished_ms=290, version=1, analysis="why"),
        e("o1", 400, "output", generated="Yes.", response_key="k1", **out),
        e("o2", 450, "output", generated="Yes. Done.", response_key="k1", output_id="o", phase="playing", heard_any=True, played="Yes."),
        e("x1", 500, "runtime", runtime="cancel_confirmed", output_id="o", heard_any=True),
        e("t2", 600, "task", task_id="t", state="completed"),
    ]
    decisions = [
        d("d1", "controller", 210, 220, ["f1", "f2"], fields=["user_state", "intervention"], user_state="user_complete", intervention="x", scope="future_control", judgment="j"),
        d("d2", "layer1", 250, 350, ["f2"], fields=["action", "purpose", "text", "response_key"], action="speak", purpose="ordinary", text="Yes.", response_key="k1"),
        d("d3", "layer1", 410, 440, ["f2", "o1"], fields=["action", "text", "output_id"], action="continue_expression", text=" Done.", output_id="o"),
        d("d4", "layer1", 250, 255, ["f2", "c1"], fields=["action", "purpose", "text"], action="speak", purpose="clarification", text="What?", scope="future_clarification"),
        d("d5", "layer1", 610, 620, ["f2", "t1", "t2"], fields=["action"], action="request_thinking"),
        d("d6", "layer2", 270, 290, ["f2"], fields=["analysis"], analysis="why", publication="a1"),
        d("d7", "layer1", 210, 215, ["f1"], fields=["action"], action="wait", prefix_group="g"),
        d("d8", "layer1", 210, 216, ["f1"], fields=["action"], action="wait", prefix_group="g"),
    ]
    return {"e": {x["id"]: x for x in events}, "d": {x["id"]: x for x in decisions}}


def found(spark, c):
    e, d = frame(spark, T.EVENTS, c["e"].values()), frame(spark, T.DECISIONS, c["d"].values())
    return {(r["id"], r["label"]) for r in T.target_legality(d, e).unionByName(T.event_rules(e)).unionByName(T.generation_rules(d, e)).collect()}


def test_valid_corpus(spark):
    assert found(spark, corpus()) == set()


MUTATIONS = [
    ("d", "d1", {"fields": ["user_state", "text"]}, "foreign_fields"), ("d", "d1", {"user_state": "asleep"}, "unknown_user_state"), ("d", "d1", {"user_state": None}, "silent_uncertainty"),
    ("d", "d1", {"scope": None}, "intervention_scope"), ("d", "d2", {"action": "sing"}, "unknown_action"), ("d", "d2", {"seen": ["f1"]}, "answer_without_complete"), ("d", "d2", {"seen": ["f2", "o1"]}, "answered_again"),
    ("d", "d4", {"scope": "other"}, "clarification_scope"), ("d", "d4", {"seen": ["f2"]}, "clarification_without_control"), ("d", "d5", {"seen": ["f2", "t1"]}, "requested_while_active"),
    ("d", "d3", {"seen": ["f2"]}, "continued_without_output"), ("d", "d3", {"seen": ["f2", "o1", "x1"]}, "continued_cancelled"), ("d", "d7", {"fields": ["action", "text"]}, "internal_text"),
    ("d", "d6", {"analysis": ""}, "empty_analysis"), ("d", "d6", {"publication": "f1"}, "no_publication"), ("d", "d6", {"analysis": "because"}, "other_analysis"), ("d", "d6", {"read_ms": 271}, "other_read_time"),
    ("d", "d6", {"seen": ["f1"]}, "other_basis"), ("d", "d6", {"finish_ms": 291}, "other_finish_time"), ("d", "d5", {"finish_ms": 1}, "finished_before_read"), ("d", "d7", {"module": "layer9"}, "unknown_module"),
    ("e", "f1", {"at_ms": -1}, "negative_time"), ("e", "f1", {"raw_state": "odd"}, "unknown_state"), ("e", "f1", {"ready_ms": 101}, "ready_after_published"), ("e", "f1", {"observed_ms": 95}, "future_audio"),
    ("e", "f1", {"effective_complete": True}, "false_complete"), ("e", "t2", {"state": "lost"}, "unknown_task_state"), ("e", "t2", {"task_id": "u", "state": "active"}, "two_active_tasks"),
    ("e", "t1", {"state": "failed"}, "closed_inactive_task"), ("e", "a1", {"task_id": "u"}, "analysis_outside_task"), ("e", "a1", {"finished_ms": 310}, "analysis_times"), ("e", "a1", {"basis_frontend": "zz"}, "unknown_basis"),
    ("e", "a1", {"basis_frontend": "t1"}, "future_basis"), ("e", "a1", {"version": 2}, "analysis_version"), ("e", "o1", {"phase": "sung"}, "unknown_phase"), ("e", "o2", {"heard_any": False}, "heard_differs"),
    ("e", "o2", {"played": "No."}, "played_not_generated"), ("e", "o2", {"generated": "No. Done."}, "generated_rewritten"), ("e", "o1", {"played": "Yes. D", "generated": "Yes. Do"}, "played_rewritten"),
    ("e", "x1", {"output_id": "p"}, "cancelled_without_output"), ("e", "x1", {"heard_any": False}, "cancel_lost_history"), ("e", "x1", {"at_ms": 420}, "cancelled_output_reused"),
    ("d", "d3", {"finish_ms": 460}, "no_earlier_target"), ("d", "d2", {"text": "No."}, "no_earlier_target"), ("e", "o1", {"origin": "fixed_error_prefix"}, "fixed_error_is_target"),
    ("e", "c1", {"judgment": "k"}, "no_earlier_judgment"), ("e", "c1", {"scope": None}, "unmarked_control"),
]


def test_mutations(spark):
    """All mutations at once, each in a branch of its own."""
    events, decisions = [], []
    for k, (which, i, change, _) in enumerate(MUTATIONS):
        c = corpus()
        c[which][i].update(change)
        events += [x | {"branch_id": str(k)} for x in c["e"].values()]
        decisions += [x | {"branch_id": str(k)} for x in c["d"].values()]
    e, d = frame(spark, T.EVENTS, events), frame(spark, T.DECISIONS, decisions)
    got = {(int(r["branch_id"]), r["label"]) for r in T.target_legality(d, e).unionByName(T.event_rules(e)).unionByName(T.generation_rules(d, e)).collect()}
    missed = [m for k, m in enumerate(MUTATIONS) if (k, m[3]) not in got]
    assert not missed


def test_repeated_events_and_hidden_tasks(spark):
    """A bad close hides no later pair of active tasks, and an active task cannot become active again."""
    c = corpus()["e"]
    task = lambda i, at, name, state: c["t1"] | {"id": i, "at_ms": at, "task_id": name, "state": state}
    rows = [*(c[k] for k in c if k not in ("t1", "t2", "a1")), task("t1", 250, "t", "completed"), task("t2", 260, "t", "active"), task("t3", 270, "u", "active"), task("t4", 280, "u", "failed"), task("t5", 290, "t", "active")]
    got = {(r["id"], r["label"]) for r in T.event_rules(frame(spark, T.EVENTS, rows)).collect()}
    assert got == {("t1", "closed_inactive_task"), ("t3", "two_active_tasks"), ("t5", "two_active_tasks")}
    assert ("f1", "event_repeated") in {(r["id"], r["label"]) for r in T.event_rules(frame(spark, T.EVENTS, [*c.values(), c["f1"]])).collect()}


def test_shape(spark):
    schema = "source_id string, branch_id string, split string, schema_version string, coverage array<string>"
    good = [("a", "1", "pilot", "v1", ["x"]), ("b", "1", "pilot", "v1", ["y"])]
    d = frame(spark, T.DECISIONS, corpus()["d"].values())
    labels = lambda rows, dd=d: {(r["label"], r["detail"]) for r in T.shape_rules(spark.createDataFrame(rows, schema), dd, "v1", 2, ["x", "y"]).collect()}
    assert labels(good) == set()
    assert labels([*good, ("c", "1", "train", "v2", ["z"]), ("a", "1", "pilot", "v1", [])]) == {("schema_version", "v2"), ("source_count", "3"), ("split", "c"), ("branch_repeated", "1")}
    assert labels(good[:1]) == {("source_count", "1"), ("coverage_missing", "y")}
    c = corpus()["d"]
    c["d8"]["action"] = "request_thinking"
    assert labels(good, frame(spark, T.DECISIONS, c.values())) == {("shared_prefix_conflict", "g")}
    c["d8"]["action"] = "wait"
    assert labels(good, frame(spark, T.DECISIONS, [*c.values(), c["d8"]])) == {("decision_repeated", "d8")}


def test_conditions(spark):
    schema = "condition string, named string, manifest_sha256 string, exit_code int, passed boolean, case_ids array<string>, warmup_passed boolean, rounds int, missing array<boolean>, reset_equal boolean, equivalent boolean"
    good = ("dual", "dual", "m", 0, True, ["a", "b"], True, 2, [False, False], True, True)
    change = lambda k, v, row=good: tuple(v if j == k else x for j, x in enumerate(row))
    labels = lambda row: {r["label"] for r in R.condition_violations(spark.createDataFrame([row], schema), "m", ["a", "b"], "limited").collect()}
    assert labels(good) == set()
    full = {"full_warmup_or_equivalence_missing"}
    for k, v, want in [(1, "x", {"frozen_condition_or_manifest_changed"}), (2, None, {"frozen_condition_or_manifest_changed"}), (3, 1, {"condition_failed"}), (3, None, {"condition_failed"}), (4, False, {"condition_failed"}), (5, ["b", "a"], {"fixed_cases_missing_or_changed"}), (6, None, {"warmup_failed"}), (7, 1, full), (8, [False, True], full), (8, None, full), (9, False, full), (10, None, full)]:
        assert labels(change(k, v)) == want, (k, v)
    assert labels(("limited", "limited", *good[2:7], 1, None, None, None)) == set()


def test_runs(spark):
    cases = [("a", True, 2, 7), ("b", True, 1, 7)]
    steps = [("a", 0, 7, 2, 1, True, 0, "timeout", "x"), ("a", 1, 7, 2, 1, True, 1, "model_complete", ""), ("b", 0, 7, 2, 1, True, 0, "timeout", "")]
    c, s = "case_id string, passed boolean, frames long, thread_id long", "case_id string, step_id long, thread_id long, cpu_threads int, interop_threads int, skip_allowed boolean, skipped int, completion string, text string"
    labels = lambda x, y, n=2: {(r["case_id"], r["label"]) for r in R.run_violations(spark.createDataFrame(x, c), spark.createDataFrame(y, s), n).collect()}
    assert labels(cases, steps) == set()
    assert labels(cases, steps, 3) == {(None, "case_count")}
    assert labels([("a", False, 2, 7), cases[1], cases[1]], steps) == {("a", "case_failed"), ("b", "case_repeated"), (None, "case_count")}
    assert labels(cases, [steps[0], ("a", 2, *steps[1][2:]), steps[2]]) == {("a", "steps_not_dense")}
    assert labels(cases, steps[1:]) == {("a", "steps_not_dense"), ("a", "frames_missing")}
    assert labels(cases, [(*steps[0][:2], 8, 4, *steps[0][4:]), steps[1], (*steps[2][:6], 1, "timeout", "")]) == {("a", "other_thread"), ("a", "thread_budget"), ("b", "skip_policy")}


def test_recordings(spark):
    r = "recording_id string, kind string, synthetic boolean, rate int, channels int, finite boolean, total long, sha256 string, expected_sha256 string, loud array<struct<start:long,stop:long>>"
    f = "recording_id string, start_sample long, samples long, time double"
    good = ("r", "live_monotonic_playback_capture", False, 16000, 1, True, 2000, "d", "d", [(100, 500)])
    frames = [("r", 100, 320, 100 / 16000), ("r", 420, 320, 420 / 16000)]
    labels = lambda x, y: {t["label"] for t in R.recording_violations(spark.createDataFrame([x], r), spark.createDataFrame(y, f)).collect()}
    assert labels(good, frames) == set()
    change = lambda k, v: tuple(v if j == k else x for j, x in enumerate(good))
    for k, v, want in [(7, "e", "digest"), (1, "mixed", "kind"), (2, True, "kind"), (3, 8000, "format"), (5, None, "format"), (6, 700, "beyond_end"), (9, [(100, 800)], "sound_outside_frames"), (9, [(50, 60)], "sound_outside_frames")]:
        assert want in labels(change(k, v), frames), (k, v)
    assert labels(good, [frames[0], ("r", 400, 320, 400 / 16000)]) == {"overlap"}
    assert labels(good, [("r", 100, 400, 100 / 16000)]) == {"frame_size"} and "frame_time" in labels(good, [("r", 100, 320, 0.5), frames[1]])


def test_plans_and_figures(spark):
    planned = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "2")], "controller string, id string")
    actual = spark.createDataFrame([("c", "1", False, "h"), ("c", "3", True, "g")], "controller string, id string, passed boolean, config_sha256 string")
    got = {(r["id"], r["label"]) for r in R.plan_violations(planned, actual, ["controller", "id"], "h").collect()}
    assert got == {("1", "failed"), ("2", "planned_twice"), ("2", "missing"), ("3", "unplanned"), ("3", "other_config")}
    a = spark.createDataFrame([("x", 0.5, 1.25), ("y", 0.5, None)], "subset string, rate double, latency double")
    b = spark.createDataFrame([("x", 0.5 + 1e-12, 1.26), ("y", 0.5, None)], "subset string, rate double, latency double")
    assert [(r["subset"], r["name"]) for r in R.cross_check(a, b, ["subset"], ["rate", "latency"]).collect()] == [("x", "latency")]
    was = spark.createDataFrame([("k", "in", "1"), ("k", "out", "2")], "key string, name string, digest string")
    now = spark.createDataFrame([("k", "in", "1"), ("k", "out", "3"), ("k", "new", "4")], "key string, name string, digest string")
    assert {r["name"] for r in R.stale(was, now, ["key"]).collect()} == {"out", "new"}


def test_sessions_and_warmup(spark):
    s = "session_id string, kv boolean, history boolean, speech boolean, callbacks boolean, buffers array<int>, asr_kv boolean, asr_text boolean, asr_callbacks boolean, asr_counters boolean"
    rows = [("ok", True, True, True, True, [16000, 25600, 51200], True, True, True, True), ("bad", True, None, True, True, [1], True, False, True, True)]
    df = spark.createDataFrame(rows, s)
    assert {(r["session_id"], r["label"]) for r in R.session_violations(df, True).collect()} == {("bad", "history_not_cleared"), ("bad", "asr_text_not_cleared"), ("bad", "buffer_sizes")}
    assert {r["label"] for r in R.session_violations(df, False).collect()} == {"history_not_cleared", "buffer_sizes"}
    w = spark.createDataFrame([("ok", "d", 1, 124800, 0.9, 25600), ("bad", "e", 2, 124801, 0.95, 25599)], "input_id string, sha256 string, channels int, samples long, peak double, silent_tail long")
    assert {(r["input_id"], r["label"]) for r in R.warmup_violations(w, "d").collect()} == {("bad", x) for x in ("digest", "channels", "samples", "level", "tail")}


def test_small_readers(spark, tmp_path):
    (tmp_path / "a.exit_code.txt").write_text("137\n")
    (tmp_path / "b.txt").write_text("killed")
    root = f"file://{tmp_path}"
    assert traces.read_number(spark, f"{root}/a.exit_code.txt") == 137
    assert traces.read_number(spark, f"{root}/b.txt") is None and traces.read_number(spark, f"{root}/none.txt") is None
    assert [(r["position"], r["name"], r["size"]) for r in traces.listing(spark, f"{root}/*.txt").orderBy("position").collect()] == [(0, "a.exit_code.txt", 4), (1, "b.txt", 6)]
    (tmp_path / "condition" / "pause").mkdir(parents=True)
    (tmp_path / "condition" / "pause" / "7.json").write_text('{"a": 1}')
    got = traces.path_keys(spark.read.json(f"{root}/condition/*/*.json"), "([^/]+)/([^/]+)/([^/.]+)[.]json$", ["controller", "subset", "id"]).collect()
    assert [(r["controller"], r["subset"], r["id"]) for r in got] == [("condition", "pause", "7")]


@pytest.mark.parametrize(
    ("text", "limit", "first", "want"),
    [
        ("One two. Three.", 40, 20, ["One two.", "Three."]), ("3.14 is pi! Yes", 40, 20, ["3.14 is pi!", "Yes"]), ("abc def ghi", 5, 5, ["abc", "def", "ghi"]), ("abcdefghij", 4, 4, ["abcd", "efgh", "ij"]),
        ("  \n ", 3, 3, []), ("", 5, 5, []), ("A.  B.", 3, 3, ["A.", "B."]), ("word one two three four. five", 24, 8, ["word one", "two three four.", "five"]),
    ],
)
def test_segments_golden(text, limit, first, want):
    ends = X.segment_ends(text, limit, first)
    assert [s for s in (text[a:b].strip() for a, b in zip([0, *ends], ends)) if s] == want


def test_segments_follow_first_segment(spark):
    df = spark.createDataFrame([(1, "no end yet"), (2, "Done. more"), (3, None), (4, "x" * 50)], "id long, t string")
    rows = {r["id"]: (r["segment"], r["rest_length"]) for r in X.first_segment(df, "t", 20, final=False).collect()}
    assert rows[1] == (None, 10) and rows[2] == ("Done.", 4) and rows[3][0] is None and rows[4] == ("x" * 20, 30)


def test_difference_keeps_missing_entries_with_null(spark):
    a = spark.createDataFrame([(1, "a")], "k long, v string")
    b = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert [(r["k"], r["left_value"], r["right_value"]) for r in J.trace_diff(a, b, ["k"], "v").collect()] == [(2, None, None)]


def test_gain(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.1, -0.1],), ([0.001, 0.9],), ([],)], "s array<double>")
    got = [r[0] for r in df.select(C.gain(F.col("s"))).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 1e-9 and abs(got[2] - 0.05 / (0.9**2 / 2 + 1e-6 / 2) ** 0.5) < 1e-9 and got[3] is None


def test_every_label_has_rows():
    """The variants of corpora and traces give each label of their rule-sets."""
    import inspect
    import re

    from riverbed.operators import audit, causal, targets
    from riverbed.plans import corpora as L

    planted = {label for variants in (L.VISIBILITY, L.EVENTS, L.GENERATION, L.TARGETS) for v in variants for _, label in v[3]}
    source = "".join(inspect.getsource(f) for f in (targets.target_legality, targets.event_rules, targets.generation_rules))
    known = set(re.findall(r'"([a-z_]+)": ', source)) - {"task_state", "times", "versions", "generated_before", "played_before"}
    known |= set(re.findall(r'"([a-z_]+)"\),$', inspect.getsource(causal.visibility), re.M))
    assert known - planted == set()
    labels = set(re.findall(r'"([a-z_]+)": ', inspect.getsource(audit.audit)))
    assert labels - {label for _, _, x in L.TRACE for _, label in x} <= {"end_text", "end_groups"}


def test_reports_and_gates(spark):
    """One row that passes, and one change for each rule; missing values break."""
    r = "run_id string, passed boolean, cases long, expected long, manifest_sha256 string, scope string, warmup_passed boolean, equivalence struct<executed:boolean,status:string,policy:string,passed:boolean>, execution struct<cpu_threads:int,interop_threads:int>, recogniser_cpus int, skip_complete boolean, backends array<struct<cpu_threads:int,interop_threads:int>>"
    good = ["r", True, 30, 30, "m", "fixed", True, (False, "disabled_by_user", "disabled_by_user", None), (2, 1), 2, True, [(2, 1), (2, 1)]]
    labels = lambda row: {x["label"] for x in R.report_violations(spark.createDataFrame([tuple(row)], r), "m").collect()}
    assert labels(good) == set() and labels(["r", True, 3, 3, "m", "smoke", *good[6:]]) == set()
    for k, v, want in [(1, None, "run_failed"), (2, 29, "run_cases"), (4, "n", "run_manifest"), (5, "smoke", "run_scope"), (6, False, "run_warmup"), (7, (False, "disabled_by_user", "disabled_by_user", True), "run_warmup"), (7, None, "run_warmup"), (8, (2, 2), "run_budget"), (9, 1, "run_budget"), (10, False, "run_budget"), (11, [(2, 1), (4, 1)], "backend_budget"), (11, None, "backend_budget")]:
        assert labels([*good[:k], v, *good[k + 1 :]]) == {want}, (k, v)
    g = "gate_id string, condition string, evidence_sha256 string, expected_sha256 string, candidate boolean, resources boolean, dual_passed boolean, cases array<struct<case_id:string,passed:boolean>>, sample_ids array<string>"
    good = ["g", "dual-full", "d", "d", True, True, True, [("a", True), ("b", True)], ["x", "y"]]
    labels = lambda row: {x["label"] for x in R.acceptance_violations(spark.createDataFrame([tuple(row)], g), ["a", "b"], 2).collect()}
    assert labels(good) == set() and labels([*good[:1], "single-full", *good[2:]]) == set()
    for k, v, want in [(1, "dual-limited", "condition_not_full"), (2, None, "evidence_digest"), (4, None, "not_candidate"), (5, False, "resources_not_checked"), (6, None, "dual_failed"), (7, [("b", True), ("a", True)], "preflight_changed"), (7, None, "preflight_changed"), (7, [("a", True), ("b", None)], "preflight_failed"), (8, ["x"], "sample_count"), (8, ["x", "x"], "sample_repeated")]:
        assert labels([*good[:k], v, *good[k + 1 :]]) == {want}, (k, v)
