"""Literal corpora and traces, each valid but for one change, one instance for each order: a rule engine's relations, and what it must say of each.

A variant is a change and the (row, label) pairs that it must give, all of them; the first variant is valid. An order has the variant of its
key modulo their number, so that the relations grow with the table, and what a variant must give is told by a table of literals.
"""

from __future__ import annotations

import copy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.operators import audit as A
from riverbed.operators import targets as T
from riverbed.sources.tables import table

Variant = tuple[str, str, dict, set]


def corpus() -> dict[str, dict[str, dict]]:
    """A branch whose events and decisions break no rule."""
    e = lambda i, at, kind, **x: {"id": i, "at_ms": at, "kind": kind, **x}
    d = lambda i, module, read, finish, seen, fields, **x: {"id": i, "module": module, "read_ms": read, "finish_ms": finish, "seen": seen, "fields": fields, **x}
    events = [
        e("s1", 0, "script"), e("f1", 100, "frontend", raw_state="user_incomplete", ready_ms=90, observed_ms=80, effective_complete=False),
        e("f2", 200, "frontend", raw_state="user_complete", ready_ms=190, observed_ms=180, effective_complete=True), e("c1", 240, "controller", scope="future_control", basis_frontend="f2", intervention="clarification_opportunity", judgment="j"),
        e("t1", 260, "task", task_id="t", state="active"), e("a1", 300, "analysis", task_id="t", basis_frontend="f2", read_ms=270, finished_ms=290, version=1, analysis="why"),
        e("o1", 400, "output", generated="Yes.", response_key="k1", output_id="o", phase="generated", heard_any=False, played=""),
        e("o2", 450, "output", generated="Yes. Done.", response_key="k1", output_id="o", phase="playing", heard_any=True, played="Yes."),
        e("x1", 500, "runtime", runtime="cancel_confirmed", output_id="o", heard_any=True), e("t2", 600, "task", task_id="t", state="completed"),
    ]
    decisions = [
        d("d1", "controller", 210, 220, ["f1", "f2"], ["user_state", "intervention"], user_state="user_complete", intervention="x", scope="future_control", judgment="j"),
        d("d2", "layer1", 250, 350, ["f2"], ["action", "purpose", "text", "response_key"], action="speak", purpose="ordinary", text="Yes.", response_key="k1"),
        d("d3", "layer1", 410, 440, ["f2", "o1"], ["action", "text", "output_id"], action="continue_expression", text=" Done.", output_id="o"),
        d("d4", "layer1", 250, 255, ["f2", "c1"], ["action", "purpose", "text"], action="speak", purpose="clarification", text="What?", scope="future_clarification"),
        d("d5", "layer1", 610, 620, ["f2", "t1", "t2"], ["action"], action="request_thinking"), d("d6", "layer2", 270, 290, ["f2"], ["analysis"], analysis="why", publication="a1"),
        d("d7", "layer1", 210, 215, ["f1"], ["action"], action="wait", prefix_group="g"), d("d8", "layer1", 210, 216, ["f1"], ["action"], action="wait", prefix_group="g"),
    ]
    return {"e": {x["id"]: x for x in events}, "d": {x["id"]: x for x in decisions}}


VALID: Variant = ("e", "f1", {}, set())
#: What a decision may see.
VISIBILITY: list[Variant] = [
    VALID, ("d", "d1", {"seen": ["f1", "f1"]}, {("d1", "duplicate_seen")}), ("d", "d1", {"seen": ["f1", "zz"]}, {("d1", "unknown_event")}), ("d", "d1", {"read_ms": 150}, {("d1", "future_event")}), ("d", "d1", {"seen": ["f1", "s1"]}, {("d1", "script_visible")}),
    ("d", "d5", {"seen": ["t1"]}, {("d5", "no_frontend")}), ("d", "d1", {"read_ms": 310, "finish_ms": 320, "seen": ["f1", "a1"], "scope": None}, {("d1", "analysis_visible")}), ("d", "d1", {"finish_ms": 1}, {("d1", "finished_before_read")}),
    ("e", "f2", {"at_ms": 700}, {(d, "future_event") for d in ("d1", "d2", "d3", "d4", "d5", "d6")}),
]
#: The order of events.
EVENTS: list[Variant] = [
    VALID, ("e", "f1", {"at_ms": -1}, {("f1", "negative_time"), ("f1", "ready_after_published")}), ("e", "f1", {"raw_state": "odd"}, {("f1", "unknown_state")}), ("e", "f1", {"ready_ms": 101}, {("f1", "ready_after_published")}), ("e", "f1", {"observed_ms": 95}, {("f1", "future_audio")}),
    ("e", "f1", {"effective_complete": True}, {("f1", "false_complete")}), ("e", "t2", {"state": "lost"}, {("t2", "unknown_task_state")}), ("e", "t2", {"task_id": "u", "state": "active"}, {("t2", "two_active_tasks")}),
    ("e", "t1", {"state": "failed"}, {("t1", "closed_inactive_task"), ("a1", "analysis_outside_task"), ("t2", "closed_inactive_task")}), ("e", "a1", {"task_id": "u"}, {("a1", "analysis_outside_task")}), ("e", "a1", {"finished_ms": 310}, {("a1", "analysis_times")}),
    ("e", "a1", {"basis_frontend": "zz"}, {("a1", "unknown_basis")}), ("e", "a1", {"basis_frontend": "t1"}, {("a1", "future_basis")}), ("e", "a1", {"version": 2}, {("a1", "analysis_version")}), ("e", "o1", {"phase": "sung"}, {("o1", "unknown_phase")}),
    ("e", "o2", {"heard_any": False}, {("o2", "heard_differs"), ("x1", "cancel_lost_history")}), ("e", "o2", {"played": "No."}, {("o2", "played_not_generated")}), ("e", "o2", {"generated": "No. Done.", "played": "No."}, {("o2", "generated_rewritten")}),
    ("e", "o1", {"played": "Yes. D", "generated": "Yes. Do", "heard_any": True}, {("o2", "played_rewritten")}), ("e", "x1", {"output_id": "p"}, {("x1", "cancelled_without_output")}), ("e", "x1", {"heard_any": False}, {("x1", "cancel_lost_history")}),
    ("e", "x1", {"at_ms": 420, "heard_any": False}, {("x1", "cancelled_output_reused")}), ("e", "c1", {"id": "f1"}, {("f1", "event_repeated")}),
]
#: Where outputs and controls come from.
GENERATION: list[Variant] = [
    VALID, ("d", "d3", {"finish_ms": 460}, {("o2", "no_earlier_target")}), ("d", "d2", {"text": "No."}, {("o1", "no_earlier_target")}), ("e", "o1", {"origin": "fixed_error_prefix"}, {("o1", "fixed_error_is_target")}),
    ("e", "c1", {"judgment": "k"}, {("c1", "no_earlier_judgment")}), ("e", "c1", {"scope": None}, {("c1", "unmarked_control")}), ("d", "d1", {"finish_ms": 241}, {("c1", "no_earlier_judgment")}),
]
#: What a target may be.
TARGETS: list[Variant] = [
    VALID, ("d", "d1", {"fields": ["user_state", "text"]}, {("d1", "foreign_fields")}), ("d", "d1", {"user_state": "asleep"}, {("d1", "unknown_user_state")}), ("d", "d1", {"user_state": None}, {("d1", "silent_uncertainty")}), ("d", "d1", {"scope": None}, {("d1", "intervention_scope")}),
    ("d", "d2", {"action": "sing"}, {("d2", "unknown_action")}), ("d", "d2", {"seen": ["f1"]}, {("d2", "answer_without_complete")}), ("d", "d2", {"seen": ["f2", "o1"]}, {("d2", "answered_again")}), ("d", "d4", {"scope": "other"}, {("d4", "clarification_scope")}),
    ("d", "d4", {"seen": ["f2"]}, {("d4", "clarification_without_control")}), ("d", "d5", {"seen": ["f2", "t1"]}, {("d5", "requested_while_active")}), ("d", "d3", {"seen": ["f2"]}, {("d3", "continued_without_output")}),
    ("d", "d3", {"seen": ["f2", "o1", "x1"]}, {("d3", "continued_cancelled")}), ("d", "d7", {"fields": ["action", "text"]}, {("d7", "internal_text")}), ("d", "d6", {"analysis": ""}, {("d6", "empty_analysis"), ("d6", "other_analysis")}),
    ("d", "d6", {"publication": "f1"}, {("d6", x) for x in ("no_publication", "other_analysis", "other_read_time", "other_basis", "other_finish_time")}), ("d", "d6", {"analysis": "because"}, {("d6", "other_analysis")}),
    ("d", "d6", {"read_ms": 271}, {("d6", "other_read_time")}), ("d", "d6", {"seen": ["f1"]}, {("d6", "other_basis")}), ("d", "d6", {"finish_ms": 291}, {("d6", "other_finish_time")}), ("d", "d5", {"finish_ms": 1}, {("d5", "finished_before_read")}),
    ("d", "d7", {"module": "layer9"}, {("d7", "unknown_module"), ("d7", "foreign_fields")}),
]


def trace() -> list[dict]:
    """Three steps of a two-lane trace that break no rule."""
    rows, text, groups = [], "", 0
    for k in range(3):
        frames = []
        for offset in range(2):
            word = (k + offset) % 2 == 0
            groups += word
            text += f" w{groups}" if word else ""
            frames.append({"frame_index": 2 * k + offset, "decision": A.WORD if word else A.WAIT, "tokens": [A.WORD, 700 + k, A.EOS] if word else [A.WAIT], "text": text, "groups": groups, "started_at": k + 0.1 + 0.1 * offset})
        rows.append({
            "step_id": k, "released_at": k + 0.8, "read_at": k + 0.9, "pcm_bytes": 10, "control": {"started_at": k + 0.1, "completed_at": k + 0.4, "state_token": "idle", "state_available_at": k + 0.3}, "asr": {"completed_at": k + 0.5, "frames": frames},
            "snapshot": {"step_id": k, "text": text, "groups": groups, "state_token": "idle", "state_available_at": k + 0.3, "state_published_at": k + 0.6, "state_observed_until": 100 * k, "asr_processed_until": 100 * k, "published_at": k + 0.6, "source": "s", "open_tokens": [], "decoding": False},
        })
    return rows


#: Changes of the second step of a trace: path, value, and what they must give.
TRACE: list[tuple[tuple, object, set]] = [
    ((), None, set()), (("control", "started_at"), 0.5, {(1, "controller_sequence")}), (("control", "completed_at"), 1.9, {(1, "release_before_controller"), (1, "publication_order")}), (("pcm_bytes",), A.MOST_PCM + 1, {(1, "pcm_overload")}),
    (("asr", "frames", 0, "started_at"), 0.7, {(1, "asr_sequence")}), (("asr", "frames", 1, "frame_index"), 9, {(1, "asr_frame_index")}), (("asr", "frames", 1, "tokens"), [33, 2, 5, 2], {(1, "invalid_eos")}), (("asr", "frames", 0, "tokens"), [32, 32], {(1, "invalid_wait")}),
    (("asr", "frames", 1, "groups"), 5, {(1, "text_or_group_integrity")}), (("snapshot", "published_at"), 1.95, {(1, "publication_order"), (1, "invalid_joint_snapshot")}),
    (("snapshot", "text"), "x", {(1, "invalid_joint_snapshot")}), (("snapshot", "decoding"), True, {(1, "invalid_joint_snapshot")}), (("snapshot", "open_tokens"), [1], {(1, "invalid_joint_snapshot")}), (("snapshot", "source"), "t", {(1, "invalid_joint_snapshot")}),
    (("snapshot", "asr_processed_until"), 1, {(1, "invalid_joint_snapshot")}), (("asr", "frames", 0, "text"), " w1 more", {(1, "wait_changed_text"), (1, "text_or_group_integrity")}), (("read_at",), 1.0, {(1, "publication_order")}),
]


def changed(rows: list[dict], path: tuple, value: object) -> list[dict]:
    rows = copy.deepcopy(rows)
    if path:
        at = rows[1]
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
    return rows


def _rows(spark: SparkSession, schema: str, variants: list[list[dict]]) -> DataFrame:
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, rows in enumerate(variants) for r in rows], f"variant int, {schema}")


def instances(spark: SparkSession, sf_dir: str, literals: DataFrame, n: int, **keys: str) -> DataFrame:
    """The rows of its variant for each order; keys names columns and the prefix that the order's key gets in them. Only literals, a bounded table, are broadcast."""
    orders = table(spark, sf_dir, "orders", "o_orderkey").withColumn("variant", (F.col("o_orderkey") % n).cast("int"))
    got = orders.join(F.broadcast(literals), "variant")
    return got.withColumns({c: F.concat(F.lit(prefix), F.col("o_orderkey")) for c, prefix in keys.items()}).drop("variant", "o_orderkey")


def corpora(spark: SparkSession, sf_dir: str, variants: list[Variant]) -> tuple[DataFrame, DataFrame]:
    """Events and decisions, a branch for each order."""
    made: dict[str, list[list[dict]]] = {"e": [], "d": []}
    for which, i, change, _ in variants:
        c = corpus()
        c[which][i] |= change
        for k in made:
            made[k].append(list(c[k].values()))
    give = lambda k, schema: instances(spark, sf_dir, _rows(spark, schema, made[k]), len(variants), source_id="s", branch_id="b").select(spark.createDataFrame([], schema).columns)
    return give("e", T.EVENTS), give("d", T.DECISIONS)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of three steps for each order."""
    made = [changed(trace(), path, value) for path, value, _ in TRACE]
    return instances(spark, sf_dir, _rows(spark, A.TRACE, made), len(TRACE), case_id="c")


def told(variants: list[Variant]) -> str:
    """SQL: what the variants of all orders must give."""
    rows = ", ".join(f"({k}, '{i}', '{label}')" for k, v in enumerate(variants) for i, label in sorted(v[3]))
    return f"SELECT 's' || o_orderkey AS source_id, 'b' || o_orderkey AS branch_id, id, label FROM orders JOIN (VALUES {rows}) v(variant, id, label) ON o_orderkey % {len(variants)} = variant"
