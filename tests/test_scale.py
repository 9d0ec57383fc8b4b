"""What keeps a query's work in proportion to its tables: how often they are read, what is shuffled, and what runs where."""

import re

from pyspark.sql import functions as F

from riverbed import catalog
from riverbed.operators import audit, causal, lanes, targets, text
from riverbed.operators import joint as G
from riverbed.operators import timing as T
from riverbed.plans import corpora as L
from riverbed.plans import joint as P
from riverbed.plans import lanes as PL
from riverbed.plans import load_all
from riverbed.plans import timing as PT
from riverbed.sources.scratch import Tables

load_all()
SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_calls_read_the_events_once(spark):
    """All calls of a turn come from one reading, and are not shuffled after the batches are made."""
    calls = P.calls(spark, SF)
    assert optimized(calls).collectLeaves().size() == 1
    assert calls.filter("kind = 'batch' and payload like '%failures%' and payload like '%frames%'").isEmpty()


def test_guards_are_no_generator_argument(spark):
    """A generator runs its argument uncompiled: batches and guards are made in a column before."""
    plan = optimized(G.violations(P.batches(P.turns(spark, SF)))).toString()
    assert "explode(" in plan and not re.search(r"explode\((array|filter|array_compact)\(", plan)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_shuffles_once(spark):
    """Steps are dealt by case once, and joined with nothing but the literals that they are made of."""
    plan = executed(audit.audit(L.traces(spark, SF), source="s"))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_audit_of_steps_without_frames(spark):
    """What frames end with is carried over steps without any; a null text or decision is no word."""
    f = lambda k, text, groups, decision=audit.WAIT: {"frame_index": k, "decision": decision, "tokens": [audit.WAIT], "text": text, "groups": groups, "started_at": 9.0}
    rows = [{"case_id": "c", "step_id": k, "released_at": 1.0, "asr": {"completed_at": 1.0, "frames": x}} for k, x in enumerate([[f(0, "", 0), f(1, None, 0, None)], [], None, [f(6, "", 0), f(7, "a", 0)]])]
    got = sorted((r["step_id"], r["label"]) for r in audit.audit(spark.createDataFrame(rows, audit.TRACE)).collect() if r["label"] in ("text_or_group_integrity", "wait_changed_text", "invalid_wait", "asr_frame_index"))
    assert got == [(0, "invalid_wait"), (0, "text_or_group_integrity"), (3, "wait_changed_text")]


def test_visibility_joins_once(spark):
    """Events are met once; all labels come from one count a decision."""
    events, decisions = L.corpora(spark, SF, L.VISIBILITY)
    plan = optimized(causal.visibility(decisions, events.selectExpr("*", "null as text"))).toString()
    assert plan.count("Join LeftOuter") == 1 and "LeftAnti" not in plan


def test_targets_join_once(spark):
    events, decisions = L.corpora(spark, SF, L.TARGETS)
    assert optimized(targets.target_legality(decisions, events)).toString().count("Join LeftOuter") == 1


def test_event_windows_lie_within_a_branch(spark):
    plan = executed(targets.event_rules(L.corpora(spark, SF, L.EVENTS)[0]))
    assert not re.search(r"hashpartitioning\(source_id#\d+, branch_id#\d+, task_id", plan)


def test_lane_is_made_once(spark, monkeypatch):
    """A lane's packets are written before they are read four times, and the lane before it is compared with what is made of it."""
    saved = []
    save = Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    lanes.single_lane(PL.packets(spark, SF))
    assert saved[0] == ["run_id", "end", "at", "eof"]
    assert "Window" not in optimized(catalog.QUERIES["q_lane_surplus"](spark, SF)).toString()


def test_segments_by_portions(spark, monkeypatch):
    """What is held is bounded: a text's segments come in portions, none lost or moved."""
    df = spark.createDataFrame([(1, "One two. " * 50), (2, None), (3, "x" * 95)], "id long, t string").coalesce(1)
    whole = [tuple(r) for r in text.segments(df, "t", 40, 5).collect()]
    held = text.segments.__globals__["HELD"]
    monkeypatch.setattr(text, "HELD", 10)
    assert [tuple(r) for r in text.segments(df, "t", 40, 5).collect()] == whole and held > 10
    assert [r[1] for r in whole if r[0] == 1] == list(range(51)) and [len(r[2]) for r in whole if r[0] == 3] == [5, 40, 40, 10]
    assert "MapInArrow" in executed(text.segments(df, "t", 40, 5))


def test_measures_are_sorted_where_they_are_made(spark, monkeypatch):
    """Steps are dealt by run once, to parts whose number grows with the steps; their measures, twenty a step, are not shuffled or joined."""
    monkeypatch.setattr(PT, "PART_STEPS", 50, raising=False)
    plan = executed(catalog.QUERIES["q_timing_distributions"](spark, SF))
    assert plan.count("Exchange") == 1 and "Join" not in plan and re.search(r"hashpartitioning\(run_id#\d+, 20\)", plan)


def test_distributions_of_long_runs(spark):
    """Runs of many steps, one of them without a name, beside those of few: the same distributions, each once."""
    trace = PT.trace(spark, SF).withColumn("run_id", F.expr("nullif(run_id, 'u3')"))
    steps = [r["count"] for r in trace.groupBy("run_id").count().collect()]
    rows = lambda few: sorted((tuple(r) for r in T.distributions(trace, few=few).collect()), key=repr)
    whole = rows(max(steps))
    assert len(whole) == 24 * len(steps) and rows(sorted(steps)[len(steps) // 2]) == whole and rows(0) == whole
