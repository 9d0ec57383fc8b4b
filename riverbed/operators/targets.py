"""Legality of supervision targets, and the rules of events and corpora that go with it: every rule is a query whose rows break it.

EVENTS and DECISIONS are the columns; those that a kind or module does not have are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.causal import KEYS
from riverbed.operators.metrics import gate
from riverbed.operators.sequence import dealt

# States, phases, actions, and the fields that a module's targets may have.
STATES = ["user_idle", "user_nonidle", "user_incomplete", "user_complete", "user_backchannel"]
TASK_STATES = ["active", "completed", "failed", "timeout"]
PHASES = ["generated", "submitted", "synthesized", "playing", "closed"]
ACTIONS = ["wait", "request_thinking", "speak", "continue_expression"]
FIELDS = {"controller": ["user_state", "intervention"], "layer1": ["action", "purpose", "text", "response_key", "output_id", "task_id"], "layer2": ["analysis"]}
CONTROL_SCOPE, CLARIFICATION_SCOPE, OPPORTUNITY = "future_control", "future_clarification", "clarification_opportunity"

EVENTS = """source_id string, branch_id string, id string, at_ms long, kind string, raw_state string, ready_ms long, observed_ms long, effective_complete boolean, task_id string, state string,
output_id string, phase string, generated string, played string, heard_any boolean, origin string, response_key string, runtime string, basis_frontend string, read_ms long, finished_ms long, version long,
analysis string, intervention string, scope string, judgment string"""
DECISIONS = """source_id string, branch_id string, id string, module string, read_ms long, finish_ms long, seen array<string>, scope string, uncertain boolean, fields array<string>, user_state string, intervention string,
action string, purpose string, text string, response_key string, output_id string, analysis string, publication string, judgment string, prefix_group string"""
BRANCH = ["source_id", "branch_id"]


def _is(c: Column) -> Column:
    """True only where c is; null counts as false."""
    return F.coalesce(c, F.lit(False))


def _told(df: DataFrame, rules: dict[str, Column], keys: list[str] = KEYS) -> DataFrame:
    return gate(df, keys, {k: _is(c) for k, c in rules.items()}).withColumnRenamed("failure", "label")


def target_legality(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, branch_id, id, label) of targets that their module, or what the decision had seen by then, does not allow."""
    e = events.select(*BRANCH, F.col("id").alias("e_id"), F.struct(*[c for c in events.columns if c not in (*BRANCH, "id")]).alias("e"))
    module, action, scope = F.col("module"), F.col("action"), F.col("scope")
    first, second = module == "layer1", module == "layer2"
    # only these look at events: an entry for each that was seen, and one (pos -1) for the decision itself, which meets its publication. One join and one group tell all.
    looks = decisions.filter(_is(second | (first & action.isin("speak", "request_thinking", "continue_expression"))))
    entries = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.when(second, F.col("publication")).alias("e_id"))), F.transform(F.coalesce("seen", F.array().cast("array<string>")), lambda x, i: F.struct(i.alias("pos"), x.alias("e_id"))))
    own = F.struct("module", "action", "purpose", "analysis", "read_ms", "finish_ms")
    s = looks.select(*KEYS, F.struct("response_key", "output_id").alias("d"), own.alias("own"), F.explode(entries).alias("x")).select(*KEYS, "d", F.when(F.col("x.pos") < 0, F.col("own")).alias("own"), "x.*")
    s = dealt(s.join(e, [*BRANCH, "e_id"], "left"), KEYS, decisions.count())
    kind, seen, at = F.col("e.kind"), F.col("pos") >= 0, F.struct(F.col("e.at_ms").alias("at"), (-F.col("pos")).alias("p"))
    any_of = lambda c: F.coalesce(F.bool_or(_is(seen & c)), F.lit(False))
    told = s.groupBy(*KEYS).agg(
        F.max_by(F.struct("e_id", "e.effective_complete"), F.when(seen & (kind == "frontend"), at)).alias("current"),
        any_of((kind == "output") & (F.col("e.response_key") == F.col("d.response_key"))).alias("answered"),
        F.collect_set(F.when(seen & (kind == "controller") & (F.col("e.intervention") == OPPORTUNITY), F.col("e.basis_frontend"))).alias("opportunities"),
        any_of((kind == "output") & (F.col("e.output_id") == F.col("d.output_id"))).alias("continued"),
        any_of((kind == "runtime") & (F.col("e.runtime") == "cancel_confirmed") & (F.col("e.output_id") == F.col("d.output_id"))).alias("cancelled"),
        F.collect_list(F.when(seen & (kind == "task"), F.struct("e.task_id", F.struct("e.at_ms", "pos").alias("at"), "e.state"))).alias("tasks"),
        F.collect_list(F.when(~seen, F.struct("own", F.col("e").alias("p")))).alias("rows"),
    )
    # active: the last seen state of a task is
    last = lambda x: ~F.exists("tasks", lambda y: y["task_id"].eqNullSafe(x["task_id"]) & (y["at"] > x["at"]))
    told = told.withColumn("active", F.exists("tasks", lambda x: _is(x["state"] == "active") & last(x))).withColumn("opportunity", F.array_contains("opportunities", F.col("current.e_id")))
    d = told.select(*KEYS, F.explode("rows").alias("r"), "current", "answered", "opportunity", "continued", "cancelled", "active").select(*KEYS, "r.own.*", "r.p", "current", "answered", "opportunity", "continued", "cancelled", "active")
    allowed = F.lit(False)
    for name, fields in FIELDS.items():
        allowed = F.when(module == name, F.size(F.array_except("fields", F.array(*map(F.lit, fields)))) == 0).otherwise(allowed)
    controller, ordinary, clarifies = module == "controller", first & (action == "speak") & (F.col("purpose") == "ordinary"), first & (action == "speak") & (F.col("purpose") == "clarification")
    p = F.col("p")
    by_itself = _told(decisions, {
        "unknown_module": ~module.isin(list(FIELDS)),
        "finished_before_read": F.col("finish_ms") < F.col("read_ms"),
        "foreign_fields": ~allowed,
        "unknown_user_state": controller & F.col("user_state").isNotNull() & ~F.col("user_state").isin(STATES),
        "silent_uncertainty": controller & F.col("user_state").isNull() & ~_is(F.col("uncertain")),
        "intervention_scope": controller & F.array_contains("fields", "intervention") & ~scope.eqNullSafe(F.lit(CONTROL_SCOPE)),
        "unknown_action": first & ~_is(action.isin(ACTIONS)),
        "clarification_scope": clarifies & ~scope.eqNullSafe(F.lit(CLARIFICATION_SCOPE)),
        "internal_text": first & action.isin("wait", "request_thinking") & F.array_contains("fields", "text"),
        "empty_analysis": second & (F.coalesce(F.col("analysis"), F.lit("")) == ""),
    })
    return by_itself.unionByName(_told(d, {
        "answer_without_complete": ordinary & ~_is(F.col("current.effective_complete")),
        "answered_again": ordinary & F.col("answered"),
        "clarification_without_control": clarifies & ~_is(F.col("opportunity")),
        "requested_while_active": first & (action == "request_thinking") & _is(F.col("active")),
        "continued_without_output": first & (action == "continue_expression") & ~_is(F.col("continued")),
        "continued_cancelled": first & (action == "continue_expression") & _is(F.col("cancelled")),
        "no_publication": second & ~(_is(p["kind"] == "analysis")),
        "other_analysis": second & ~p["analysis"].eqNullSafe(F.col("analysis")),
        "other_read_time": second & ~p["read_ms"].eqNullSafe(F.col("read_ms")),
        "other_basis": second & ~p["basis_frontend"].eqNullSafe(F.col("current.e_id")),
        "other_finish_time": second & ~p["finished_ms"].eqNullSafe(F.col("finish_ms")),
    }))


def event_rules(events: DataFrame) -> DataFrame:
    """(source_id, branch_id, id, label) of events that break the order of a branch: states, tasks, analyses, outputs and cancellations."""
    order = Window.partitionBy(*BRANCH).orderBy("at_ms", "id")
    task = Window.partitionBy(*BRANCH, "task_id").orderBy("at_ms", "id")
    output = Window.partitionBy(*BRANCH, "output_id").orderBy("at_ms", "id")
    kind = F.col("kind")
    is_task, is_output, is_analysis = kind == "task", kind == "output", kind == "analysis"
    before = lambda c, w, on: F.last(F.when(on, F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a task counts while its last state is active, whatever came before: closing one that is not active changes nothing
    was, now = F.col("task_state").eqNullSafe(F.lit("active")), F.col("state").eqNullSafe(F.lit("active"))
    open_before = F.coalesce(F.sum(F.when(is_task, now.cast("int") - was.cast("int")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a cancellation and the outputs of the same time: all of them come before it, the last output being that of the smallest id among the latest
    outputs = events.filter("kind = 'output'").select(*BRANCH, "output_id", F.col("at_ms").alias("o_at"), F.col("id").alias("o_id"), F.col("heard_any").alias("o_heard"), F.col("phase").alias("o_phase"))
    cancels = events.filter("kind = 'runtime' and runtime = 'cancel_confirmed'").select(*KEYS, "at_ms", "output_id", "heard_any")
    met = cancels.join(outputs, [*BRANCH, "output_id"], "left")
    earlier = F.col("o_at") <= F.col("at_ms")
    first_id = met.filter(earlier).groupBy(*KEYS).agg(F.max("o_at").alias("o_at"))
    last = met.filter(earlier).join(first_id, [*KEYS, "o_at"]).groupBy(*KEYS).agg(F.min_by("o_heard", "o_id").alias("last_heard"))
    told = met.groupBy(*KEYS, "heard_any").agg(F.coalesce(F.bool_or(earlier), F.lit(False)).alias("some"), F.coalesce(F.bool_or((F.col("o_at") > F.col("at_ms")) & (F.col("o_phase") != "closed")), F.lit(False)).alias("reused")).join(last, KEYS, "left")
    cancelled = _told(told, {"cancelled_without_output": ~F.col("some"), "cancel_lost_history": F.col("some") & ~F.col("heard_any").eqNullSafe(F.col("last_heard")), "cancelled_output_reused": F.col("reused")})
    basis = events.select(*BRANCH, F.col("id").alias("basis_frontend"), F.struct("kind", "at_ms").alias("basis"))
    met = events.filter(is_analysis).select(*KEYS, "read_ms", "basis_frontend").join(basis, [*BRANCH, "basis_frontend"], "left")
    based = _told(met, {"unknown_basis": F.col("basis").isNull(), "future_basis": F.col("basis").isNotNull() & ~_is((F.col("basis.kind") == "frontend") & (F.col("basis.at_ms") <= F.col("read_ms")))})
    # dealt by branch once, with the columns of these rules only: all windows lie within it
    e = dealt(events.select(*KEYS, "at_ms", "kind", "task_id", "state", "output_id", "generated", "played", "version"), BRANCH, events.count())
    e = e.withColumns({
        "task_state": before("state", task, is_task), "times": F.row_number().over(Window.partitionBy(*KEYS).orderBy("at_ms", "kind")),
        "versions": F.count_if(is_analysis).over(task.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "generated_before": before("generated", output, is_output), "played_before": before("played", output, is_output),
    }).withColumn("open_before", open_before)
    played = F.coalesce("played", F.lit(""))
    by_itself = _told(events, {
        "negative_time": F.col("at_ms") < 0,
        "unknown_state": (kind == "frontend") & ~_is(F.col("raw_state").isin(STATES)),
        "ready_after_published": (kind == "frontend") & (F.col("ready_ms") > F.col("at_ms")),
        "future_audio": (kind == "frontend") & (F.col("observed_ms") > F.col("ready_ms")),
        "false_complete": (kind == "frontend") & F.col("effective_complete") & ~F.col("raw_state").eqNullSafe(F.lit("user_complete")),
        "unknown_task_state": is_task & ~_is(F.col("state").isin(TASK_STATES)),
        "analysis_times": is_analysis & ~_is((F.col("read_ms") <= F.col("finished_ms")) & (F.col("finished_ms") <= F.col("at_ms"))),
        "unknown_phase": is_output & ~_is(F.col("phase").isin(PHASES)),
        "heard_differs": is_output & ~F.col("heard_any").eqNullSafe(played != ""),
        "played_not_generated": is_output & ~F.col("generated").startswith(played),
    })
    return _told(e, {
        "event_repeated": F.col("times") > 1,
        "two_active_tasks": is_task & (F.col("state") == "active") & (F.col("open_before") > 0),
        "closed_inactive_task": is_task & (F.col("state") != "active") & ~F.col("task_state").eqNullSafe(F.lit("active")),
        "analysis_outside_task": is_analysis & ~F.col("task_state").eqNullSafe(F.lit("active")),
        "analysis_version": is_analysis & (F.col("version") != F.col("versions")),
        "generated_rewritten": is_output & ~F.col("generated").startswith(F.col("generated_before")),
        "played_rewritten": is_output & ~played.startswith(F.col("played_before")),
    }).unionByName(by_itself).unionByName(based).unionByName(cancelled)


def generation_rules(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, branch_id, id, label) of outputs and controls without an earlier target, and of fixed errors that are one.

    The earliest target of each text decides, so the join is one row for each text.
    """
    output = Window.partitionBy(*BRANCH, "output_id").orderBy("at_ms", "id")
    o = events.filter("kind = 'output'").withColumn("suffix", F.substr(F.col("generated"), F.coalesce(F.length(F.lag("generated").over(output)), F.lit(0)) + 1)).filter("suffix <> ''")
    first = decisions.filter("module = 'layer1' and text is not null").groupBy(*BRANCH, "text").agg(F.min("finish_ms").alias("ready"))
    fixed = o.filter("origin = 'fixed_error_prefix'").join(first.withColumnRenamed("text", "generated"), [*BRANCH, "generated"], "left_semi")
    free = o.filter("not (origin <=> 'fixed_error_prefix')").join(first.withColumnRenamed("text", "suffix"), [*BRANCH, "suffix"], "left")
    control = decisions.filter("module = 'controller' and judgment is not null").groupBy(*BRANCH, "judgment").agg(F.min("finish_ms").alias("ready"))
    c = events.filter("kind = 'controller'").join(control, [*BRANCH, "judgment"], "left")
    late = F.col("ready").isNull() | (F.col("ready") > F.col("at_ms"))
    return (
        _told(free, {"no_earlier_target": late}).unionByName(_told(fixed, {"fixed_error_is_target": F.lit(True)}))
        .unionByName(_told(c, {"no_earlier_judgment": late, "unmarked_control": ~F.col("scope").eqNullSafe(F.lit(CONTROL_SCOPE))}))
    )


def shape_rules(corpus: DataFrame, decisions: DataFrame, version: str, sources: int, required: list[str]) -> DataFrame:
    """(label, detail) of a corpus (source_id, branch_id, split, schema_version, coverage array<string>, one row a branch) whose shape is wrong.

    One schema version, so many sources, all of the pilot split, branches once each, every required coverage label somewhere, and for
    each shared prefix of a module one target.
    """
    told = lambda df, label, detail: df.select(F.lit(label).alias("label"), detail.cast("string").alias("detail"))
    n = corpus.agg(F.count_distinct("source_id").alias("n")).filter(F.col("n") != sources)
    again = corpus.groupBy(*BRANCH).count().filter("count > 1")
    wanted = corpus.sparkSession.createDataFrame([(x,) for x in required], "detail string")
    missing = wanted.join(corpus.select(F.explode("coverage").alias("detail")).distinct(), "detail", "left_anti")
    target = F.to_json(F.struct("fields", "user_state", "intervention", "action", "purpose", "text", "response_key", "output_id", "analysis"))
    groups = decisions.filter("prefix_group is not null").groupBy("module", "prefix_group").agg(F.min(target).alias("a"), F.max(target).alias("b")).filter("a <> b")
    parts = [
        told(corpus.filter(~F.col("schema_version").eqNullSafe(F.lit(version))).select("schema_version").distinct(), "schema_version", F.col("schema_version")),
        told(n, "source_count", F.col("n")), told(corpus.filter(~F.col("split").eqNullSafe(F.lit("pilot"))), "split", F.col("source_id")), told(again, "branch_repeated", F.col("branch_id")),
        told(decisions.groupBy(*KEYS).count().filter("count > 1"), "decision_repeated", F.col("id")),
        told(missing, "coverage_missing", F.col("detail")), told(groups, "shared_prefix_conflict", F.col("prefix_group")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
