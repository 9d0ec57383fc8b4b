"""The rule-sets over corpora, traces and runs: every query's rows are what breaks a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverbed.catalog import query
from riverbed.operators import audit as A
from riverbed.operators import causal as V
from riverbed.operators import history as H
from riverbed.operators import runs as R
from riverbed.operators import targets as T
from riverbed.plans import corpora as L
from riverbed.sources.tables import table


@query("q_rules_visibility", L.told(L.VISIBILITY))
def q_rules_visibility(spark, sf_dir):
    """What decisions saw that they may not."""
    events, decisions = L.corpora(spark, sf_dir, L.VISIBILITY)
    return V.visibility(decisions, events.withColumn("text", F.lit(None).cast("string")))


@query("q_rules_events", L.told(L.EVENTS))
def q_rules_events(spark, sf_dir):
    """Events out of the order that a branch must keep."""
    return T.event_rules(L.corpora(spark, sf_dir, L.EVENTS)[0])


@query("q_rules_generation", L.told(L.GENERATION))
def q_rules_generation(spark, sf_dir):
    """Outputs and controls without an earlier target."""
    events, decisions = L.corpora(spark, sf_dir, L.GENERATION)
    return T.generation_rules(decisions, events)


@query("q_rules_targets", L.told(L.TARGETS))
def q_rules_targets(spark, sf_dir):
    """Targets that their module, or what had been seen, does not allow."""
    events, decisions = L.corpora(spark, sf_dir, L.TARGETS)
    return T.target_legality(decisions, events)


_TRACE_ROWS = ", ".join(f"({k}, {step}, '{label}')" for k, (_, _, labels) in enumerate(L.TRACE) for step, label in sorted(labels))


@query("q_rules_trace", f"SELECT 'c' || o_orderkey AS case_id, step_id::BIGINT AS step_id, label FROM orders JOIN (VALUES {_TRACE_ROWS}) v(variant, step_id, label) ON o_orderkey % {len(L.TRACE)} = variant")
def q_rules_trace(spark, sf_dir):
    """Steps of two-lane traces that break a rule."""
    return A.audit(L.traces(spark, sf_dir), source="s")


def orders(spark, sf_dir, **columns):
    """Columns made of the key k of each order."""
    return table(spark, sf_dir, "orders", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).select("k", "c", *[F.expr(x).alias(n) for n, x in columns.items()])


_ORDERS = "o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)"


@query("q_rules_shape", f"""
WITH {_ORDERS}, b AS (SELECT k, c, 's' || c % 7 AS source_id, k % 997 = 5 AS second, k % 1001 = 7 AS train, 'p' || k % 4 AS label FROM o), r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE k % 503 = 2),
d AS (SELECT 'g' || c AS g, CASE WHEN k % 11 = 0 THEN 'wait' ELSE 'speak' END AS a FROM r)
SELECT 'schema_version' AS label, 'v2' AS detail FROM r WHERE second GROUP BY 1 UNION ALL SELECT 'source_count', count(DISTINCT source_id)::VARCHAR FROM r HAVING count(DISTINCT source_id) <> 5 UNION ALL SELECT 'split', source_id FROM r WHERE train
UNION ALL SELECT 'branch_repeated', 'b' || k FROM r GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'decision_repeated', 'd' FROM r GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'coverage_missing', x FROM (VALUES ('p0'), ('p1'), ('p2'), ('p3'), ('p4')) v(x) WHERE x NOT IN (SELECT label FROM r)
UNION ALL SELECT 'shared_prefix_conflict', g FROM d GROUP BY g HAVING min(a) <> max(a)""")
def q_rules_shape(spark, sf_dir):
    """The shape of a corpus with a branch for each order: some of another version, split or twice, and targets that differ where the prefix is shared."""
    b = orders(spark, sf_dir, source_id="'s' || c % 7", branch_id="'b' || k", split="if(k % 1001 = 7, 'train', 'pilot')", schema_version="if(k % 997 = 5, 'v2', 'v1')", coverage="array('p' || k % 4)", action="if(k % 11 = 0, 'wait', 'speak')")
    b = b.unionByName(b.filter("k % 503 = 2"))
    empty = spark.createDataFrame([], T.DECISIONS)
    given = {"source_id": "source_id", "branch_id": "branch_id", "id": "'d'", "module": "'layer1'", "fields": "array('action')", "action": "action", "prefix_group": "'g' || c"}
    d = b.select(*[F.expr(given.get(f.name, "null")).cast(f.dataType).alias(f.name) for f in empty.schema])
    return T.shape_rules(b.select("source_id", "branch_id", "split", "schema_version", "coverage"), d, "v1", 5, ["p0", "p1", "p2", "p3", "p4"])


@query("q_rules_conditions", f"""
WITH {_ORDERS}, r AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'limited' ELSE 'k' || k END AS condition FROM o)
SELECT condition, unnest(list_filter([CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'frozen_condition_or_manifest_changed' END, CASE WHEN k % 5 = 0 OR k % 17 = 0 THEN 'condition_failed' END, CASE WHEN k % 3 = 0 THEN 'fixed_cases_missing_or_changed' END,
  CASE WHEN k % 19 = 0 THEN 'warmup_failed' END, CASE WHEN k % 7 <> 0 AND (k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0) THEN 'full_warmup_or_equivalence_missing' END], lambda x: x IS NOT NULL)) AS label FROM r""")
def q_rules_conditions(spark, sf_dir):
    """Conditions of a run that are not what was frozen, or failed."""
    r = orders(spark, sf_dir, condition="if(k % 7 = 0, 'limited', 'k' || k)", manifest_sha256="if(k % 13 = 0, null, 'm')", exit_code="if(k % 5 = 0, 1, 0)", passed="k % 17 <> 0", case_ids="if(k % 3 = 0, array('b', 'a'), array('a', 'b'))", warmup_passed="k % 19 <> 0",
               rounds="if(k % 23 = 0, 1, 2)", missing="array(false, k % 29 = 0)", reset_equal="k % 31 <> 0", equivalent="if(k % 37 = 0, null, true)")
    return R.condition_violations(r.withColumn("named", F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("condition"))), "m", ["a", "b"], "limited")


@query("q_rules_reports", f"""
WITH {_ORDERS} SELECT 'r' || k AS run_id, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'run_failed' END, CASE WHEN k % 13 = 0 THEN 'run_cases' END, CASE WHEN k % 17 = 0 THEN 'run_manifest' END, CASE WHEN k % 2 = 0 AND k % 6 <> 0 OR k % 2 = 1 AND k % 3 = 0 THEN 'run_scope' END,
  CASE WHEN k % 19 = 0 OR k % 23 = 0 THEN 'run_warmup' END, CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'run_budget' END, CASE WHEN k % 37 = 0 THEN 'backend_budget' END], lambda x: x IS NOT NULL)) AS label FROM o""")
def q_rules_reports(spark, sf_dir):
    """Reports of runs whose scope, manifest, warm-up or budgets differ from what is fixed."""
    threads = lambda cpus: f"named_struct('cpu_threads', {cpus}, 'interop_threads', 1)"
    r = orders(spark, sf_dir, run_id="'r' || k", passed="k % 11 <> 0", expected="if(k % 3 = 0, 3L, 30L)", manifest_sha256="if(k % 17 = 0, 'n', 'm')", scope="if(k % 2 = 0, 'smoke', 'fixed')", warmup_passed="k % 19 <> 0", skip_complete="true",
               equivalence="named_struct('executed', k % 23 = 0, 'status', 'disabled_by_user', 'policy', 'disabled_by_user', 'passed', cast(null as boolean))", execution=threads("if(k % 29 = 0, 4, 2)"), recogniser_cpus="if(k % 31 = 0, 1, 2)", backends=f"array({threads('2')}, {threads('if(k % 37 = 0, null, 2)')})")
    return R.report_violations(r.withColumn("cases", F.expr("if(k % 13 = 0, 1L, expected)")), "m")


@query("q_rules_runs", f"""
WITH {_ORDERS}, s AS (SELECT k, unnest(range(0, k % 5 + 1)) AS j FROM o), t AS (SELECT k, j, CASE WHEN k % 13 = 0 AND j = k % 5 THEN j + 1 ELSE j END AS step_id FROM s),
x AS (SELECT k, unnest(list_filter([CASE WHEN k % 17 = 0 THEN 'other_thread' END, CASE WHEN k % 19 = 0 AND j = 0 THEN 'thread_budget' END, CASE WHEN k % 23 = 0 THEN 'skip_policy' END], lambda x: x IS NOT NULL)) AS label FROM t)
SELECT 'c' || k AS case_id, 'case_failed' AS label FROM o WHERE k % 7 = 0 UNION ALL SELECT 'c' || k, 'case_failed' FROM o WHERE k % 7 = 0 AND k % 29 = 0 UNION ALL SELECT 'c' || k, 'steps_not_dense' FROM o WHERE k % 13 = 0 UNION ALL SELECT 'c' || k, 'steps_not_dense' FROM o WHERE k % 13 = 0 AND k % 29 = 0
UNION ALL SELECT 'c' || k, 'frames_missing' FROM o WHERE k % 11 = 0 UNION ALL SELECT 'c' || k, 'frames_missing' FROM o WHERE k % 11 = 0 AND k % 29 = 0 UNION ALL SELECT 'c' || k, 'case_repeated' FROM o WHERE k % 29 = 0
UNION ALL SELECT NULL, 'case_count' UNION ALL SELECT DISTINCT 'c' || k, label FROM x""")
def q_rules_runs(spark, sf_dir):
    """Cases and steps of a run: failed, repeated, not dense, on another thread, or with recognition skipped where it must not be."""
    c = orders(spark, sf_dir, case_id="'c' || k", passed="k % 7 <> 0", frames="if(k % 11 = 0, 0, k % 5 + 1)", thread_id="k % 3")
    s = c.select("k", "case_id", "thread_id", F.explode(F.expr("sequence(0L, k % 5)")).alias("j"))
    s = s.select("case_id", F.expr("if(k % 13 = 0 and j = k % 5, j + 1, j)").alias("step_id"), F.expr("thread_id + if(k % 17 = 0, 1, 0)").alias("thread_id"), F.expr("if(k % 19 = 0 and j = 0, 4, 2)").alias("cpu_threads"), F.lit(1).alias("interop_threads"),
                 F.expr("k % 23 <> 0").alias("skip_allowed"), F.expr("if(j % 2 = 1, 1, 0)").alias("skipped"), F.expr("if(j % 2 = 1, 'model_complete', 'timeout')").alias("completion"), F.expr("if(j % 2 = 1, '', 'x')").alias("text"))
    cases = c.select("case_id", "passed", "frames", "thread_id")
    return R.run_violations(cases.unionByName(cases.join(c.filter("k % 29 = 0").select("case_id"), "case_id")), s, 1)


@query("q_rules_recordings", f"""
WITH {_ORDERS}, f AS (SELECT k, j, (100 + 320 * j + CASE WHEN j >= 2 THEN 50 ELSE 0 END - CASE WHEN j = 1 AND k % 41 = 0 THEN 10 ELSE 0 END)::BIGINT AS p, CASE WHEN k % 11 = 0 AND j = 3 THEN 400 ELSE 320 END AS n FROM (SELECT k, unnest(range(0, k % 4 + 1)) AS j FROM o)),
l AS (SELECT k, 110::BIGINT AS a, (110 + 100 + k % 700)::BIGINT AS b FROM o WHERE k % 3 = 0 AND k % 41 <> 0 UNION ALL SELECT k, 50, 60 FROM o WHERE k % 13 = 0),
h AS (SELECT l.k, l.a, l.b, coalesce(sum(CASE WHEN p IS NOT NULL THEN least(p + n, b) - greatest(p, a) END), 0) AS held FROM l LEFT JOIN f ON f.k = l.k AND f.p < l.b AND f.p + f.n > l.a GROUP BY ALL)
SELECT 'r' || k AS recording_id, 'digest' AS label FROM o WHERE k % 5 = 0 UNION ALL SELECT 'r' || k, 'kind' FROM o WHERE k % 7 = 0 OR k % 17 = 0 UNION ALL SELECT 'r' || k, 'format' FROM o WHERE k % 19 = 0 OR k % 23 = 0
UNION ALL SELECT 'r' || k, 'beyond_end' FROM o WHERE k % 29 = 0 UNION ALL SELECT DISTINCT 'r' || k, 'sound_outside_frames' FROM h WHERE held < b - a UNION ALL SELECT DISTINCT 'r' || k, 'frame_size' FROM f WHERE n > 320 UNION ALL SELECT 'r' || k, 'frame_time' FROM o WHERE k % 31 = 0 UNION ALL SELECT 'r' || k, 'overlap' FROM o WHERE k % 41 = 0 AND k % 4 > 0""")
def q_rules_recordings(spark, sf_dir):
    """Recordings whose digest, kind or format is wrong, whose frames do not follow each other, or that sound outside of them."""
    r = orders(spark, sf_dir, recording_id="'r' || k", kind="if(k % 7 = 0, 'mixed', 'live_monotonic_playback_capture')", synthetic="k % 17 = 0", rate="if(k % 19 = 0, 8000, 16000)", channels="1", finite="if(k % 23 = 0, null, true)", total="if(k % 29 = 0, 200L, 2000L)",
               sha256="if(k % 5 = 0, 'x', 'd')", expected_sha256="'d'", loud="filter(array(if(k % 3 = 0 and k % 41 <> 0, named_struct('start', 110L, 'stop', 210 + k % 700), null), if(k % 13 = 0, named_struct('start', 50L, 'stop', 60L), null)), x -> x is not null)")
    f = r.select("k", "recording_id", F.explode(F.expr("sequence(0L, k % 4)")).alias("j"))
    f = f.select("recording_id", "k", F.expr("100 + 320 * j + if(j >= 2, 50, 0) - if(j = 1 and k % 41 = 0, 10, 0)").alias("start_sample"), F.expr("if(k % 11 = 0 and j = 3, 400L, 320L)").alias("samples"))
    return R.recording_violations(r.drop("k", "c"), f.select("recording_id", "start_sample", "samples", F.expr("start_sample / 16000 + if(k % 31 = 0, 0.5d, 0d)").alias("time")))


@query("q_rules_plans", f"""
WITH {_ORDERS}, p AS (SELECT k FROM o WHERE k % 5 <> 1 UNION ALL SELECT k FROM o WHERE k % 37 = 2 AND k % 5 <> 1), a AS (SELECT k FROM o WHERE k % 7 <> 3 UNION ALL SELECT k FROM o WHERE k % 31 = 4 AND k % 7 <> 3),
b AS (SELECT k, (SELECT count(*) FROM p WHERE p.k = o.k) AS p, (SELECT count(*) FROM a WHERE a.k = o.k) AS a FROM o)
SELECT 'v' || k % 3 AS controller, 'i' || k AS id, unnest(list_filter([CASE WHEN p > 1 THEN 'planned_twice' END, CASE WHEN p > 0 AND a = 0 THEN 'missing' END, CASE WHEN p = 0 AND a > 0 THEN 'unplanned' END, CASE WHEN a > 1 THEN 'repeated' END,
  CASE WHEN a > 0 AND k % 11 = 0 THEN 'failed' END, CASE WHEN a > 0 AND k % 13 = 0 THEN 'other_config' END], lambda x: x IS NOT NULL)) AS label FROM b""")
def q_rules_plans(spark, sf_dir):
    """Planned and actual cases that are not the same ones, once each, all passed, with one configuration."""
    o = orders(spark, sf_dir, controller="'v' || k % 3", id="'i' || k", passed="k % 11 <> 0", config_sha256="if(k % 13 = 0, null, 'h')")
    planned, actual = o.filter("k % 5 <> 1"), o.filter("k % 7 <> 3")
    planned, actual = planned.unionByName(planned.filter("k % 37 = 2")), actual.unionByName(actual.filter("k % 31 = 4"))
    return R.plan_violations(planned.select("controller", "id"), actual.select("controller", "id", "passed", "config_sha256"), ["controller", "id"], "h")


@query("q_rules_cross_check", f"""
WITH {_ORDERS}, g AS (SELECT c, count(*) FILTER (WHERE k % 2 = 0) / count(*)::DOUBLE AS rate, CASE WHEN c % 13 <> 0 THEN sum(k) / 1e3 END AS latency FROM o GROUP BY c),
f AS (SELECT c, rate + CASE WHEN c % 7 = 0 THEN 1e-6::DOUBLE WHEN c % 11 = 0 THEN 1e-12::DOUBLE ELSE 0 END AS rate, CASE WHEN c % 17 <> 0 THEN latency END AS latency FROM g WHERE c % 19 <> 0)
SELECT g.c AS subset, 'rate' AS name, g.rate AS own, f.rate AS official FROM g LEFT JOIN f ON f.c = g.c WHERE f.c IS NULL OR abs(g.rate - f.rate) > 1e-9 UNION ALL SELECT g.c, 'latency', g.latency, f.latency FROM g LEFT JOIN f ON f.c = g.c WHERE (g.latency IS NULL) <> (f.latency IS NULL)""")
def q_rules_cross_check(spark, sf_dir):
    """Rates and latencies that differ from official ones by more than rounding, or that one side lacks."""
    g = orders(spark, sf_dir).groupBy("c").agg((F.count_if(F.col("k") % 2 == 0) / F.count("*")).alias("rate"), (F.sum("k") / 1e3).alias("latency")).withColumn("latency", F.expr("if(c % 13 <> 0, latency, null)")).withColumnRenamed("c", "subset")
    f = g.filter("subset % 19 <> 0").select("subset", F.expr("rate + case when subset % 7 = 0 then 1e-6d when subset % 11 = 0 then 1e-12d else 0d end").alias("rate"), F.expr("if(subset % 17 <> 0, latency, null)").alias("latency"))
    return R.cross_check(g, f, ["subset"], ["rate", "latency"])


_FLAGS = ["kv", "history", "speech", "callbacks", "asr_kv", "asr_text", "asr_callbacks", "asr_counters"]


@query("q_rules_sessions", f"""
WITH {_ORDERS} SELECT 's' || k AS session_id, unnest(list_filter([{", ".join(f"CASE WHEN k % {7 + i} = 0 THEN '{f}_not_cleared' END" for i, f in enumerate(_FLAGS))}, CASE WHEN k % 23 = 0 THEN 'buffer_sizes' END], lambda x: x IS NOT NULL)) AS label FROM o""")
def q_rules_sessions(spark, sf_dir):
    """Sessions that were not cleared of what they held."""
    flags = {f: f"if(k % {7 + i} = 0, {'null' if i % 2 else 'false'}, true)" for i, f in enumerate(_FLAGS)}
    return R.session_violations(orders(spark, sf_dir, session_id="'s' || k", buffers="if(k % 23 = 0, array(1), array(16000, 25600, 51200))", **flags), True)


@query("q_rules_stale", f"""
WITH {_ORDERS} SELECT 'k' || k AS key, 'in' AS name FROM o WHERE k % 5 = 0 UNION ALL SELECT 'k' || k, 'out' FROM o WHERE k % 7 = 0 UNION ALL SELECT 'k' || k, 'new' FROM o WHERE k % 11 = 0""")
def q_rules_stale(spark, sf_dir):
    """Cached results one of whose inputs or outputs is not what it was, is gone or is new."""
    o = orders(spark, sf_dir, key="'k' || k")
    part = lambda df, name, digest: df.select("key", F.lit(name).alias("name"), F.expr(digest).alias("digest"))
    was = part(o, "in", "'1'").unionByName(part(o, "out", "'2'"))
    now = part(o, "in", "if(k % 5 = 0, '9', '1')").unionByName(part(o.filter("k % 7 <> 0"), "out", "'2'")).unionByName(part(o.filter("k % 11 = 0"), "new", "'3'"))
    return R.stale(was, now, ["key"])


@query("q_rules_acceptance", f"""
WITH {_ORDERS} SELECT 'g' || k AS gate_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'condition_not_full' END, CASE WHEN k % 7 = 0 THEN 'evidence_digest' END, CASE WHEN k % 11 = 0 THEN 'not_candidate' END, CASE WHEN k % 13 = 0 THEN 'resources_not_checked' END, CASE WHEN k % 17 = 0 THEN 'dual_failed' END,
  CASE WHEN k % 19 = 0 THEN 'preflight_changed' END, CASE WHEN k % 23 = 0 THEN 'preflight_failed' END, CASE WHEN k % 29 = 0 THEN 'sample_count' END, CASE WHEN k % 31 = 0 THEN 'sample_repeated' END], lambda x: x IS NOT NULL)) AS label FROM o""")
def q_rules_acceptance(spark, sf_dir):
    """Gates that do not allow a formal run, by what is missing."""
    case = lambda name, passed="true": f"named_struct('case_id', '{name}', 'passed', {passed})"
    g = orders(spark, sf_dir, gate_id="'g' || k", condition="if(k % 5 = 0, 'dual-limited', 'dual-full')", evidence_sha256="if(k % 7 = 0, null, 'd')", expected_sha256="'d'", candidate="k % 11 <> 0", resources="if(k % 13 = 0, null, true)", dual_passed="k % 17 <> 0",
               cases=f"if(k % 19 = 0, array({case('b', 'k % 23 <> 0')}, {case('a')}), array({case('a')}, {case('b', 'if(k % 23 = 0, null, true)')}))", sample_ids="transform(sequence(1, if(k % 29 = 0, 29, 30)), x -> 's' || if(k % 31 = 0 and x = 2, 1, x))")
    return R.acceptance_violations(g, ["a", "b"])


@query("q_rules_resources", """
WITH m AS (SELECT o_orderpriority AS condition, max(o_orderkey) * 2 AS gpu_mib, max(o_custkey) AS rss_kib, max(o_orderkey % 100) AS output_kib FROM orders GROUP BY 1)
SELECT condition, r AS resource, peak::BIGINT AS peak, stop::BIGINT AS stop FROM (SELECT condition, 'gpu_mib' AS r, gpu_mib AS peak, 22528 AS stop FROM m UNION ALL SELECT condition, 'rss_kib', rss_kib, 149 FROM m UNION ALL SELECT condition, 'output_kib', output_kib, 99 FROM m) WHERE peak > stop""")
def q_rules_resources(spark, sf_dir):
    """Peaks beyond their limits, by condition; a peak at its limit passes."""
    o = table(spark, sf_dir, "orders", F.col("o_orderpriority").alias("condition"), (F.col("o_orderkey") * 2).alias("gpu_mib"), F.col("o_custkey").alias("rss_kib"), (F.col("o_orderkey") % 100).alias("output_kib"))
    return H.resource_stops(o, {"gpu_mib": 22_528, "rss_kib": 149, "output_kib": 99})
