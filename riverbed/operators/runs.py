"""Audits of recorded runs: a row (keys, label) for each rule that a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.operators.metrics import gate
from riverbed.operators.rules import broken, ledger_violations

# Sizes of a cleared session's buffers, threads of a run, and the samples of a warm-up input and its silent end.
BUFFERS = [16000, 25600, 51200]
THREADS = {"cpu_threads": 2, "interop_threads": 1}
WARMUP_SAMPLES, WARMUP_TAIL = 124_800, 25_600


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def condition_violations(results: DataFrame, manifest: str, cases: list[str], limited: str) -> DataFrame:
    """(condition, label) of results: condition, named, manifest_sha256, exit_code, passed, case_ids array<string>, warmup_passed, rounds, missing array<boolean>, reset_equal, equivalent.

    A condition is that of its folder and manifest, ends with 0 and has the fixed cases in order. Its warm-up passed and, unless it is the limited
    one, had two rounds in which nothing was missing, an equal reset and equal outputs.
    """
    full = F.col("condition") != limited
    complete = (F.col("rounds") == 2) & ~F.exists(F.coalesce("missing", F.array(F.lit(True))), lambda x: x) & _yes("reset_equal") & _yes("equivalent")
    rules = {
        "frozen_condition_or_manifest_changed": broken((F.col("manifest_sha256") == manifest) & (F.col("named") == F.col("condition"))),
        "condition_failed": broken((F.col("exit_code") == 0) & F.col("passed")),
        "fixed_cases_missing_or_changed": broken(F.col("case_ids") == F.array(*map(F.lit, cases))),
        "warmup_failed": ~_yes("warmup_passed"),
        "full_warmup_or_equivalence_missing": full & broken(complete),
    }
    return gate(results, ["condition"], rules).withColumnRenamed("failure", "label")


def report_violations(reports: DataFrame, manifest: str, smoke: int = 3) -> DataFrame:
    """(run_id, label) of reports: run_id, passed, cases, expected, manifest_sha256, scope, warmup_passed, equivalence struct<executed,status,policy,passed>, execution and backends (array) struct<cpu_threads,interop_threads>, recogniser_cpus, skip_complete.

    A run passed, has as many cases as expected under the fixed manifest, and the scope that goes with their number; its warm-up passed and says that nothing was compared; it and
    all its backends kept to their threads.
    """
    fits = lambda x: (x["cpu_threads"] == THREADS["cpu_threads"]) & (x["interop_threads"] == THREADS["interop_threads"])
    e, off = F.col("equivalence"), "disabled_by_user"
    rules = {
        "run_failed": ~_yes("passed"), "run_cases": broken(F.col("cases") == F.col("expected")), "run_manifest": broken(F.col("manifest_sha256") == manifest),
        "run_scope": broken(F.col("scope") == F.when(F.col("expected") == smoke, "smoke").otherwise("fixed")),
        "run_warmup": broken(F.col("warmup_passed") & ~e["executed"] & (e["status"] == off) & (e["policy"] == off) & e["passed"].isNull()),
        "run_budget": broken(fits(F.col("execution")) & (F.col("recogniser_cpus") == 2) & F.col("skip_complete")),
        "backend_budget": broken(F.forall("backends", lambda x: F.coalesce(fits(x), F.lit(False)))),
    }
    return gate(reports, ["run_id"], rules).withColumnRenamed("failure", "label")


def acceptance_violations(gates: DataFrame, preflight: list[str], samples: int = 30) -> DataFrame:
    """(gate_id, label) of gates: gate_id, condition, evidence_sha256, expected_sha256, candidate, resources, dual_passed, cases array<struct<case_id,passed>>, sample_ids array<string>.

    A formal run may begin under a full condition, on evidence of the expected digest in which candidate and resources were accepted and the full two-lane condition passed with the
    preflight cases, in their order, all passed; and on so many samples, each once.
    """
    cases = F.coalesce("cases", F.array().cast("array<struct<case_id: string, passed: boolean>>"))
    rules = {
        "condition_not_full": broken(F.col("condition").isin("dual-full", "single-full")), "evidence_digest": broken(F.col("evidence_sha256") == F.col("expected_sha256")), "not_candidate": ~_yes("candidate"),
        "resources_not_checked": ~_yes("resources"), "dual_failed": ~_yes("dual_passed"), "preflight_changed": broken(F.transform(cases, lambda x: x["case_id"]) == F.array(*map(F.lit, preflight))),
        "preflight_failed": ~F.forall(cases, lambda x: F.coalesce(x["passed"], F.lit(False))), "sample_count": broken(F.size("sample_ids") == samples), "sample_repeated": broken(F.size(F.array_distinct("sample_ids")) == F.size("sample_ids")),
    }
    return gate(gates, ["gate_id"], rules).withColumnRenamed("failure", "label")


def run_violations(cases: DataFrame, steps: DataFrame, expected: int) -> DataFrame:
    """(case_id, label) of a run: cases (case_id, passed, frames, thread_id), steps (case_id, step_id, thread_id, cpu_threads, interop_threads, skip_allowed, skipped, completion, text).

    As many cases as expected, each once and passed, with dense steps as counted; every step on the case's thread with its fixed numbers of threads; recognition
    is skipped exactly once where the model says complete, and then without text. case_id is null for the number of cases.
    """
    n = steps.groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct("step_id").alias("distinct"), F.min("step_id").alias("low"), F.max("step_id").alias("high"))
    c = cases.join(n, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = (F.col("n") == 0) | ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n")))
    by_case = gate(c, ["case_id"], {"case_failed": ~_yes("passed"), "steps_not_dense": ~dense, "frames_missing": broken(F.col("n") == F.col("frames"))})
    again = gate(cases.groupBy("case_id").agg(F.count("*").alias("times")), ["case_id"], {"case_repeated": F.col("times") > 1})
    count = gate(cases.agg(F.count("*").alias("times")).withColumn("case_id", F.lit(None).cast("string")), ["case_id"], {"case_count": F.col("times") != expected})
    s = steps.join(cases.select("case_id", F.col("thread_id").alias("own")).distinct(), "case_id")
    complete = F.col("completion") == "model_complete"
    by_step = gate(s, ["case_id"], {
        "other_thread": broken(F.col("thread_id") == F.col("own")),
        "thread_budget": broken((F.col("cpu_threads") == THREADS["cpu_threads"]) & (F.col("interop_threads") == THREADS["interop_threads"])),
        "skip_policy": broken(F.col("skip_allowed") & (F.col("skipped") == complete.cast("int")) & (~complete | (F.col("text") == ""))),
    }).distinct()
    return by_case.unionByName(again).unionByName(count).unionByName(by_step).withColumnRenamed("failure", "label")


def recording_violations(recordings: DataFrame, frames: DataFrame) -> DataFrame:
    """(recording_id, label): recordings (recording_id, kind, synthetic, rate, channels, finite, total, sha256, expected_sha256, loud array<struct<start,stop>> where samples are not silent), frames (recording_id, start_sample, samples, time).

    Digest, kind, rate, one channel, finite samples; frames as in ledger_violations and within the recording; no sound outside of them.
    """
    own = gate(recordings, ["recording_id"], {
        "digest": broken(F.col("sha256") == F.col("expected_sha256")), "kind": broken((F.col("kind") == "live_monotonic_playback_capture") & ~F.col("synthetic")),
        "format": broken((F.col("rate") == 16000) & (F.col("channels") == 1) & (F.col("total") > 0) & F.col("finite")),
    })
    ledger = ledger_violations(frames, ["recording_id"], ["start_sample"]).select("recording_id", "failure")
    beyond = frames.join(recordings.select("recording_id", "total"), "recording_id").filter(F.col("start_sample") + F.col("samples") > F.col("total")).select("recording_id", F.lit("beyond_end").alias("failure"))
    # samples that frames hold before a place: all of the frames that begin before it, but for what the last one holds beyond. One window over frames and places, no pairs;
    # frames do not overlap, or the ledger says so
    places = recordings.select("recording_id", F.posexplode("loud").alias("k", "x")).select("recording_id", "k", F.explode(F.array(F.struct(F.col("x.start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("x.stop").alias("at"), F.lit(1).alias("sign")))).alias("p"), (F.col("x.stop") - F.col("x.start")).alias("length"))
    places = places.select("recording_id", F.col("p.at").alias("at"), "k", "p.sign", "length", F.lit(0).cast("long").alias("samples"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    starts = frames.select("recording_id", F.col("start_sample").alias("at"), none("k", "int"), none("sign", "int"), none("length", "long"), "samples")
    before = Window.partitionBy("recording_id").orderBy("at", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(F.when(F.col("k").isNull(), F.col(c)), ignorenulls=True).over(before)
    marked = places.unionByName(starts).withColumns({"sum": F.sum("samples").over(before), "last_at": last("at"), "last_samples": last("samples")})
    beyond_it = F.greatest(F.lit(0), F.coalesce(F.col("last_samples") - (F.col("at") - F.col("last_at")), F.lit(0)))
    held = marked.filter("k is not null").groupBy("recording_id", "k", "length").agg(F.sum(F.col("sign") * (F.col("sum") - beyond_it)).alias("held"))
    outside = held.filter(F.col("held") < F.col("length")).select("recording_id", F.lit("sound_outside_frames").alias("failure"))
    return own.unionByName(ledger).unionByName(beyond).unionByName(outside).distinct().withColumnRenamed("failure", "label")


def plan_violations(planned: DataFrame, actual: DataFrame, keys: list[str], config: str) -> DataFrame:
    """(keys, label): planned (keys) and actual (keys, passed, config_sha256) must be the same keys, once each, all passed, with one configuration. The plan is the denominator, so nothing may be left out."""
    p = planned.groupBy(*keys).agg(F.count("*").alias("p"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("a"), F.bool_and(_yes("passed")).alias("passed"), F.bool_and(F.col("config_sha256").eqNullSafe(F.lit(config))).alias("same"))
    both = p.join(a, keys, "full_outer")
    rules = {"planned_twice": F.col("p") > 1, "missing": F.col("a").isNull(), "unplanned": F.col("p").isNull(), "repeated": F.col("a") > 1, "failed": ~F.col("passed"), "other_config": ~F.col("same")}
    return gate(both, keys, rules).withColumnRenamed("failure", "label")


def cross_check(own: DataFrame, official: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, name, own, official) of figures that differ by more than a tolerance; null equals null only."""
    from riverbed.functions.scalars import close_to

    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"o.{n}").cast("double").alias("own"), F.col(f"f.{n}").cast("double").alias("official")) for n in names]))
    both = own.alias("o").join(official.alias("f"), keys, "full_outer").select(*keys, pairs.alias("x")).select(*keys, "x.*")
    return both.filter(~close_to(F.col("own"), F.col("official"), tolerance))


def session_violations(sessions: DataFrame, dual: bool) -> DataFrame:
    """(session_id, label) of sessions that were not cleared: flags kv, history, speech, callbacks and buffers array<int>; dual: asr_kv, asr_text, asr_callbacks, asr_counters too."""
    flags = ["kv", "history", "speech", "callbacks", *(["asr_kv", "asr_text", "asr_callbacks", "asr_counters"] if dual else [])]
    rules = {f"{f}_not_cleared": ~_yes(f) for f in flags} | {"buffer_sizes": broken(F.col("buffers") == F.array(*map(F.lit, BUFFERS)))}
    return gate(sessions, ["session_id"], rules).withColumnRenamed("failure", "label")


def warmup_violations(inputs: DataFrame, digest: str) -> DataFrame:
    """(input_id, label) of warm-up inputs: sha256, channels, samples, peak, silent_tail (samples of silence at the end)."""
    rules = {
        "digest": broken(F.col("sha256") == digest), "channels": broken(F.col("channels") == 1), "samples": broken(F.col("samples") == WARMUP_SAMPLES),
        "level": broken((F.col("peak") > 0) & (F.col("peak") <= 0.9 + 1e-6)), "tail": broken(F.col("silent_tail") >= WARMUP_TAIL),
    }
    return gate(inputs, ["input_id"], rules).withColumnRenamed("failure", "label")


def stale(stamps: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name) of cached results one of whose inputs or outputs (keys, name, digest) is not what it was, is gone or is new: such a cache must be refused."""
    was, got = stamps.withColumnRenamed("digest", "was"), now.withColumnRenamed("digest", "got")
    return was.join(got, [*keys, "name"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("got"))).select(*keys, "name")
