"""Golden cases, mutations, readers, sinks and streams."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from riverbed.functions import scalars as C
from riverbed.operators import causal as V
from riverbed.operators import metrics as M
from riverbed.operators import text as T
from riverbed.sources import sinks, traces
from riverbed.streaming import consumer as S


def test_distribution(spark):
    one = spark.createDataFrame([(0.0,), (100.0,)], "x double")
    assert tuple(one.agg(*M.distribution("x")).first()) == (2, 50.0, 95.0, 100.0)
    assert tuple(one.filter("x < 0").agg(*M.distribution("x")).first()) == (0, None, None, None)


@pytest.mark.parametrize(
    ("starts", "ends", "want"),
    [([1.0, 1.2, 1.4], [1.1, 1.3, 1.5], (0, None)), ([1.1, 1.3, 1.5, 1.7], [1.2, 1.4, 1.6, 1.8], (1, 0.1)), ([0.2, 0.6], [0.5, 1.2], (1, 0.0)), ([], [], (0, None))],
)
def test_turn_score(spark, starts, ends, want):
    df = spark.createDataFrame([(starts, ends)], "s array<double>, e array<double>")
    got = df.select(C.turn_score(F.col("s"), F.col("e"), F.lit(1.0)).alias("r")).select("r.*").first()
    assert got[0] == want[0] and (got[1] is None if want[1] is None else abs(got[1] - want[1]) < 1e-9)


@pytest.mark.parametrize("total", [0, 1, 777, 1280, 1281, 2559, 2560, 2761, 3000])
def test_frame_windows(spark, total):
    rows = spark.createDataFrame([(total,)], "n long").select(F.inline(C.frame_windows(F.col("n")))).collect()
    want = [(k, k * 1280, min((k + 1) * 1280, total), min((k + 1) * 1280 + 200, total), max(0, (k + 1) * 1280 + 200 - total)) for k in range(-(-total // 1280))]
    assert [tuple(r) for r in rows] == want


def test_gate_boundaries(spark):
    df = spark.createDataFrame([("at", 0.6, 160.0), ("over", 0.61, 160.1)], "case_id string, rtf double, drift double")
    rules = {"rtf": F.col("rtf") > 0.6, "drift": F.col("drift") > 160}
    assert {tuple(r) for r in M.gate(df, ["case_id"], rules).collect()} == {("over", "rtf"), ("over", "drift")} == {tuple(r) for r in M.violations(df, ["case_id"], rules).collect()}


def test_scalars(spark):
    df = spark.createDataFrame([(None, {"b": "2", "a": "1"}, [2.0, -0.5])], "x double, m map<string,string>, v array<double>")
    r = df.select(C.clamp_low(F.col("x"), 0.0), C.canonical_json(F.col("m")), F.transform("v", C.pcm16), C.close_to(F.col("x"), F.col("x")), C.close_to(F.col("x"), F.lit(1.0)), C.strip(F.lit("\n a \t"))).first()
    assert tuple(r) == (None, '{"a":"1","b":"2"}', [32767, -16383], True, False, "a")


def test_segments(spark):
    text = "One two. Three four five six seven eight nine ten eleven twelve thirteen. " + "x" * 60
    rows = T.segments(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string"), "t", 40, 5).orderBy("id", "pos").collect()
    assert "".join(r["segment"] for r in rows).replace(" ", "") == text.replace(" ", "") and rows[0]["segment"] == "One"
    assert all(len(r["segment"]) <= 40 for r in rows) and {r["id"] for r in rows} == {1}


EVENTS = "source_id string, branch_id string, id string, at_ms long, kind string, text string, ready_ms long, task_id string, state string, output_id string, phase string, generated string"
DECISIONS = "source_id string, branch_id string, id string, module string, read_ms long, finish_ms long, seen array<string>, scope string, target_text string"


def corpus():
    e = lambda i, at, kind, **x: ["s", "b", i, at, kind, *[x.get(k) for k in ("text", "ready_ms", "task_id", "state", "output_id", "phase", "generated")]]
    events = {
        "f1": e("f1", 100, "frontend", text="hi", ready_ms=90, state="user_incomplete"), "f2": e("f2", 200, "frontend", text="hi there", ready_ms=190, state="user_complete"),
        "x": e("x", 50, "script"), "a": e("a", 250, "analysis"), "t1": e("t1", 260, "task", task_id="t", state="active"), "t2": e("t2", 500, "task", task_id="t", state="completed"),
        "o1": e("o1", 400, "output", output_id="o", phase="generated", generated="Yes."), "o2": e("o2", 450, "output", output_id="o", phase="closed", generated="Yes. Done."),
    }
    decisions = {
        "d1": ["s", "b", "d1", "controller", 210, 220, ["f1", "f2"], None, None], "d2": ["s", "b", "d2", "layer1", 300, 350, ["f2", "a"], None, "Yes."],
        "d3": ["s", "b", "d3", "layer1", 300, 360, ["f2", "f1"], None, " Done."],
    }
    return events, decisions


def labels(spark, events, decisions):
    e, d = spark.createDataFrame(list(events.values()), EVENTS), spark.createDataFrame(list(decisions.values()), DECISIONS)
    return sorted(r["label"] for r in V.visibility(d, e).collect())


def test_valid_corpus(spark):
    events, decisions = corpus()
    assert labels(spark, events, decisions) == []
    d, e = spark.createDataFrame(list(decisions.values()), DECISIONS), spark.createDataFrame(list(events.values()), EVENTS)
    assert {r["id"]: r["event_id"] for r in V.latest_frontend(d, e).collect()} == {"d1": "f2", "d2": "f2", "d3": "f2"}


@pytest.mark.parametrize(
    ("which", "key", "column", "value", "label"),
    [
        ("d", "d1", 6, ["f1", "f1"], "duplicate_seen"), ("d", "d1", 6, ["f1", "zz"], "unknown_event"), ("d", "d1", 4, 150, "future_event"), ("d", "d1", 6, ["f1", "x"], "script_visible"),
        ("d", "d2", 6, ["a"], "no_frontend"), ("d", "d1", 5, 1, "finished_before_read"), ("e", "f2", 3, 400, "future_event"),
    ],
)
def test_corpus_mutations(spark, which, key, column, value, label):
    events, decisions = corpus()
    (decisions if which == "d" else events)[key][column] = value
    assert label in labels(spark, events, decisions)


def test_readers_and_sinks(spark, tmp_path):
    schema = "step_id long, text string"
    (tmp_path / "a.frames.jsonl").write_text('{"step_id": 0, "text": "x"}\n\n{"step_id": 1, "text": "y"}\n')
    with gzip.open(tmp_path / "a.frames.jsonl.gz", "wt") as f:
        f.write('{"step_id": 9}\n')
    with gzip.open(tmp_path / "b.frames.jsonl.gz", "wt") as f:
        f.write('{"step_id": 5, "text": "z"}\n')
    root = f"file://{tmp_path}"
    assert [r["step_id"] for r in traces.read_trace(spark, root, "a", schema).orderBy("step_id").collect()] == [0, 1]
    assert [r["step_id"] for r in traces.read_trace(spark, root, "b", schema).collect()] == [5]
    assert traces.read_trace(spark, root, "none", schema).count() == 0
    assert {r["case_id"] for r in traces.read_traces(spark, f"{root}/b*.gz", schema).collect()} == {"b"}
    (tmp_path / "use.log").write_text("1 20  300\n2 21 301\n")
    assert [tuple(r) for r in traces.read_log(spark, f"{root}/use.log", ["s", "gpu", "rss"]).orderBy("s").collect()] == [(1, 20, 300), (2, 21, 301)]
    assert traces.read_log(spark, f"{root}/no.log", ["s"]).count() == 0
    (tmp_path / "doc.json").write_text(json.dumps({"a": {"b": 1}}, indent=2))
    assert traces.read_documents(spark, f"{root}/doc.json", "a struct<b: long>").select("a.b").first()[0] == 1
    good = hashlib.sha256((tmp_path / "use.log").read_bytes()).hexdigest()
    want = spark.createDataFrame([("use.log", good), ("gone.log", "x")], "name string, sha256 string")
    assert [tuple(r) for r in traces.manifest_violations(spark, f"{root}/*.log", want).collect()] == [("gone.log", "missing")]
    df = spark.createDataFrame([("m", "s", 1), ("m", "s", 1), ("m", "t", 2)], "module string, source string, sig int")
    assert sinks.export({"all": df}, f"{root}/out") == sinks.json_bytes(df)
    assert spark.read.json(f"{root}/out/all").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_trace(df, f"{root}/out/all")
    with pytest.raises(ValueError, match="over"):
        sinks.export({"more": df}, f"{root}/out", most_bytes=5)
    assert {(r["source"], r["samples"], r["distinct_samples"]) for r in sinks.manifest(df, "module", "source", "sig").collect()} == {("s", 2, 1), ("t", 1, 1)}
    sinks.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "k int, line string"), f"{root}/report", ["k"])
    assert sorted(r[0] for r in spark.read.text(f"{root}/report").collect()) == ["a", "b"]


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = f"file://{tmp_path}/events"
    table.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    e = lambda df: df.select(C.micros("ts").alias("us"), "event_id", "user_id", "event_type")
    run(S.consume_stream(e(stream)), "decisions")
    twin = {tuple(r) for r in S.consume(e(table)).collect()}
    assert {tuple(r) for r in spark.table("decisions").collect()} == twin and len(twin) == table.count()
    run(S.tumbling_counts(stream), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == table.count()
    run(S.once(stream, ["event_id"]), "once")
    assert spark.table("once").count() == table.count()
    run(S.barrier_stream(stream.filter("event_type = 'view'"), stream.filter("event_type = 'click'"), ["user_id"]), "pairs")
    v, c = (table.filter(F.col("event_type") == x).select("user_id", C.micros("ts").alias(x)) for x in ("view", "click"))
    assert spark.table("pairs").count() == v.join(c, "user_id").filter("abs(view - click) <= 3600000000").count()


def test_consumer_steps():
    state, actions = S.START, []
    for k, kind in enumerate(["purchase", "view", "purchase", "purchase", "error", "error", "signup", "view"]):
        state, action = S.advance(state, k, k, kind)
        actions.append(action)
    assert actions == ["empty", "delta", "start", "busy", "cancel", "idle", "ignored", "delta"]
    assert S.advance(state, 7, 7, "view")[1] == "duplicate"
