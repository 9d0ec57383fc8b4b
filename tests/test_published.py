"""Published scores of thirty cases, and small readers and writers."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from riverbed import catalog
from riverbed.functions.canonical import canonical
from riverbed.functions.scalars import clamp_low
from riverbed.operators import metrics as M
from riverbed.plans import load_all
from riverbed.sources import sinks, traces

load_all()

# Task, whether the turn was taken, and seconds from the end of the other's speech to the first word, as published.
CASES = [
    ("turn_taking", 1, 0.84), ("turn_taking", 1, -3.24), ("turn_taking", 1, -3.0), ("turn_taking", 1, 1.18), ("turn_taking", 0, None), ("turn_taking", 0, None), ("turn_taking", 1, 0.06), ("turn_taking", 0, None), ("turn_taking", 0, None), ("turn_taking", 0, 0.39),
    ("pause_recorded", 0, None), ("pause_recorded", 1, None), ("pause_recorded", 0, None), ("pause_recorded", 0, None), ("pause_recorded", 0, None),
    ("pause_synthetic", 0, None), ("pause_synthetic", 0, None), ("pause_synthetic", 0, None), ("pause_synthetic", 0, None), ("pause_synthetic", 1, None),
    ("interruption", 1, 0.16), ("interruption", 0, None), ("interruption", 0, None), ("interruption", 0, None), ("interruption", 1, 1.52), ("interruption", 1, 1.2), ("interruption", 0, None), ("interruption", 1, 0.32), ("interruption", 1, 8.0), ("interruption", 0, None),
]


def test_published_scores(spark):
    df = spark.createDataFrame(CASES, "task string, took int, raw double")
    took = F.col("took") == 1
    rows = df.groupBy("task").agg(*M.success_report(took, F.when(took, clamp_low(F.col("raw"), 0.0))), F.count_if(took & (F.col("raw") < 0)).alias("early")).collect()
    got = {r["task"]: tuple(r)[1:] for r in rows}
    assert got == {"turn_taking": (10, 5, 0.5, 5, 0.416, 2), "pause_recorded": (5, 1, 0.2, 0, None, 0), "pause_synthetic": (5, 1, 0.2, 0, None, 0), "interruption": (10, 5, 0.5, 5, 2.24, 0)}


def test_sums_do_not_depend_on_order(spark):
    values = [0.1 * k + 1e-7 * (k % 7) for k in range(999)]
    sums = {spark.createDataFrame([(v,) for v in vs], "v double").repartition(n).agg(M.exact_sum(F.col("v"))).first()[0] for n, vs in ((1, values), (5, values[::-1]), (3, values[500:] + values[:500]))}
    assert len(sums) == 1
    tie = spark.createDataFrame([(0.000001,), (0.000002,)], "v double").agg(*M.success_report(F.lit(True), F.col("v"))).first()
    assert tie["latency_mean"] == 0.000002  # halves of a microsecond go up


def test_sample_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["vec_id"]: r["digest"] for r in catalog.QUERIES["q_sample_digest"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert got == {r["vec_id"]: hashlib.sha256(struct.pack(f"<{len(r['embedding'])}f", *r["embedding"])).hexdigest() for r in rows}


def test_canonical_json(spark):
    df = spark.createDataFrame([({"b": [("x", None)], "a": None}, {"k": 1, "é": None})], "s struct<b:array<struct<z:string,y:int>>,a:string>, m map<string,int>")
    r = df.select(canonical(F.col("s"), df.schema["s"].dataType).alias("s"), canonical(F.col("m"), df.schema["m"].dataType).alias("m")).first()
    assert r["s"] == '{"a":null,"b":[{"y":null,"z":"x"}]}' and r["m"] == '{"k":1,"é":null}'
    assert r["s"] == json.dumps(json.loads(r["s"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_export_with_manifest(spark, tmp_path):
    samples = spark.createDataFrame([("m", "s", "1", "x"), ("m", "s", "2", "x"), ("n", "t", "3", "y")], "module string, source string, id string, sig string")
    counts = sinks.manifest(samples, "module", "source", "sig")
    root = f"file://{tmp_path}/out"
    told = sinks.export_with_manifest({"a": samples.filter("module = 'm'").coalesce(1), "b": samples.filter("module = 'n'").coalesce(1)}, counts, root).first()
    assert told["samples"] == 3 and [(c["module"], c["samples"], c["distinct_samples"]) for c in told["counts"]] == [("m", 2, 1), ("n", 1, 1)]
    for x in told["artifacts"]:
        files = sorted((tmp_path / "out" / x["artifact"]).glob("part-*"))
        assert (x["files"], x["bytes"]) == (len(files), sum(f.stat().st_size for f in files))
        assert x["sha256"] == hashlib.sha256("\n".join(hashlib.sha256(f.read_bytes()).hexdigest() for f in files).encode()).hexdigest()
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.export_with_manifest({"a": samples}, counts, root)


def test_fixed_samples(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    read = lambda sha=digest, n=2: traces.read_fixed_samples(spark, f"file://{path}", sha, "id", n, "id string")
    assert sorted(r["id"] for r in read().collect()) == ["a", "b"]
    for args in (("0" * 64, 2), (digest, 3)):
        with pytest.raises(ValueError):
            read(*args)
    path.write_text(json.dumps([{"id": "a"}, {"id": "a"}]))
    with pytest.raises(ValueError):
        read(hashlib.sha256(path.read_bytes()).hexdigest())
