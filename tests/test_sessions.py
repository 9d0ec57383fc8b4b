"""Folds as streams: the same rows as their batch form, whatever the micro-batches."""

import json
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from riverbed.plans import sessions
from riverbed.streaming import analysis, growing
from riverbed.streaming.growing import Growing

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(pieces, cancel=False, first=20, limit=40):
    from collections import namedtuple

    row = namedtuple("row", "seq kind text")
    g = Growing(first, limit)
    state, out = g.start, []
    for k, p in enumerate(pieces):
        state, found = g.step(state, row(k, "delta", p))
        out += found
    return out + g.step(state, row(len(pieces), "done", None))[1]


def whole(text, first=20, limit=40):
    from riverbed.operators.text import segment_ends

    ends = segment_ends(text, limit, first)
    return [s for s in (text[a:b].strip() for a, b in zip([0, *ends], ends)) if s]


def test_cuts_decide_only_at_sentence_marks():
    """All cuttings of a text into deltas give the segments of the whole text, unless a delta ends with a mark or within the white space after one."""
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["word", "a", " ", " ", ". ", "! ", "3.14", "?", "\n", "verylongwordwithoutanyblank" * 2]) for _ in range(rng.randrange(1, 40)))
        places = [k for k in range(1, len(text)) if not (text[:k].rstrip() or " ")[-1] in ".!?"]
        cuts = sorted(rng.sample(places, min(len(places), rng.randrange(8))))
        got = fold([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        assert [s for _, s, k in got if k == "segment"] == whole(text), (text, cuts)
        assert got[-1][2] == ("end" if text.strip() else "empty")


@pytest.mark.parametrize(
    ("pieces", "want"),
    [
        (["U.", "S. is"], ["U.", "S.", "is"]), (["U.S. is"], ["U.S.", "is"]), (["3.", "14"], ["3.", "14"]), (["3", ".14"], ["3.14"]), ([], None), ([" ", "\n"], None), (["", "x"], ["x"]),
        (["a" * 30, "b"], ["a" * 20, "a" * 10 + "b"]), (["one two three four five six"], ["one two three four", "five six"]),
    ],
)
def test_growing_golden(pieces, want):
    got = fold(pieces)
    assert [s for _, s, k in got if k == "segment"] == (want or [])
    assert got[-1][1:] == (None, "end" if want else "empty")


def files(rows, parts):
    """A folder of JSON lines, one file a micro-batch."""
    d = tempfile.mkdtemp(prefix="spark-")
    for k in range(parts):
        with open(f"{d}/{k:03}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[k * len(rows) // parts : (k + 1) * len(rows) // parts])
        os.utime(f"{d}/{k:03}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by their times
    return d


def streamed(spark, schema, folder, operator):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = "out_" + uuid.uuid4().hex
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    q = operator(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return sorted(map(repr, (tuple(r) for r in spark.table(name).collect())))


def test_segments_of_a_stream(spark):
    rows = [r.asDict() for r in sessions.deltas(spark, SF).orderBy(F.rand(1)).collect()]
    keys = sorted({r["key"] for r in rows})[:40]
    rows = [r for r in rows if r["key"] in keys]
    rng = random.Random(5)
    when = {k: rng.random() for k in keys}
    rows.sort(key=lambda r: (when[r["key"]] + r["seq"] / 50, r["key"]))  # in order for each key, keys interleaved
    again = rows[: len(rows) // 3] + rows[len(rows) // 4 :]  # some come twice
    want = sorted(map(repr, (tuple(r) for r in growing.segments_batch(spark.createDataFrame(rows, growing.DELTAS)).collect())))
    assert {"segment", "end", "empty", "cancelled", "after_end"} == {json.loads(json.dumps(eval(r)))[3] for r in want}
    assert streamed(spark, growing.DELTAS, files(again, 5), growing.segments_stream) == want
    assert growing.segments_batch(spark.createDataFrame([], growing.DELTAS)).count() == 0


def cycle(*rows, budget=8, timeout_ms=1000):
    a = analysis.Analysis(budget, timeout_ms)
    from collections import namedtuple

    row = namedtuple("row", "us id kind progress result")
    state, out = a.start, []
    for k, r in enumerate(rows):
        us, kind, progress, result = (*r, None, None)[:4]
        state, found = a.advance(state, row(us * 1000, k, kind, progress, result))
        out += found
    return [(x[2], x[3], x[4], x[5], x[6]) for x in out]


def test_analysis_golden():
    # a gap is analysed in two calls, the second of which ends the task
    assert cycle((0, "update"), (1, "request"), (2, "return", "continue"), (3, "return", "done", "R")) == [
        ("cycle_started", 1, 1, 1, None), ("cycle_started", 1, 2, 1, None), ("result_published", 1, 2, 1, "1:R")]
    # a word that comes during the last call: the result is withheld, the next call reads it
    assert cycle((0, "update"), (1, "request"), (2, "update"), (3, "return", "done", "old"), (4, "return", "done", "new")) == [
        ("cycle_started", 1, 1, 1, None), ("result_withheld", 1, 1, 1, "old"), ("cycle_started", 1, 2, 2, None), ("result_published", 1, 2, 2, "1:new")]
    # waiting is ended by words only, and not at all if they came during the call
    assert cycle((0, "request"), (1, "return", "await_input"), (2, "audio"), (3, "receipt"), (4, "request"), (5, "update")) == [
        ("cycle_started", 1, 1, 0, None), ("waiting", 1, 1, 0, None), ("request_merged", 1, 1, 0, None), ("cycle_started", 1, 2, 1, None)]
    assert cycle((0, "request"), (1, "update"), (2, "return", "await_input")) == [("cycle_started", 1, 1, 0, None), ("cycle_started", 1, 2, 1, None)]
    # no result without one; a failure ends the task, and a request starts the next
    assert cycle((0, "request"), (1, "return", "done"), (2, "return", "done", "R"), (3, "request"), (4, "return", "done", "R")) == [
        ("cycle_started", 1, 1, 0, None), ("failed", 1, 1, 0, None), ("stray_return", 1, 1, 0, None), ("cycle_started", 2, 1, 0, None), ("result_published", 2, 1, 0, "1:R")]
    assert cycle((0, "request"), (1, "return", "continue"), (2, "return", "continue"), budget=2)[-1] == ("budget_spent", 1, 2, 0, None)
    assert cycle((0, "request"), (2000, "return", "done", "R")) == [("cycle_started", 1, 1, 0, None), ("timed_out", 1, 1, 0, None), ("stray_return", 1, 1, 0, None)]


def test_analysis_of_a_stream(spark):
    rows = [r.asDict() | {"ts": r["ts"].isoformat()} for r in sessions.analysis_events(spark, SF).orderBy("us", "id").collect()]
    day = 86_400_000
    want = analysis.analysis_batch(sessions.analysis_events(spark, SF), 3, day // 2)
    assert {"timed_out", "result_withheld", "result_published", "waiting", "request_merged", "stray_return", "failed", "budget_spent", "cycle_started"} == {r["action"] for r in want.select("action").distinct().collect()}
    want = sorted(map(repr, (tuple(r) for r in want.collect())))
    # two more micro-batches move the watermark to the last event and let timers fire; their rows wake nothing
    last = rows[-1]
    folder = files([*rows, *({**last, "id": last["id"] + k, "kind": "audio", "us": last["us"] + k, "session": -1} for k in (1, 2))], 5)
    got = streamed(spark, analysis.EVENTS, folder, lambda s: analysis.analysis_stream(s, 3, day // 2))
    assert got == want


# joint batches and the state that readers see


def states(df):
    return {(r["session_id"], r["turn_id"]): (r["step_id"], r["text"]) for r in df.collect()}


def test_spoilt_batches(spark):
    """A row for every label, from the turns that were spoilt that way and no others; clean turns give none."""
    from riverbed.plans import joint as P

    t = P.turns(spark, SF)
    faults = {(r["session_id"], r["turn_id"]): r["fault"] for r in t.select("session_id", "turn_id", "fault").distinct().collect()}
    rows = P.batches(t)
    from riverbed.operators import joint as G

    assert set(G.guards()) <= {label for k in P.ALONE for label in P.SPOILT[k][1]}
    got = {(r["session_id"], r["turn_id"], r["step_id"], r["label"]) for r in G.violations(rows).collect()}
    want = {(s, i, P.SPOILT[f][0], x) for (s, i), f in faults.items() if f in P.ALONE for x in P.SPOILT[f][1]}
    last = {(r["session_id"], r["turn_id"]): r["last"] for r in t.select("session_id", "turn_id", "last").distinct().collect()}
    assert got == {w for w in want if w[2] <= last[w[:2]]}
    clean = rows.join(t.filter("fault is null").select("session_id", "turn_id").distinct(), ["session_id", "turn_id"])
    assert clean.count() > 0 and G.violations(clean).count() == 0
    assert G.violations(rows.limit(0)).count() == 0
    # a batch of nothing breaks rules instead of failing
    nothing = spark.createDataFrame([("s", "t", *[None] * 11)], G.COLUMNS)
    assert {"source_range", "invalid_time", "lane_missing"} <= {r["label"] for r in G.violations(nothing).collect()}


def test_context_stream_and_latest_table(spark):
    """A stream of calls leaves in the table what its batch form says; a replayed micro-batch changes nothing, a spoilt one leaves the row, a torn version is not seen."""
    from riverbed.plans import joint as P
    from riverbed.streaming import context
    from riverbed.streaming.publish import VERSION, LatestTable

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    table = [r.asDict() for r in P.calls(spark, SF).orderBy("seq", "session_id", "turn_id").collect()]
    table = [r for r in table if int(r["session_id"][1:]) < 8]
    folder = files(table, 4)
    stored = spark.createDataFrame(table, context.CALLS)
    batch = context.context_batch(stored)
    took = batch.filter("kind = 'batch' and label is null")
    schema = took.schema
    store = LatestTable(spark, f"file://{tempfile.mkdtemp(prefix='spark-')}/latest", ["session_id", "turn_id"], "step_id", buckets=8)
    accepted = lambda df: df.filter("kind = 'batch' and label is null")
    source = spark.readStream.schema(context.CALLS).option("maxFilesPerTrigger", 1).json(folder)
    q = context.context_stream(source).writeStream.foreachBatch(store.sink(accepted)).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    want = states(took.groupBy("session_id", "turn_id").agg(F.max_by(F.struct("step_id", "text"), "step_id").alias("x")).select("session_id", "turn_id", "x.*"))
    assert states(store.read(schema)) == want and len(want) > 40
    done = store.versions()
    # the same micro-batch again, and an older one: nothing changes
    one = spark.createDataFrame(took.filter("step_id = 0").limit(1).collect(), schema)
    assert not store.merge(one, done[-1]) and not store.merge(one.withColumn("step_id", F.lit(99).cast("long")), done[-1] - 1)
    assert states(store.read(schema)) == want
    # an older row does not replace a newer one, a newer does; other keys stay
    assert store.merge(one, done[-1] + 1) and states(store.read(schema)) == want
    new = one.withColumn("step_id", F.lit(99).cast("long")).withColumn("text", F.lit("new"))
    assert store.merge(new, done[-1] + 2)
    key = (one.first()["session_id"], one.first()["turn_id"])
    assert states(store.read(schema)) == want | {key: (99, "new")}
    # a version that was cut off is not seen, and is written anew
    (where, fs), torn = store._folder(f"{VERSION}={done[-1] + 2}/_SUCCESS"), done[-1] + 2
    fs.delete(where, False)
    assert states(store.read(schema)) == want
    assert store.merge(new, torn) and states(store.read(schema)) == want | {key: (99, "new")}
    store.vacuum()
    assert states(store.read(schema)) == want | {key: (99, "new")}


def test_context_bounds(spark):
    """A text or a state beyond its bound is refused, and the state stays."""
    from riverbed.plans import joint as P
    from riverbed.streaming import context

    t = P.turns(spark, SF).filter("fault is null and last = 7")
    rows = context.calls(P.batches(t.join(t.groupBy("session_id").agg(F.min("turn_id").alias("turn_id")), ["session_id", "turn_id"]))).unionByName(
        t.filter("step = 0").select("session_id", "turn_id", F.lit(-1).cast("long").alias("seq"), F.lit("open").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("payload")))
    got = {(r["seq"], r["label"]) for r in context.context_batch(rows, most_chars=7).collect() if r["kind"] == "batch"}
    assert got == {(0, None), (1, None), (2, None), (3, None), (4, "text_limit"), (5, "out_of_step"), (6, "out_of_step"), (7, "out_of_step")}
    assert {r["label"] for r in context.context_batch(rows, most_bytes=10).collect() if r["seq"] == 0} == {"state_limit"}


# replies, queues, lifecycles


def run_replies(*rows):
    from collections import namedtuple

    from riverbed.streaming.replies import Replies

    row = namedtuple("row", "seq kind step_id token accepted delta chars crc request text tail version")
    r = Replies()
    state, out = r.start, []
    for k, x in enumerate(rows):
        state, found = r.step(state, row(k, x["kind"], *(x.get(c) for c in row._fields[2:])))
        out += [tuple(f[1:]) for f in found]
    return out, state


def published(step, token, delta, chars, crc=None, accepted=True):
    return {"kind": "state", "step_id": step, "token": token, "accepted": accepted, "delta": delta, "chars": chars, "crc": crc}


def test_replies_golden():
    import zlib

    said, _ = run_replies(
        published(0, "user_idle", "Hi", 0), published(1, "user_complete", " there", 2), {"kind": "played", "request": "r1", "text": " Hello.", "tail": 80}, published(2, "user_complete", " again", 8),
        {"kind": "repaired", "request": "r1", "version": 1, "text": "How"}, {"kind": "repaired", "request": "r1", "version": 1, "text": "late"}, published(3, "user_nonidle", "", 14), published(4, "user_complete", " and", 14, zlib.crc32(b"Hi there again")),
        published(4, "user_idle", "", 18), published(5, "user_idle", "", 17), published(5, "user_idle", "", 18, 1), {"kind": "completed", "request": "r1"}, {"kind": "played", "request": "r3", "text": "Yes.", "tail": 0}, {"kind": "completed", "request": "r3"}, published(5, "user_complete", "  ", 18),
    )
    assert said == [
        ("user_entry", "r1", "Hi there", None), ("reply_started", "r1", "Hi there", None),
        # new words while a reply is busy cancel it; what was heard becomes an entry, the samples beyond it wait for repair
        ("cancelled", "r1", "new_complete", None), ("history_pending", "r1", None, 1), ("assistant_entry", "r1", "Hello.", None), ("user_entry", "r2", "again", None), ("reply_started", "r2", "again", None),
        ("history_repaired", "r1", "Hello. How", 1), ("repair_stale", "r1", None, None),
        # nothing was heard of the second, so the user's next words join their last
        ("cancelled", "r2", "nonidle", None), ("user_merged", "r3", "and", None), ("reply_started", "r3", "and", None),
        ("missing_step", None, None, None), ("prefix_changed", None, None, None), ("prefix_changed", None, None, None), ("stray_completion", "r1", None, None),
        ("assistant_entry", "r3", "Yes.", None), ("completed", "r3", None, None), ("complete_without_new_text", None, None, None),
    ]


def test_repairs_are_bounded():
    from riverbed.streaming import replies

    rows, chars = [], 0
    for k in range(replies.MOST_REPAIRS + 2):
        rows += [published(k, "user_complete", "x", chars), {"kind": "played", "request": f"r{k + 1}", "text": "", "tail": 1}]
        chars += 1
    said, state = run_replies(*rows)
    assert [s[0] for s in said].count("too_many_repairs") == 1 and len(json.loads(state[-1])) == replies.MOST_REPAIRS


def test_replies_of_a_stream(spark):
    from riverbed.streaming import replies

    events = sessions.reply_events(spark, SF)
    want = replies.replies_batch(events)
    assert {"missing_step", "prefix_changed", "cancelled", "history_pending", "assistant_entry", "user_entry", "reply_started", "late_audio_discarded", "stray_completion", "complete_without_new_text"} <= {r["action"] for r in want.select("action").distinct().collect()}
    rows = [r.asDict() for r in events.orderBy("seq", "session").collect()]
    assert streamed(spark, replies.EVENTS, files(rows, 3), replies.replies_stream) == sorted(map(repr, (tuple(r) for r in want.collect())))


def test_bounded_queue(spark):
    from riverbed.operators import queues

    rng = random.Random(6)
    jobs = {k: sorted((rng.randrange(1000), i, rng.choice((0, 5, 60, 200))) for i in range(60)) for k in (1, 2)}
    rows = [(k, at, i, s) for k, x in jobs.items() for at, i, s in x]
    schema = "key long, arrival long, id long, service long"
    df = spark.createDataFrame(rows, schema)
    want = []
    for k, x in jobs.items():  # plainly, with the queue itself
        starts, free = [], -1
        for at, i, s in x:
            if sum(t > at for t in starts) >= 2:
                want.append((k, at, i, "refused", None))
                continue
            t = max(at, free)
            starts.append(t)
            free = t + s
            want.append((k, at, i, "late" if t - at > 50 else "taken", t))
    assert {w[3] for w in want} == {"taken", "late", "refused"}
    assert sorted(map(repr, (tuple(r) for r in queues.bounded_batch(df, 50).collect()))) == sorted(map(repr, want))
    ordered = [dict(zip(("key", "arrival", "id", "service"), r)) for r in sorted(rows, key=lambda r: r[1:])]
    assert streamed(spark, schema, files(ordered, 3), lambda s: queues.bounded_stream(s, 50)) == sorted(map(repr, want))
    # without a bound: by the running maximum, cut into many parts
    got = {r["id"]: (r["start"], r["finish"], r["wait"], r["missed"]) for r in queues.waits(df.filter("key = 1"), ["key"], ["arrival", "id"], "arrival", "service", 50, part_rows=7).collect()}
    free = -1
    for at, i, s in jobs[1]:
        t = max(at, free)
        free = t + s
        assert got[i] == (t, free, t - at, t - at > 50)


def test_lifecycle_stream(spark):
    """The stream tells what the window over all rows tells; keys idle beyond their time leave the state; a full state is told."""
    import time

    from riverbed.operators import rules
    from riverbed.streaming import lifecycle

    rng = random.Random(9)
    rows = [(rng.randrange(3), k, k, f"k{rng.randrange(9)}", rng.choice(("open", "close", "release"))) for k in range(200)]
    table = spark.createDataFrame(rows, lifecycle.ACTIONS)
    want = sorted(map(repr, (tuple(r) for r in rules.key_lifecycle(table, ["key"], ["us", "id"], "action", 2, ["scope"]).collect())))
    as_dicts = [dict(zip(("scope", "us", "id", "key", "action"), r)) for r in rows]
    assert streamed(spark, lifecycle.ACTIONS, files(as_dicts, 4), lambda s: lifecycle.lifecycle_stream(s, 2)) == want
    full = streamed(spark, lifecycle.ACTIONS, files(as_dicts, 2), lambda s: lifecycle.lifecycle_stream(s, 2, entries=3))
    assert sum("state_full" in r for r in full) > 0

    # a key is known as long as something comes for it, and forgotten after its time
    folder, found = tempfile.mkdtemp(prefix="spark-"), []
    source = spark.readStream.schema(lifecycle.ACTIONS).json(folder)
    q = lifecycle.lifecycle_stream(source, 9, ttl_ms=20_000).writeStream.foreachBatch(lambda df, i: found.extend(r["us"] for r in df.collect())).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(processingTime="1 second").start()

    def give(k):
        with open(f"{folder}/.{k}", "w") as f:
            f.write(json.dumps({"scope": 1, "us": k, "id": k, "key": "a", "action": "open"}) + "\n")
        os.rename(f"{folder}/.{k}", f"{folder}/{k}.json")
        until = time.time() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < k and time.time() < until:
            time.sleep(0.2)

    try:
        give(1)
        give(2)
        time.sleep(25)
        give(3)
        give(4)
    finally:
        q.stop()
    assert q.exception() is None and found == [2, 4]


# decoders, prefixes, lanes


def test_decoders(spark):
    from riverbed.operators import decode

    rows = [("a", 0, [300, 301, 2]), ("a", 1, [5, 2, 9]), ("a", 2, [2]), ("a", 3, [7]), ("a", 4, [7, 33, 2]), ("a", 5, [9] * 63 + [2]), ("a", 6, [9] * 64 + [2]), ("a", 7, [9] * 70), ("b", 0, None)]
    df = spark.createDataFrame(rows, "key string, seq long, tokens array<int>")
    got = {(r["key"], r["seq"]): (r["pos"], r["delta"], r["chars"], r["failure"]) for r in decode.closed_groups(df.filter("tokens is not null"), "numbers").collect()}
    nines = " ".join(["9"] * 63)
    assert got == {("a", 0): (0, "300 301", 7, None), ("a", 1): (1, " 5", 9, None), ("a", 2): (None, None, 9, "empty"), ("a", 3): (None, None, 9, "no_eos"), ("a", 4): (None, None, 9, "control_token"), ("a", 5): (2, " " + nines, 10 + len(nines), None), ("a", 6): (None, None, 10 + len(nines), "too_long"), ("a", 7): (None, None, 10 + len(nines), "too_long")}

    @decode.decoder("shout")
    def shout(ids):
        import pyarrow as pa

        return pa.array([None if x is None else "A" * len(x) for x in ids.to_pylist()], pa.string())

    decode.JOINERS["eats"] = lambda end, part: (1, part) if end.endswith("A") else (0, part + "A")
    got = [(r["seq"], r["delta"], r["failure"]) for r in decode.closed_groups(df.filter("seq < 2 and key = 'a'"), "shout", "eats").orderBy("seq").collect()]
    assert got == [(0, "AAA", None), (1, None, "rewrote")]
    decode.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM decode_groups(array(300L, 301L), 'letters')").collect()] == [("letters", 2, "op")]
    del decode.DECODERS["shout"], decode.JOINERS["eats"]


def test_prefix_hashes_know_texts_however_cut(spark):
    from riverbed.operators import prefixes as P

    rng = random.Random(4)
    text = "".join(rng.choice("abcé日\U0001f600 ") for _ in range(400))
    rows = []
    for key in range(4):
        cuts = sorted(rng.sample(range(1, 400), 9))
        rows += [(key, k, text[a:b], text[:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 400]))]
    df = spark.createDataFrame(rows, "key long, k long, d string, so_far string")
    got = P.prefix_hashes(df, ["key"], ["k"], F.col("d"), part_rows=7)
    ends = {(r["chars"], r["a"], r["b"]) for r in got.filter("k = 9").collect()}
    assert len(ends) == 1 and next(iter(ends))[0] == 400
    whole_hash = spark.createDataFrame([(text,)], "t string").select(P.text_hash(F.col("t")).alias("h")).first()["h"]
    assert ends == {(whole_hash["chars"], whole_hash["a"], whole_hash["b"])}
    assert P.rewrites(df, ["key"], ["k"], F.col("d"), F.col("so_far"), 7).count() == 0
    other = df.withColumn("so_far", F.when((F.col("key") == 2) & (F.col("k") == 5), F.concat(F.lit("x"), F.substr("so_far", F.lit(2)))).otherwise(F.col("so_far")))
    assert [(r["key"], r["k"]) for r in P.rewrites(other, ["key"], ["k"], F.col("d"), F.col("so_far"), 7).collect()] == [(2, 5)]
    assert P.powers(7, 11, 5).tolist() == [1, 7, 5, 2, 3]


def test_lanes(spark):
    from riverbed.operators import lanes as L

    packets = [("a", 2000, 0.5, False), ("a", 2000, 0.6, False), ("a", 5120, 1.0, False), ("a", 5200, 2.0, True), ("b", 2559, 0.1, False), ("c", 2560, 0.1, True), ("d", 0, 0.1, True)]
    got = [tuple(r) for r in L.single_lane(spark.createDataFrame(packets, "run_id string, end long, at double, eof boolean"), part_rows=3).orderBy("run_id", "step_id").collect()]
    assert got == [("a", 0, 0, 2560, 1.0), ("a", 1, 2560, 5120, 1.0), ("a", 2, 5120, 5200, 2.0), ("c", 0, 0, 2560, 0.1)]
    windows = [("r", 0, 0, 4, [1, 2, 3, 4]), ("r", 1, 2, 6, [3, 4, 5, 6]), ("r", 2, 4, 8, [5, 7, 8, 9]), ("r", 3, 7, 11, [8, 9, 1, 1]), ("r", 4, 8, 12, [1, 1, 2, 2])]
    df = spark.createDataFrame(windows, "run_id string, k long, begin long, end long, samples array<int>").withColumn("provenance", F.lit(4)).withColumn("sha256", L.digest(F.col("samples")))
    assert {(r["k"], r["label"]) for r in L.window_violations(df, 4, 2).collect()} == {(2, "changed"), (3, "gap"), (4, "overlap")}


# samples as they arrive


def test_readiness(spark):
    """Steps leave with the packet that completes them, at once for all that it completes; the stream tells what the batch tells, and the lane alone what the other operator finds by scans."""
    from riverbed.operators import lanes
    from riverbed.streaming import ledger

    rng = random.Random(11)
    rows = []
    for run in range(6):
        sizes = [rng.choice((0, 100, 900, 2560, 6000)) for _ in range(12)]
        rows += [(run, k, 0.5 * k, n, k == 11 and run != 3) for k, n in enumerate(sizes)]
    rows.append((1, 12, 6.0, 50, False))
    df = spark.createDataFrame(rows, ledger.PACKETS)
    want = ledger.readiness_batch(df).collect()
    as_dicts = [dict(zip(("run_id", "seq", "at", "samples", "eof"), r)) for r in sorted(rows, key=lambda r: r[1])]
    assert streamed(spark, ledger.PACKETS, files(as_dicts, 3), ledger.readiness_stream) == sorted(map(repr, map(tuple, want)))
    assert [tuple(r)[1] for r in want if r["step_id"] == -1] == [-1]
    total = {run: sum(r[3] for r in rows if r[0] == run and r[1] < 12) for run in range(6)}
    for run in range(6):
        mine = sorted((r for r in want if r["run_id"] == run and r["step_id"] >= 0), key=lambda r: r["step_id"])
        assert [r["step_id"] for r in mine] == list(range(len(mine)))
        assert len(mine) == (max(0, (total[run] - 640) // 2560) if run == 3 else -(-total[run] // 2560))
    ends = df.filter("seq < 12").withColumn("end", F.expr("sum(samples) over (partition by run_id order by seq)"))
    alone = lanes.single_lane(ends.select(F.col("run_id").cast("string").alias("run_id"), "end", "at", "eof"))
    assert sorted((int(r["run_id"]), r["step_id"], r["begins"], r["processed_until"], r["ready_at"]) for r in alone.collect()) == sorted(tuple(r) for r in ledger.readiness_batch(df.filter("seq < 12"), ahead=0).collect())


def test_sample_ledger(spark):
    from riverbed.plans import lanes as L
    from riverbed.streaming import ledger

    calls = [(1, 0, "append", None, 600), (1, 1, "append", None, 500), (1, 2, "append", None, 400), (1, 3, "advance", "a", 9000), (1, 4, "advance", "b", 600), (1, 5, "append", None, 500), (1, 6, "advance", "c", 1), (1, 7, "advance", "b", 400)]
    got = [tuple(r)[1:] for r in ledger.ledger_batch(spark.createDataFrame(calls, ledger.CALLS), ("a", "b"), 1000).orderBy("seq").collect()]
    # the second would take what is held to 1100: refused, so the third stands where it would have; a consumer passes no more than has come
    assert got == [(0, "stored", 0, 600, 600), (1, "refused", 600, 1100, 600), (2, "stored", 600, 1000, 1000), (4, "evicted", 0, 600, 400), (5, "stored", 1000, 1500, 900), (6, "unknown_consumer", None, None, 900), (7, "evicted", 600, 1000, 500)]
    table = L.ledger_calls(spark, SF)
    want = ledger.ledger_batch(table, ("a", "b"), 1500)
    assert {"stored", "refused", "evicted"} == {r["action"] for r in want.select("action").distinct().collect()} and want.agg(F.max("held")).first()[0] <= 1500
    rows = [r.asDict() for r in table.orderBy("seq", "run_id").collect()]
    assert streamed(spark, ledger.CALLS, files(rows, 3), lambda s: ledger.ledger_stream(s, ("a", "b"), 1500)) == sorted(map(repr, (tuple(r) for r in want.collect())))
