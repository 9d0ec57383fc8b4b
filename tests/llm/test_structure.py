"""Fill-in-middle, conversation repair and nearest neighbours against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riverbed.llm import ann, conversations, fim
from riverbed.llm.common import Scratch
from riverbed.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op12_viterbi_repair", "op13_checkpoint_fim"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# fill-in-middle


def plain_middle(text, doc_id, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "\n \t", "a", " a", "a ", "日本語 テ　x\x1cy \x0b z", "<P> mark", "a <S", "<S> <M>", "< S> <P", "é" * 300 + "  ü " * 200, "<" * 50 + " <S " * 40, "x\r\n\r\ny. ", "word " * 40_000, "\U0001f600 " * 999 + "end"]


@pytest.mark.parametrize("step,window", [(512, 1 << 16), (1, 4), (3, 7), (5, 64)])
def test_middle(spark, step, window):
    rows = [(k, t) for k, t in enumerate(ODD * 4 if window > 64 else ODD)] + [(k, "t %d  é\n" % k * (k % 7)) for k in range(100, 200)] + [(None, "null id"), (None, "null id"), (150, "again"), (150, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit("clash")).withColumn("n", F.lit(None))
    out = fim.fill_in_middle(df, step=step, window=window)
    got = [tuple(r) for r in out.withColumn("back", fim.restored("output", "form")).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_middle(t, i), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_checkpoints_are_sparse():
    text = ("wörd  é\n" * 5000).encode()
    data = np.frombuffer(text, np.uint8)
    units = list(UNIT.finditer(text.decode()))
    index = fim.Checkpoints(data, step=100, window=999)
    assert index.n == len(units) and len(index.unit) == 1 + len(units) // 100
    for k in (0, 1, 99, 100, 101, 5000, len(units) - 1, len(units)):
        end = units[k - 1].end() if k else 0
        assert index.cut(k) == (len(text.decode()[:end].encode()), end)


# conversations


def plain_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        kept = out[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [row] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def plain_repair(rows):
    """By trying all edits, at most two inserts at a time; the cheapest so far bounds the rest."""
    blank = duplicate = truncated = 0
    marked, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip("\x20\t\n\x0b\x0c\r")
        b, d = not bare, bool(bare) and (role, text) in seen
        t = not b and not d and bare[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + b, duplicate + d, truncated + t
        marked.append((role, text, b or d, t))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = [(2 * len(rows), "D" * len(rows), "")]

    def go(k, cost, audit, lines, inserted):
        if cost > best[0][0]:
            return
        roles = "".join(x[:1] for x in lines)
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit, "\n".join(lines)))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 5, audit + "I", [*lines, role + ":"], inserted + 1)
        if k < len(rows):
            role, text, useless, t = marked[k]
            go(k + 1, cost + 2, audit + "D", lines, 0)
            if not useless:
                go(k + 1, cost + 5 * t, audit + "K", [*lines, f"{role}:{text}"], 0)
                for other in ("user", "assistant"):
                    go(k + 1, cost + 1 + 5 * t, audit + "R", [*lines, f"{other}:{text}"], 0)

    go(0, 0, "", [], 0)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, text = best[0]
    return (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), text


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["yes.", "no!", "what?", "cut off", "cut", " \t", "", None, "a\nb. \n", "ü. ", "more.", "still more."]
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randrange(most + 1)):
            turn += rng.choice((0, 1, 1, 1, 1, 3))
            rows.append((c if c else None, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)))
    return rows


def test_repair(spark):
    rows = random_turns(3, 250, 6) + [(1000, 5, "user", "same."), (1000, 5, "user", "same."), (1000, 5, "user", "same.")]
    rng = random.Random(4)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("blank", F.lit("clash")).withColumn("gone", F.lit(3)).withColumn("audit", F.lit("q"))
    turns = conversations.damage(df)
    report = conversations.repair(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    damaged = plain_damage(rows)
    want = {c: plain_repair(x) for c, x in damaged.items()}
    assert got == {c: w for c, (w, _) in want.items()}
    lines = defaultdict(dict)
    for r in conversations.repaired_turns(turns, report).collect():
        lines[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    assert {c: "\n".join(x[k] for k in range(len(x))) for c, x in lines.items()} == {c: t for c, (_, t) in want.items() if t}
    assert [x for x in damaged.values() if not x], "a conversation whose rows are all gone"
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


def test_repair_of_a_long_conversation(spark):
    """Audits agree but for their ends, so the time is that of the turns; the order of rows in the table does not matter."""
    rng = random.Random(8)
    rows = [(7, k, rng.choice(("user", "assistant")), f"turn {k}{rng.choice('.?! x')}") for k in range(20_000)]
    want = conversations.Repair()
    for _, role, text in plain_damage(rows)[7]:
        want.add(role, text, not text.strip(), text.rstrip()[-1:] not in (".", "!", "?"))
    rng.shuffle(rows)
    got = conversations.repair(conversations.damage(spark.createDataFrame(rows, TURNS))).collect()
    assert len(got) == 1
    cost, audit, _ = want.best()
    assert got[0]["duplicate"] > 0 and len(audit) >= 18_000
    assert max(len(s[1]) for s in want.states.values()) < 2 * conversations.TAIL
    assert re.fullmatch("[KRDI]+", got[0]["audit"]) and got[0]["audit"].count("I") + len(plain_damage(rows)[7]) == len(got[0]["audit"])


# nearest neighbours


def plain_neighbours(rows, k, asks):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, v) in enumerate(good):
        if asks(i):
            found = []
            for b, (j, w) in enumerate(good):
                if a != b and len(v) == len(w):
                    s = 0.0
                    for x, y in zip(v.tolist(), w.tolist()):
                        s += x * y
                    found.append((-s, j))
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(found)[:k]])
    return out


def listed(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def recall(got, want):
    hit = total = 0
    for q, lists in want.items():
        mine = {(v, s) for _, v, s in got.get(q, [])}
        hit += len(mine & set(lists[0]))
        total += len(lists[0])
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    asks = lambda i: i % 20 == 0
    got = listed(ann.neighbours(df.withColumn("uid", F.lit(0)).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0, block_rows=256, query_rows=40))
    want = plain_neighbours(rows, 20, asks)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert sorted(found, key=lambda x: (-x[2], x[1])) == found
    share = recall(got, want)
    print("recall", sf, share)
    assert share >= 0.93


def test_every_row_within_the_radius_is_found(spark):
    """Pigeonhole probing against all codes, with cells and cuts in both tables."""
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((900, 24)))] + [(2000 + i, [1.0] * 24) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scratch = Scratch(spark)
    valid = scratch.save(ann.valid(df))
    model = ann.fit(valid, 10)
    code = {r["vec_id"]: np.array(r["code"], np.uint16) for r in ann.coded(valid, model, False).collect()}
    asked = ann.coded(valid.filter("vec_id % 50 = 0"), model, True)
    mine = {r["vec_id"]: np.array(r["code"], np.uint16) for r in asked.collect()}
    index = scratch.save(ann.coded(valid, model, False))
    for radius in (0, 3, 14, 27, 64):
        want = {(q, i) for q, x in mine.items() for i, y in code.items() if q != i and np.bitwise_count(x ^ y).sum() <= radius}
        got = [(r["query_id"], r["vec_id"]) for r in ann.search(scratch, index, asked, model, radius, 10_000, 64, 5).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_rounds():
    assert ann.rounds(0, 9) == [(0, 0)] and ann.rounds(5, 0) == [(0, 0)] and ann.rounds(2, 6) == [(0, 0), (1, 2)]
    for lead in range(17):
        plan = ann.rounds(lead, 16)
        assert [b for low, high in plan for b in range(low, high + 1)] == list(range(lead + 1))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * k, [float(k % 3), 1.0, -1.0]) for k in range(12)] + [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (40, [inf, 1.0, 1.0]), (5, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (60, [9.0, 9.0]), (7, [1e30, 1.0, 1.0]), (9, [1e-30, 0.0, 0.0])]
    rows += [(9, [2.0, 2.0, 2.0]), (11, [2.0, 2.0, 2.0]), (11, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, lambda i: i % 20 == 0)
    got = listed(ann.neighbours(df, F.col("vec_id") % 20 == 0))
    assert got == {q: [(r + 1, *x) for r, x in enumerate(x[0])] for q, x in want.items() if x[0]}
    assert 60 in got and len(got[0]) == 16  # a vector of another length asks only its like
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0])], df.schema)
    assert ann.neighbours(alone, F.lit(True)).count() == 0
    # repeated rows ask one by one and find each other
    twice = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, 2.0])], df.schema)
    assert sorted(tuple(r) for r in ann.neighbours(twice, F.col("vec_id") % 20 == 0).collect()) == [(20, 1, 3, 5.0)] * 2 + [(20, 2, 20, 5.0)] * 2
