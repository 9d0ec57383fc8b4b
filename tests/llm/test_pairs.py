"""Components, near-duplicate documents, repeated passages and the vector join against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riverbed.llm.buckets import cross_links, tune_bands
from riverbed.llm.common import Scratch, bytes_of, mix, odd, words
from riverbed.llm.components import components
from riverbed.llm.near_dup import bag_minhash, drop_near_duplicates, near_duplicates
from riverbed.llm.substring import REACH, RUN, drop_repeats, paragraphs, similar_paragraphs, without_words
from riverbed.llm.vectors import range_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_counts(text, size=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def prose(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(4000)) for _ in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == classes(used, [e for e in edges if e[0] != e[1]])
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands():
    for t in (0.6, 0.8, 0.9):
        b, r = tune_bands(t)
        assert 1 - (1 - t**r) ** b >= 0.999


def test_bag_minhash_is_unbiased():
    a, b = {1: 1, 2: 5, 3: 2, 4: 40, 5: 1}, {1: 1, 2: 3, 3: 9, 4: 33, 6: 2}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    rows = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    keys = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = bag_minhash(rows, keys, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert np.isfinite(s).all()


def fixture_docs():
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = prose(rng, rng.randrange(60, 200))
        rows.append((10 * k, " ".join(words)))
        for c in range(k % 4):
            other = list(words)
            for _ in range(rng.randrange(0, 3 + 3 * c)):
                other[rng.randrange(len(other))] = "zz"
            rows.append((10 * k + c + 1, ("\n" if c else "  ").join(other)))
    hot = prose(rng, 120)
    for k in range(60):  # many copies, each with a change of its own
        other = list(hot)
        other[rng.randrange(120)] = f"new{k}"
        if k % 3 == 0:
            other[rng.randrange(120)] = f"more{k}"
        rows.append((1000 + k, " ".join(other)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "One  two"), (2005, "one two three"), (2006, ("long " * 3000) + "end"), (2007, ("long " * 2990) + "end")]
    return rows


def brute_near(rows):
    sets = [(i, shingle_counts(t)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and jaccard(x, y) >= 0.8]
    return classes([i for i, _ in rows], links)


def test_near_duplicates(spark):
    rows = fixture_docs()
    df = spark.createDataFrame([(i, t, "key", "uid", 1.5) for i, t in rows], "doc_id long, text string, key string, uid string, root double")
    got = near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = drop_near_duplicates(df)
    assert left.columns and {r["doc_id"] for r in left.collect()} == set(brute_near(rows).values())


def test_near_duplicates_edge_cases(spark):
    text = " ".join(prose(random.Random(5), 80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (3, "", "en", "b", 0), (4, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    want = sorted([(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (False, 4, 4, True), (True, 0, None, True), (True, 0, None, True)], key=str)
    assert got == want
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in drop_near_duplicates(df).collect()) == [(False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_cross_links_match_all_pairs():
    rows = [t for _, t in fixture_docs() if t and t.strip()]
    parts = np.arange(len(rows))
    found = cross_links(rows, parts, 0.8, 5, True)
    sets = [shingle_counts(t) for t in rows]
    want = classes(range(len(rows)), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(sets[a], sets[b]) >= 0.8])
    assert classes(range(len(rows)), found) == want


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_paragraphs(text, reach=REACH):
    """(first word, number of words) of each paragraph, by the rule of paragraphs(), one word at a time."""
    h = words(*bytes_of(pa.array([text or ""])))[0]
    n = len(h)
    pair = [None] + [int(mix(h[k - 1 : k] * odd(9) + mix(h[k : k + 1]))[0]) for k in range(1, n)]
    starts = [0] if n else []
    for k in range(reach + 1, n - reach):
        if all(pair[k] < pair[j] for j in range(k - reach, k)) and all(pair[k] <= pair[j] for j in range(k + 1, k + reach + 1)):
            starts.append(k)
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def brute_repeats(rows, size=5):
    """{(doc_id, first word): (words, first doc_id, first word there)} of all paragraphs that repeat an earlier one."""
    units = {}
    for d, t in rows:
        w = plain_words(t)
        for s, n in plain_paragraphs(t):
            if n >= size:
                units[d, s] = (n, {tuple(w[k : k + size]) for k in range(s, s + n - size + 1)})
    links = [(a, b) for (a, (_, x)), (b, (_, y)) in itertools.combinations(sorted(units.items()), 2) if len(x & y) >= 0.8 * len(x | y)]
    return {u: (units[u][0], *r) for u, r in classes(sorted(units), links).items() if u != r}


def brute_run_places(rows, size=RUN):
    """{doc_id: places of the words that a run of size words covers which stands earlier too}."""
    seen, gone = {}, defaultdict(set)
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = plain_words(t)
        for k in range(len(w) - size + 1):
            e, at = seen.setdefault(tuple(w[k : k + size]), (d, k))
            if e != d or k - at >= size:
                gone[d] |= set(range(k, k + size))
    return gone


def brute_left(rows):
    """The texts that drop_repeats leaves, for rows without a repeated doc_id."""
    gone = brute_run_places([r for r in rows if r[1]])
    for (d, s), (n, *_) in brute_repeats(rows).items():
        gone[d] |= set(range(s, s + n))
    left = {}
    for d, t in rows:
        places = sorted(gone[d])
        spans = [{"start": k, "n": 1} for k in places]
        left[d] = without_words(t, spans)[0] if spans else t
    return left, {d for d, x in gone.items() if x}


def repeat_docs():
    rng = random.Random(8)
    common = [prose(rng, n) for n in (30, 52, 80, 120, 300)]
    rows = []
    for k in range(60):
        w = prose(rng, rng.randrange(60, 280))
        if k % 2:
            p = list(common[k % 5])
            if k % 3 == 0:
                for _ in range(1 + len(p) // 100):
                    p[rng.randrange(len(p))] = "changed"
            at = rng.choice([0, 25, 50, len(w)])
            w[at:at] = p if k % 4 else [x.upper() for x in p]  # in the middle of a line, or over several
        step = [10**6, 8, 12, 20][k % 4]
        rows.append((k, "\n".join(" ".join(w[j : j + step]) for j in range(0, len(w), step))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "two words"), (104, "two words"), (105, "now there are five words"), (106, "now there are five words"), (107, "x " * 5000), (108, "x " * 300), (109, "x" * 100_000)]
    return rows


def test_paragraphs_do_not_depend_on_lines():
    rng = random.Random(6)
    text = " ".join(prose(rng, 700))
    got = paragraphs(*[words(*bytes_of(pa.array([text, "a b", "", text.replace(" ", "\n")])))[k] for k in (0, 3)])
    want = plain_paragraphs(text)
    assert list(zip(*(x.tolist() for x in got))) == want + [(700, 2)] + [(702 + s, n) for s, n in want] and len(want) > 8
    assert all(n > REACH for _, n in want)


def test_similar_paragraphs(spark):
    rows = repeat_docs()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, number string, start int")
    got = {(r["doc_id"], r["start"]): (r["n"], r["first_doc_id"], r["first_start"]) for r in similar_paragraphs(df).collect()}
    assert got == brute_repeats(rows) and len(got) > 20
    want, touched = brute_left(rows)
    out = drop_repeats(df).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert {r["doc_id"] for r in out if r["removed"]} == touched


def test_similar_paragraphs_edge_cases(spark):
    line = " ".join(prose(random.Random(2), 60))
    rows = [(1, line, None, None, None), (1, line, None, None, None), (2, "a\n" + line, "en", "s", 3), (None, line, None, None, None)]
    out = drop_repeats(spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "removed")).collect()
    got = sorted(((r["doc_id"] or 0, r["text"], r["removed"]) for r in out), key=lambda x: x[0])
    assert got[:3] == [(0, line, ""), (1, line, ""), (1, line, "")] and got[3] == (2, "", "0:61")  # a paragraph that differs by a word goes as a whole
    assert drop_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_runs_wherever_they_stand(spark):
    rng = random.Random(21)
    passages = [prose(rng, n) for n in (50, 51, 64, 90, 130)]
    rows = []
    for k in range(40):
        w = prose(rng, rng.randrange(200, 260))
        if k % 4:
            p = passages[k % 5]
            p = p if k % 3 else [x.upper() for x in p]
            at = rng.choice([0, 70, len(w)])
            w[at:at] = p[: 49 if k % 11 == 0 else None]
        step = [10**6, 8, 12, 20][k % 4]  # one line, or lines under 25 words
        rows.append((k, "\n".join(" ".join(w[j : j + step]) for j in range(0, len(w), step))))
    twice = prose(rng, 60)
    rows += [(50, " ".join(prose(rng, 80) + twice + prose(rng, 40) + twice + prose(rng, 80))), (51, "x " * 170), (52, " ".join(["y"] * 99))]
    out = {r["doc_id"]: r["text"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, touched = brute_left(rows)
    assert out == want and len(touched) > 20


def test_white_space_where_a_run_was():
    p = " ".join(f"p{k}" for k in range(50))
    cut = lambda t, k: without_words(t, [{"start": k, "n": 30}, {"start": k + 20, "n": 30}])[0]
    assert cut(f"a {p} b", 1) == "a b" and cut(f"a {p}\nb", 1) == "a\nb" and cut(f"a\n{p} b", 1) == "a\nb"
    assert cut(f"a\n{p}", 1) == "a" and cut(f"{p}\nb", 0) == "b" and cut(p, 0) == ""


@pytest.mark.parametrize("how", [{}, {"cell_rows": 20, "block_rows": 16}])
def test_vectors(spark, how):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 8))
    rows = [(k, (base[k % 80] + rng.normal(scale=0.06, size=8)).tolist(), int(k % 3)) for k in range(240)]
    rows += [(900 + k, (base[0] + rng.normal(scale=0.03, size=8)).tolist(), 1) for k in range(60)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, None, 0), (1003, [0.0] * 8, 0), (1004, [float("nan")] * 8, 0), (1005, [1.0, None] + [0.0] * 6, 0), (1006, rows[0][1], None), (1007, [], 0), (1008, [3.0, 4.0], 0), (1009, [6.0, 8.0], 0), (1010, [float("inf")] + [1.0] * 7, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, uid string")
    ok = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for (a, v, y), (b, w, z) in itertools.combinations(ok, 2) if y == z and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98]
    count = Counter(x for p in links for x in p)
    root = classes([r[0] for r in rows], links)
    got = range_join(df, **how).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (count[i], root[i], root[i] == i) for i, _, _ in rows}
    assert len(links) > 100 and len(got) == len(rows)


def test_vectors_edge_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in range_join(df).collect() if r["vec_id"]) == [(5, 1, 5, True)] * 2
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in range_join(df).collect() if r["vec_id"] is None] == [(0, None, True)]
    assert range_join(df.limit(0)).count() == 0
