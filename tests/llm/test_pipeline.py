"""The pipeline's run() against a plain version, stage by stage, on a small table."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from riverbed.llm import quality, secrets
from tests.llm.test_pairs import DOCS, brute_left, brute_near
from tests.llm.test_rows import plain_quality


def rows():
    rng = random.Random(12)
    vocabulary = [w for ws in quality.COMMON_WORDS.values() for w in ws] + ["".join(rng.choice("aeiounrst") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage = line(70)
    out = []
    for k in range(24):
        lines = [line(rng.randrange(20, 60)) for _ in range(4)]
        if k % 4 == 0:
            lines.insert(2, passage)
        if k % 5 == 0:
            lines.append(f'token = "{zlib.crc32(str(k).encode()):08x}deadbeef{k:04d}" and AKIA{"Q7Z" * 5}{k}')
        out.append((k, "\n".join(lines)))
    out.append((100, out[3][1].replace(".", "!", 1)))
    out.append((101, out[5][1]))
    out.append((102, "### &&& $$$ %%% " * 40 + line(80)))
    out.append((107, " ".join(f"w{k}ord" for k in range(90))))  # no common word
    out += [(103, "too short"), (104, None), (105, ""), (106, "again and again " * 60)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in out]


def histogram(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    upper = sum(c.isupper() for c in t)
    digit = sum(c.isdigit() for c in t)
    mark = len(re.findall(r"[.,;:!?'\"()\[\]{}_\-]", t))
    symbol, blank = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall(r"[\x20\x09-\x0D]", t))
    c = Counter(x.lower() for x in w)
    return np.array([upper, digit, mark, symbol, blank, len(t) - upper - digit - mark - symbol - blank]), np.array([c[k] for k in quality.KNOWN])


def divergence(p, q):
    if not p.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return math.sqrt(max(0, sum(x * math.log2(x / y) for a in (p, q) for x, y in zip(a, m) if x > 0) / 2))


def plain_pipeline(table, ratio):
    texts = {r[0]: r[1] or "" for r in table}
    hist = {i: histogram(t) for i, t in texts.items()}
    passes = {i: n >= 50 and 100 * repeated <= 50 * n for i, t in texts.items() for n, *_, repeated in [plain_quality(t)]}
    norm = [sum(h[k] for i, h in hist.items() if passes[i]) for k in (0, 1)]
    kept = {}
    for i, t in texts.items():
        n = plain_quality(t)[0]
        far = (len(t) >= 200 and divergence(hist[i][0], norm[0]) > quality.LIMITS["max_char_distance"]) or (n >= 50 and divergence(hist[i][1], norm[1]) > quality.LIMITS["max_word_distance"])
        if passes[i] and not far:
            kept[i] = t
    first = brute_near(list(kept.items()))
    kept = {i: t for i, t in kept.items() if first[i] == i}
    kept, gone = brute_left(list(kept.items()))
    for i, t in kept.items():
        hidden = [False] * len(t)
        for _, s, e, _ in secrets.all_spans(t, ratio):
            hidden[s:e] = [True] * (e - s)
        kept[i] = re.sub("\x00+", "[SECRET]", "".join("\x00" if h else c for c, h in zip(t, hidden)))
    return kept, gone


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    table = rows()
    where = f"file://{tmp_path}"
    spark.createDataFrame(table, DOCS).coalesce(1).write.parquet(f"{where}/documents.parquet")
    docs, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "secrets":
            ratio = secrets.fit(docs)
        stage(spark, docs, where).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        seen[name] = docs
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    want, gone = plain_pipeline(table, ratio)
    assert {r["doc_id"]: r["text"] for r in seen["secrets"].collect()} == want
    assert gone and any("[SECRET]" in t for t in want.values()) and not {100, 101, 102, 103, 104, 105, 106, 107} & want.keys()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    plain = []
    for i, t in want.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        plain += [(i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert pieces(seen["packing"]) == sorted(plain) == pieces(corpus_pipeline.run(spark, where))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_clashing_names(spark, k):
    names = ["key", "uid", "part", "hub", "row", "q", "start", "n", "first", "least", "removed_words", "ids", "length", "salt", "rank", "bands", "component_id", "kept"]
    table = [*rows(), (None, "no id " * 60, None, None, None), (None, None, None, None, None), (5, None, "en", "s", None), *[r for r in rows() if r[0] in (5, 6)]]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in table], DOCS + "".join(f", {n} string" for n in names))
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    got = out.collect()
    if k < 4:
        assert out.columns == docs.columns and all(r[n] == "x" for r in got for n in names)
    ids = [r["doc_id"] for r in got]
    if k == 0:
        assert ids.count(5) == 2 and ids.count(6) == 2 and 104 not in ids
    if k == 1:
        assert ids.count(5) == 1 and ids.count(None) == 2 and 101 not in ids and 104 in ids and 105 in ids
    if k in (2, 3):
        assert len(got) == len(table)
    if k == 4:
        assert {(r["doc_id"], r["doc_tokens"]) for r in got} >= {(104, 1), (105, 1), (None, 1)}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, k):
    docs = spark.createDataFrame([], DOCS)
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert (k == 4 or out.columns == docs.columns) and out.count() == 0
