"""Toxicity scores: a factorization machine over hashed terms, with pairwise interactions beside linear weights."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import sampled

_WORD = re.compile(r"[^\W\d_]+")
_slots: dict[str, tuple[int, ...]] = {}


def slots(text: str, buckets: int) -> set[int]:
    """Hashed terms of a text: its words in lower case, and the first four and five letters of longer words."""
    if len(_slots) > 300_000:
        _slots.clear()
    out: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        s = _slots.get(w)
        if s is None:
            s = tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in (w, *("^" + w[:k] for k in (4, 5) if len(w) > k)))
            _slots[w] = s
        out.update(s)
    return {x % buckets for x in out}


@dataclass
class Machine:
    """A fitted factorization machine over the hashed terms chosen."""

    buckets: int
    chosen: np.ndarray  # slot of each feature, ascending
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def index(self) -> dict[int, int]:
        return {int(s): k for k, s in enumerate(self.chosen)}

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Of rows of 0 and 1."""
        s = x @ self.factor
        return self.bias + x @ self.weight + 0.5 * (s * s - x @ (self.factor**2)).sum(axis=1)


def fit(labelled: DataFrame, buckets: int = 1 << 18, features: int = 1024, rank: int = 8, most_docs: int = 20_000, epochs: int = 12, seed: int = 3) -> Machine:
    """Learns from labelled texts (doc_id, text, toxic), a sample of most_docs rows at most.

    Executors hash the terms and count them by label; the features are those whose shares differ most between labels. The
    driver gets the counts' best features and, for each sampled text, the features it has: bounded by most_docs and features.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(slots(t, buckets)) for t in batch.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], ["y", "slots"])

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(hashed, "y int, slots array<long>").persist()
    try:
        total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = total.get(1, 0), total.get(0, 0)
        if not n1 or not n0:
            return Machine(buckets, np.zeros(0, np.int64), 4.0 if n1 else -4.0, np.zeros(0), np.zeros((0, rank)))
        count = rows.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
        p, q = (F.col("a") + 0.5) / (n1 + 1), (F.col("n") - F.col("a") + 0.5) / (n0 + 1)
        mean = F.col("n") / (n1 + n0)
        z = F.abs(p - q) / F.sqrt(mean * (1.001 - mean) * (1 / n1 + 1 / n0))
        best = count.filter("n >= 5").orderBy(z.desc(), "slot").limit(features).select("slot").collect()
        chosen = np.array(sorted(r["slot"] for r in best), np.int64)
        keep = F.array_intersect("slots", F.lit(chosen.tolist()).cast("array<long>"))
        data = rows.select("y", keep.alias("s")).collect()
    finally:
        rows.unpersist()
    index = {int(s): k for k, s in enumerate(chosen)}
    y = np.array([r["y"] for r in data], np.float32)
    sparse = [np.array([index[s] for s in r["s"]], np.int64) for r in data]
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(n1 / n0)]), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.05 / (1 + epoch)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            some = order[lo : lo + 256]
            x = np.zeros((len(some), len(chosen)))
            for i, k in enumerate(some):
                x[i, sparse[k]] = 1
            bias, weight, factor = params
            s = x @ factor
            logit = bias[0] + x @ weight + 0.5 * (s * s - x @ (factor**2)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)
            ex = x.T @ error
            grads = [np.array([error.sum()]), ex + 1e-4 * weight, (x * error[:, None]).T @ s - ex[:, None] * factor + 1e-4 * factor]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):  # Adam
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, chosen, float(params[0][0]), params[1], params[2])


def labelled_sample(docs: DataFrame, labels: DataFrame, most_docs: int = 20_000) -> DataFrame:
    """doc_id, text, toxic of a sample of the labelled documents; a doc_id with several labels has the highest."""
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about most_docs rows of 12 bytes are broadcast, however many labels there are
    return docs.select("doc_id", "text").join(F.broadcast(sampled(known, most_docs)), "doc_id")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text): the likelihood of label 1, and whether it is 0.5 or more.

    A null text counts as empty: the score of a text without terms. Null doc_ids and repeated rows pass like any other; only doc_id and text are
    read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = machine.index()
        known = index.keys()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = np.zeros((part.num_rows, len(index)))
                for i, t in enumerate(part.column("text").fill_null("").to_pylist()):
                    x[i, [index[s] for s in slots(t, machine.buckets) & known]] = 1
                p = 1 / (1 + np.exp(-np.clip(machine.logit(x), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
