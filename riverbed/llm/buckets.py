"""Links within the buckets of a locality-sensitive hash, without listing all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.llm.common import Scratch, bytes_of, mix, odd, shingles, slices, words
from riverbed.llm.components import components


def tune_bands(threshold: float, recall: float = 0.999, noise: float = 0.2, most_noise: float = 0.1) -> tuple[int, int]:
    """(bands, rows per band) with the fewest hashes in all such that a pair at the threshold collides with probability recall
    at least, and a pair of similarity noise with probability most_noise at most."""
    found = []
    for r in range(1, 17):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)) if threshold < 1 else 1
        if 1 - (1 - noise**r) ** b <= most_noise:
            found.append((b * r, b, r))
    return min(found)[1:]


def similar_texts(batch: pa.RecordBatch, threshold: float, size: int, multiset: bool) -> np.ndarray:
    """Which rows' two texts (text_a, text_b) have Jaccard similarity threshold at least, of shingles or of their multisets."""
    n = batch.num_rows
    keys, rows, sides = [], [], []
    for side in ("text_a", "text_b"):
        h, _, _, r = words(*bytes_of(batch.column(side)))
        s, r = shingles(h, r, size)
        keys.append(s)
        rows.append(r)
        sides.append(np.full(len(s), side == "text_b"))
    key, row, side = map(np.concatenate, (keys, rows, sides))
    if not len(key):
        return np.zeros(n, bool)
    order = np.lexsort((key, row))
    key, row, side = key[order], row[order], side[order]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    b = np.add.reduceat(side.astype(np.int64), at)
    a = np.diff(np.r_[at, len(key)]) - b
    if not multiset:
        a, b = np.minimum(a, 1), np.minimum(b, 1)
    both = np.bincount(row[at], np.minimum(a, b), n)
    either = np.bincount(row[at], np.maximum(a, b), n)
    return (both >= threshold * either - 1e-9) & (either > 0)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, size: int, multiset: bool) -> DataFrame:
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", "text_b"):
                keep = pa.array(similar_texts(part, threshold, size, multiset))
                yield part.select(["a", "b"]).filter(keep)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def cross_links(texts: list[str], parts: np.ndarray, threshold: float, size: int, multiset: bool) -> list[tuple[int, int]]:
    """Pairs of rows that join different parts by similar texts: a forest over the parts, found by comparing all rows of different parts.

    Counts of shared shingles come from products of the rows' incidence matrices, over columns that two rows share, in chunks.
    """
    n = len(texts)
    h, _, _, r = words(*bytes_of(pa.array(texts, pa.large_string())))
    s, r = shingles(h, r, size)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])] if len(s) else np.zeros(0, bool)
    if multiset:  # the k-th copy of a shingle is an element of its own
        at = np.flatnonzero(new)
        s = mix(s + (np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)]))).astype(np.uint64) * odd(3))
    else:
        s, r = s[new], r[new]
    total = np.bincount(r, minlength=n).astype(np.float32)
    _, column, counts = np.unique(s, return_inverse=True, return_counts=True)
    shared = counts > 1
    on = shared[column]
    column, r = (np.cumsum(shared) - 1)[column[on]], r[on]
    order = np.argsort(column, kind="stable")
    column, r = column[order], r[order]
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [first, first + 2048])
        some = np.zeros((n, 2048), np.float32)
        some[r[lo:hi], column[lo:hi] - first] = 1
        both += some @ some.T
    good = (both > 0) & (both >= threshold * (total[:, None] + total[None, :] - both) - 1e-6) & (parts[:, None] != parts[None, :])
    root = {p: p for p in parts.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(good))):
        p, q = find(int(parts[x])), find(int(parts[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(x), int(y)))
    return out


def _cross(rest: DataFrame, texts: DataFrame, threshold: float, size: int, multiset: bool, most_bytes: int = 4 << 20, most_rows: int = 512) -> DataFrame:
    """Links (a, b) between different parts of the same bucket, given (key, uid, part).

    A bucket is cut into blocks of bounded bytes and rows, and every two blocks meet in a group of their own. A group tells which parts it
    joins, not which pairs are similar.
    """
    rows = rest.join(texts, "uid")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / most_bytes), F.ceil(F.count("*") / most_rows)).cast("int").alias("blocks"))
    block = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    met = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "uid", "part", "text")

    def compare(group: pa.Table) -> pa.Table:
        uid = group["uid"].to_numpy()
        found = cross_links(group["text"].to_pylist(), group["part"].to_numpy(), threshold, size, multiset)
        a, b = (np.array([uid[p[k]] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def link(scratch: Scratch, units: DataFrame, texts_of, threshold: float, size: int = 5, multiset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the units that a chain of verified links joins, and (key, uid, hub) of the units that share a band.

    units: uid long (equal only for units of one class) and bands array<long>; texts_of: gives (uid, text) for a DataFrame of uids. Every bucket first
    checks its members against its smallest one: a number of pairs that is linear in the bucket. Those that pass form
    components. Only buckets that still hold several components go on; there rows of different components are
    compared, block by block. Links within a component can add nothing, so no colliding pair that matters is left out.

    A bucket's members are found by one shuffle of (key, uid): a running first value, and whether another row follows, need no
    buffer that holds a bucket. RuntimeError if components() gives up.
    """
    rows = units.select("uid", F.explode("bands").alias("key"))
    by_key = Window.partitionBy("key").orderBy("uid")
    running = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.select("key", "uid", F.first("uid").over(running).alias("hub"), F.lead("uid").over(by_key).alias("next"))
    shared = scratch.save(told.filter("uid <> hub or uid <> next").select("key", "uid", "hub"))
    scratch.sweep()
    texts = scratch.save(texts_of(shared.select("uid").distinct()))
    pairs = shared.filter("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()
    edges = scratch.save(_verify(pairs, texts, threshold, size, multiset))
    scratch.sweep()
    found = components(scratch, edges)
    placed = shared.join(found, F.col("uid") == F.col("node"), "left").select("key", "uid", F.coalesce("root", "uid").alias("part"))
    torn = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).filter("p < q and n > 2").select("key")
    more = scratch.save(_cross(placed.join(torn, "key"), texts, threshold, size, multiset))
    scratch.drop(texts)
    return (found if more.isEmpty() else components(scratch, edges.unionByName(more))), shared
