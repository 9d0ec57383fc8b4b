"""Embedding near-duplicates: an exact range join in a metric space, partitioned by pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import Scratch, sampled
from riverbed.llm.components import components


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """k points of a sample, each the farthest from those before it."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def cells(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot (home) of each vector, and which cells get a copy of it (n x pivots, home included).

    If y lies within the radius of x and has home q, then d(x, q) <= r + d(y, q) <= r + d(y, home of x) <= d(x, home of x) + 2r, and x lies
    within r of the half-space of q. A cell that fails either test has no such y, so all partners of a vector y are in the home of y.
    """
    square = np.maximum(0.0, (units**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * units @ pivots.T)
    home = square.argmin(axis=1)
    near = square[np.arange(len(units)), home]
    apart = np.sqrt(np.maximum(0.0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))[home]
    copies = (np.sqrt(square) <= np.sqrt(near)[:, None] + 2 * radius + 1e-9) & (square - near[:, None] <= 2 * apart * radius + 1e-9)
    copies[np.arange(len(units)), home] = True
    return home, copies


def choose_pivots(sample: np.ndarray, labels: np.ndarray, n: int, cell_rows: int, most: int, radius: float) -> np.ndarray:
    """The pivots, of two kinds and several numbers, with which a sample needs least: pairs to compare and copies to make, carried on to n points.

    Candidates are the points farthest from each other, and points in dense places (those with most neighbours within twice the
    radius, each out of reach of those before). One pivot, that is one cell, wins where the space has no parts that the radius can tell apart.
    """
    if not len(sample):
        return np.zeros((0, 1))
    some = sample[: 1024]
    close = ((some @ some.T) >= 1 - 2 * radius**2).sum(axis=1)
    dense: list[int] = []
    for k in np.argsort(-close, kind="stable").tolist():
        if len(dense) < most and all(some[k] @ some[j] < 1 - 2 * radius**2 for j in dense):
            dense.append(k)
    scale, best = n / len(sample), (np.inf, sample[:1])
    for candidates in (some[dense], farthest_first(sample, min(most, len(sample)))):
        k = 1
        while k <= min(len(candidates), max(1, n // cell_rows)):
            home, copies = cells(sample, candidates[:k], radius)
            pairs = 0.0
            for label in np.unique(labels):
                on = labels == label
                pairs += (np.bincount(home[on], minlength=k) * copies[on].sum(axis=0)).sum() * scale * scale
            cost = pairs + copies.sum() * scale * cell_rows / 16  # a copy costs as much as some comparisons
            if cost < best[0]:
                best = cost, candidates[:k]
            k *= 2
    return best[1]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def range_join(vectors: DataFrame, least_cosine: float = 0.98, cell_rows: int = 4096, most_pivots: int = 256, sample_rows: int = 4096, block_rows: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Two vectors are linked if their labels and lengths are equal, labels not null, and their cosine in double precision is
    least_cosine or more, that is if the unit vectors are within sqrt(2 - 2 * least_cosine). Equal vectors of a label are one
    point with a weight. Up to n / cell_rows pivots, chosen on a sample of sample_rows points, cut the space into cells; each
    cell gets its own points and those that a neighbour across its border may need, and is joined on its own: every link of a
    point is counted in its home. A cell with many points is joined block by block, every two blocks once, so no task grows with it. Blocks tell
    how many links a point has and which points they connect, not the links. Where no pivots help (points in all directions and a
    large radius), a label is one cell, and the comparisons grow with the square of its points.

    Vectors that are null, empty or zero, or hold a null or non-finite component, have no links; nor has a row with a null vec_id, whose
    component_id is null and which is kept. Repeated rows are vectors of their own with the same vec_id. component_id is the
    smallest vec_id in reach. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    radius = float(np.sqrt(2 - 2 * least_cosine))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for row in batch.column("embedding"):
                v = None
                if row.is_valid and len(row) and row.values.null_count == 0:
                    v = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        big = np.abs(v).max()
                        v = v / big if 0 < big < np.inf else None
                keys.append(None if v is None else hashlib.md5(v.tobytes()).digest())
                units.append(None if v is None else v / np.linalg.norm(v))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "label", "key", "unit"])

    label = F.col("label").cast("string").alias("label")
    rows = scratch.save(vectors.select("vec_id", label, "embedding").mapInArrow(normal, "vec_id long, label string, key binary, unit array<double>"))
    valid = rows.filter("vec_id is not null and label is not null and key is not null")
    grouped = valid.groupBy("label", "key").agg(F.min(F.struct("vec_id", "unit")).alias("s"), F.count("*").alias("weight"))
    points = scratch.save(grouped.select("label", "key", F.col("s.vec_id").alias("vec_id"), F.col("s.unit").alias("unit"), "weight").withColumn("uid", F.monotonically_increasing_id()))
    n = points.count()
    sample = [(np.array(r["unit"]), r["label"]) for r in sampled(points.select("uid", "unit", "label"), sample_rows, "uid").collect()]
    sizes = [len(v) for v, _ in sample]
    length = max(set(sizes), key=sizes.count, default=0)
    some = [(v, y) for v, y in sample if len(v) == length]
    pivots = choose_pivots(np.array([v for v, _ in some]), np.array([y for _, y in some]), n, cell_rows, most_pivots, radius)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(u) for u in batch.column("unit")])
            take, cell, home = [], [], []
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                if size == length:
                    own, copies = cells(_matrix(batch.column("unit").take(pa.array(some))), pivots, radius)
                    i, c = np.nonzero(copies)
                    take.append(some[i]), cell.append(c), home.append(own[i] == c)
                else:  # vectors of another length are few or none: one cell for each length
                    take.append(some), cell.append(np.full(len(some), -size)), home.append(np.full(len(some), True))
            if take:
                got = batch.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))], [*got.schema.names, "cell", "home"])

    placed = points.select("label", "uid", "weight", "unit").mapInArrow(assign, "label string, uid long, weight long, unit array<double>, cell int, home boolean")
    placed = scratch.save(placed)
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    block = placed.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    met = block.withColumn("ij", F.explode(pair)).select("label", "cell", "ij.i", "ij.j", "uid", "weight", "unit", "home", "block")

    def join(key: tuple, group: pa.Table) -> pa.Table:
        uid, weight, unit, of = group["uid"].to_numpy(), group["weight"].to_numpy(), _matrix(group["unit"]), group["block"].to_numpy()
        home = group["home"].to_numpy(zero_copy_only=False)
        i, j = (k.as_py() for k in key[2:])
        links, root, far = np.zeros(len(uid), np.int64), uid.copy(), np.iinfo(np.int64).max
        for asks, answers in {(i, j), (j, i)}:
            x, y = np.flatnonzero(home & (of == asks)), np.flatnonzero(of == answers)
            near = (unit[x] @ unit[y].T >= least_cosine) & (uid[x][:, None] != uid[y][None, :])
            links[x] += near @ weight[y]
            while near.any():
                before = root.copy()
                np.minimum.at(root, x, np.where(near, root[y][None, :], far).min(axis=1))
                np.minimum.at(root, y, np.where(near, root[x][:, None], far).min(axis=0))
                if (before == root).all():
                    break
        on = (links > 0) | (root != uid)
        return pa.table({"uid": uid[on], "root": root[on], "links": links[on]})

    found = scratch.save(met.groupBy("label", "cell", "i", "j").applyInArrow(join, "uid long, root long, links long"))
    joined = components(scratch, found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    known = points.select("label", "key", "vec_id", "weight", "uid").join(counted, "uid", "left").join(joined, F.col("uid") == F.col("node"), "left").withColumn("part", F.coalesce("root", "uid"))
    roots = known.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    known = known.join(roots, "part").select(F.col("label").alias("l"), F.col("key").alias("k"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    out = rows.join(known, (rows["label"] == known["l"]) & (rows["key"] == known["k"]) & rows["vec_id"].isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
