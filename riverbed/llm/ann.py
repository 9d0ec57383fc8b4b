"""Approximate nearest neighbours by inner product: learned binary codes, an index for each of their parts, exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm.common import Scratch, sampled

#: Bits of a part of a code, which is one unsigned number.
PART = 16
#: Relative slack of sums in another order, within which exact scores decide.
SLACK = 1e-9


def itq(points: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Directions (bits columns) whose signs are the code: leading principal directions, turned so that the points lie near the corners of a cube (iterative quantisation).

    Where there are more bits than dimensions, several turns, each from a random start, stand side by side.
    """
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(points.T @ points)
    width = min(bits, points.shape[1])
    out = []
    for _ in range(-(-bits // width)):
        base = vectors[:, ::-1][:, :width]
        low = points @ base
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        out.append(base @ turn)
    return np.hstack(out)[:, :bits]


@dataclass
class Model:
    """dims: length of the vectors that it codes. peak: longest norm. mean, directions: a code is the signs of (vector - mean) @ directions. radius: bits by which codes of neighbours may differ."""

    dims: int
    peak: float
    mean: np.ndarray
    directions: np.ndarray
    radius: int = 0

    @property
    def parts(self) -> int:
        return self.directions.shape[1] // PART

    def codes(self, vectors: np.ndarray, asks: bool) -> np.ndarray:
        """A row of unsigned parts for each vector.

        Rows get one more coordinate, with which all have the longest norm, and queries a zero: then the angle to a query falls as the inner product grows. Vectors
        of another length than the model's share the code zero, so all of them are found.
        """
        if vectors.shape[1] != self.dims:
            return np.zeros((len(vectors), self.parts), np.uint16)
        norm = np.linalg.norm(vectors, axis=1)
        rest = np.zeros(len(vectors)) if asks else np.sqrt(np.maximum(0.0, self.peak**2 - norm**2))
        lifted = np.column_stack([vectors, rest]) / (np.where(norm > 0, norm, 1.0) if asks else np.full(len(vectors), self.peak))[:, None]
        signs = (lifted - self.mean) @ self.directions >= 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint16)

    def reach(self, radius: int) -> np.ndarray:
        """Bits by which each part may differ. If all parts differed by more, whole codes would by more than the radius (pigeonhole)."""
        each, more = divmod(radius, self.parts)
        return np.array([each if j <= more else each - 1 for j in range(self.parts)])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits by which parts differ, each of a against each of b."""
    return np.bitwise_count(a[:, None] ^ b[None, :])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, each summed from the first component on, so that equal vectors score the same wherever they stand."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x * y
    return out


def nearest(query: np.ndarray, units: np.ndarray, ids: np.ndarray, uids: np.ndarray, own: np.ndarray, found: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best of the rows that found marks, its own left out and those that score below least: positions of queries and rows, scores. Ties go to the smaller id."""
    found = found & (uids[None, :] != own[:, None])
    rough = np.where(found, query @ units.T, -np.inf)
    slack = SLACK * np.linalg.norm(query, axis=1) * (np.linalg.norm(units, axis=1).max() if len(units) else 0.0)
    if least is not None:
        found &= rough >= (least - slack)[:, None]
    if rough.shape[1] > k:
        found &= rough >= (np.partition(rough, -k, axis=1)[:, -k] - slack)[:, None]
    q, r = np.nonzero(found)
    s = scores(query[q], units[r])
    if least is not None:
        keep = s >= least[q]
        q, r, s = q[keep], r[keep], s[keep]
    order = np.lexsort((uids[r], ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], r[rank < k], s[rank < k]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, dims, embedding of the rows that take part: vec_id not null, the vector neither null nor zero, all its components finite."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull())
    rows = rows.filter(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.size("embedding").alias("dims"), "embedding")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, of the k best of each task; rank from 1. Tasks keep k rows a query before the shuffle."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_FOUND = "asker long, query_id long, uid long, vec_id long, score double"


def _table(asker: np.ndarray, query: np.ndarray, uid: np.ndarray, vec: np.ndarray, score: np.ndarray) -> dict:
    return {"asker": asker, "query_id": query, "uid": uid, "vec_id": vec, "score": score}


def fit(rows: DataFrame, k: int = 20, bits: int = 64, sample_rows: int = 20_000, sample_queries: int = 200, recall: float = 0.96) -> Model | None:
    """Learns the directions on a sample of about sample_rows rows at most, and the radius on the exact neighbours of about sample_queries rows at most, searched for among all rows.

    The radius is the least that keeps the share recall of those neighbours. rows as valid() gives them.
    """
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))).alias("peak"))
    usual = sizes.orderBy(F.desc("n"), "dims").first()
    if usual is None:
        return None
    rows = rows.filter(F.col("dims") == usual["dims"])
    dims, peak = usual["dims"], usual["peak"]
    some = np.array([r["embedding"] for r in sampled(rows.select("uid", "embedding"), sample_rows, "uid").collect()]).reshape(-1, dims)
    lifted = np.column_stack([some, np.sqrt(np.maximum(0.0, peak**2 - (some**2).sum(axis=1)))]) / peak
    mean = lifted.mean(axis=0) if len(lifted) else np.zeros(dims + 1)
    model = Model(dims, peak, mean, itq(lifted - mean if len(lifted) else np.eye(dims + 1), bits))
    asked = sampled(rows.select("uid", "embedding", F.xxhash64("uid").alias("h")), sample_queries, "h").collect()
    query, own = np.array([r["embedding"] for r in asked]).reshape(-1, dims), np.array([r["uid"] for r in asked], np.int64)
    codes = model.codes(query, True)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ids, uids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), batch.column("uid").to_numpy()
            q, r, s = nearest(query, units, ids, uids, own, np.ones((len(own), len(ids)), bool), k)
            gap = np.bitwise_count(codes[q] ^ model.codes(units, False)[r]).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_pydict(_table(own[q], gap, uids[r], ids[r], s))

    if len(own):
        near = rows.select("uid", "vec_id", "embedding").mapInArrow(exact, _FOUND)
        counts = _best(near, k).groupBy(F.col("query_id").alias("gap")).count().orderBy("gap").collect()
        total, seen = sum(r["count"] for r in counts), 0
        for r in counts:
            if seen < recall * total:
                model.radius, seen = int(r["gap"]), seen + r["count"]
    return model


def coded(rows: DataFrame, model: Model, asks: bool) -> DataFrame:
    """rows with their code, an array of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, code = batch.column("dims").to_numpy(), np.zeros((batch.num_rows, model.parts), np.int32)
            at = np.flatnonzero(sizes == model.dims)
            code[at] = model.codes(_matrix(batch.column("embedding").take(pa.array(at))).reshape(-1, model.dims), asks)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * model.parts), pa.array(code.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "code"])

    return rows.mapInArrow(run, "uid long, vec_id long, dims int, embedding array<double>, code array<int>")


def cell_bits(n: int, block_rows: int) -> int:
    """Leading bits of a part that make a cell, as many as give cells of about block_rows of n rows."""
    return min(PART, max(0, int(np.ceil(np.log2(max(1, n / block_rows))))))


def rounds(lead: int, most: int, growth: int = 8) -> list[tuple[int, int]]:
    """The numbers of bits by which cells may differ from a query's own, from few to many, in rounds (first, last): a round has at most growth times the cells of all before it, unless it is of one number."""
    out, seen, now = [], 1, 0
    first = 1
    for bits in range(1, min(lead, most) + 1):
        here = comb(lead, bits)
        if bits > first and now + here > growth * seen:
            out.append((first, bits - 1))
            seen, now, first = seen + now, 0, bits
        now += here
    return [(0, 0), *out, *([(first, min(lead, most))] if min(lead, most) >= 1 else [])]


def probe(rows: DataFrame, queries: DataFrame, model: Model, radius: int, k: int, lead: int, near_bits: tuple[int, int], block_rows: int, query_rows: int) -> DataFrame:
    """asker, query_id, uid, vec_id, score: at most k rows a task for each query, within the radius of its code and scoring its least or more. Both tables as coded() gives them, queries with least.

    Each part of a code has an index: rows under (part, cell), a cell being the leading bits of the part. A query goes to the cells that differ from its own by near_bits and may hold
    parts within reach. There it meets the rows' parts, then, where one is in reach, the whole codes, then the vectors. A pair that several parts bring
    together counts where the first of them does. A large cell is cut by rows and by queries, so that no task grows with either.
    """
    reach = model.reach(radius)
    cell = lambda part: F.shiftright(part, PART - lead)
    part = F.posexplode("code").alias("part", "value")
    index = rows.select("*", part).withColumn("cell", cell(F.col("value")))
    low, high = near_bits
    most = F.least(F.lit(high), F.element_at(F.array(*map(F.lit, reach.tolist())), F.col("part") + 1))
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << lead) - 1)), lambda m: F.bit_count(m).between(F.lit(low), most))
    probes = queries.select("*", part).withColumn("near", F.explode(near)).withColumn("cell", cell(F.col("value")).bitwiseXOR(F.col("near"))).drop("near")
    # how many rows and queries meet in a cell decides into how many pieces both are cut
    cut = lambda n, size: F.ceil(n / size).cast("int")
    sizes = index.groupBy("dims", "part", "cell").agg(cut(F.count("*"), block_rows).alias("rows")).join(probes.groupBy("dims", "part", "cell").agg(cut(F.count("*"), query_rows).alias("asks")), ["dims", "part", "cell"])
    mine = lambda size, salt: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    keep = ["dims", "part", "cell", "i", "j", "asks_for", "uid", "vec_id", "embedding", "code", "least"]
    left = index.join(sizes, ["dims", "part", "cell"]).withColumn("i", mine("rows", 1)).withColumn("j", every("asks")).withColumns({"asks_for": F.lit(False), "least": F.lit(0.0)}).select(keep)
    right = probes.join(sizes, ["dims", "part", "cell"]).withColumn("j", mine("asks", 2)).withColumn("i", every("rows")).withColumn("asks_for", F.lit(True)).select(keep)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        j = key[1].as_py()
        asks = group["asks_for"].to_numpy(zero_copy_only=False)
        code, units = _matrix(group["code"]).astype(np.uint16), _matrix(group["embedding"])
        ids, uids, least = group["vec_id"].to_numpy(), group["uid"].to_numpy(), group["least"].to_numpy()
        at = np.flatnonzero(~asks)
        at = at[np.argsort(code[at, j], kind="stable")]
        values, first = np.unique(code[at, j], return_index=True)  # the index: rows by value of this part
        count = np.diff(np.r_[first, len(at)])
        out = []
        for some in np.array_split(np.flatnonzero(asks), -(-max(1, asks.sum()) // 256)):
            found = np.repeat(apart(code[some, j], values) <= reach[j], count, axis=1)
            gap = np.zeros(found.shape, np.uint16)
            for i in range(model.parts):
                own = apart(code[some, i], code[at, i])
                gap += own
                if i < j:
                    found &= own > reach[i]
            q, r, s = nearest(units[some], units[at], ids[at], uids[at], uids[some], found & (gap <= radius), k, least[some])
            out.append(pa.table(_table(uids[some][q], ids[some][q], uids[at][r], ids[at][r], s)))
        return pa.concat_tables(out)

    return left.unionByName(right).groupBy("dims", "part", "cell", "i", "j").applyInArrow(meet, _FOUND)


def search(scratch: Scratch, rows: DataFrame, queries: DataFrame, model: Model, radius: int, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """asker, query_id, uid, vec_id, score, rank: the k best rows within the radius of each query's code. Both tables as coded() gives them.

    Cells near a query's own come first. What is found there bounds from below what its k-th neighbour scores, so that tasks of the later rounds put out only rows that reach
    it: a number for each query that depends on how much a round adds to those before, not on how many cells there are.
    """
    lead, best = cell_bits(rows.count(), block_rows), None
    plan = rounds(lead, int(model.reach(radius).max()))
    asked = queries.withColumn("least", F.lit(float("-inf")))
    for near_bits in plan:
        found = probe(rows, asked, model, radius, k, lead, near_bits, block_rows, query_rows)
        before, best = best, scratch.save(_best(found if best is None else best.drop("rank").unionByName(found), k))
        if before is not None:
            scratch.drop(before)
        known = best.filter(F.col("rank") == k).select(F.col("asker").alias("uid"), F.col("score").alias("least"))
        asked = queries.join(known, "uid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return best


def neighbours(
    vectors: DataFrame, asks: Column, k: int = 20, bits: int = 64, block_rows: int = 16_384, query_rows: int = 8192, sample_rows: int = 20_000, recall: float = 0.96, scratch: Scratch | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of vectors (vec_id, embedding) for which asks holds; every other row is a candidate.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. Every row is coded and indexed; the model is learnt on samples (see fit), whose neighbours' share recall lies
    within its radius. Queries that find fewer than k rows (and fewer than there are) within the radius search again without one, so each gets k if there are as many.

    Vectors that are null, zero or hold null or non-finite components take no part, nor rows with a null vec_id. Vectors of different lengths are no neighbours. Rows that repeat a vec_id
    are rows of their own: each asks for itself and may find the others. Only vec_id and embedding are read, and what asks reads of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.save(valid(vectors))
    model = fit(rows, k, bits, sample_rows, recall=recall)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.filter(asks)
    index, asked = scratch.save(coded(rows, model, False)), scratch.save(coded(queries, model, True))
    best = search(scratch, index, asked, model, model.radius, k, block_rows, query_rows)
    there = rows.groupBy("dims").agg((F.count("*") - 1).alias("others"))
    full = best.groupBy("asker").agg(F.count("*").alias("n"))
    short = asked.join(full, F.col("uid") == F.col("asker"), "left").join(there, "dims").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "others")).select(asked.columns)
    short = scratch.save(short)
    if not short.isEmpty():
        again = search(scratch, index, short, model, bits, k, block_rows, query_rows)
        first, best = best, scratch.save(best.join(short.select(F.col("uid").alias("asker")), "asker", "left_anti").unionByName(again))
        scratch.drop(first, again)
    scratch.drop(rows, index, asked, short)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
