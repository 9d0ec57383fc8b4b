"""Near-duplicate documents: BagMinHash signatures of shingle multisets, banding, and an exact check of the multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.buckets import link, tune_bands
from riverbed.llm.common import Scratch, bytes_of, hash_to_long, mix, odd, shingles, slices, words
from riverbed.llm.components import components


def bag_minhash(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, float64) of n weighted sets given as (row, key, integer weight >= 1) without repeats.

    BagMinHash (Ertl, 2018): each key owns a Poisson process over time and weight. The weight axis is discretised to whole steps
    and grouped into the dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; the process of an interval runs at a rate equal to
    its length, and a point's place is refined by halving until its step is known. A point counts if its step lies below the key's weight; it
    then lowers the one signature component drawn for it. Two sets agree in a component with a probability equal to their weighted
    Jaccard similarity. Points come in order of time, and a process stops once it is later than all components of its row.
    """
    sign = np.full((n, m), np.inf)
    top = np.full(n, np.inf)
    flat = sign.reshape(-1)
    level = 0
    live: list[list[np.ndarray]] = []
    while len(keys):
        low = 0 if level == 0 else 1 << (level - 1)
        sel = weights > low
        if not sel.any():
            break
        rows, keys, weights = rows[sel], keys[sel], weights[sel]
        live.append([rows, keys, weights, np.zeros(len(rows)), mix(keys + odd(level + 1)), np.full(len(rows), low), np.full(len(rows), max(1, low))])
        level += 1
    if not live:
        return sign
    rows, keys, weights, time, state, low, length = (np.concatenate(x) for x in zip(*live))
    while len(rows):
        state = mix(state + odd(1))
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / length
        on = time < top[rows]
        rows, weights, time, state, low, length = (x[on] for x in (rows, weights, time, state, low, length))
        draw = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
        component = (draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)
        # halving the interval again and again is the same as reading the place bit by bit
        place = low + ((draw >> np.uint64(32)) & (length - 1).astype(np.uint64)).astype(np.int64)
        hit = place < weights
        np.minimum.at(flat, rows[hit] * m + component[hit].astype(np.int64), time[hit])
        touched = np.unique(rows[hit])
        top[touched] = sign[touched].max(axis=1)
    return sign


def multisets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of a batch's texts."""
    h, _, _, r = words(*bytes_of(batch.column("text")))
    s, r = shingles(h, r, size)
    if not len(s):
        return r, s, np.zeros(0, np.int64)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    return r[at], s[at], np.diff(np.r_[at, len(s)])


def fold_bands(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of consecutive columns, different bands having different keys."""
    n, m = values.shape
    size = m // bands
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        acc = np.full(n, odd(b + 1), np.uint64)
        for k in range(size):
            acc = mix(acc ^ mix(values[:, b * size + k]))
        out[:, b] = acc
    return out


def band_column(keys: np.ndarray, has: np.ndarray) -> pa.ListArray:
    """The rows of keys as lists; rows without content have an empty one."""
    n, b = keys.shape
    offsets = np.r_[0, np.cumsum(np.where(has, b, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hash_to_long(np.ascontiguousarray(keys[has]).reshape(-1))))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id, kept) for every row of docs, which has doc_id and text.

    Two texts are linked if the multisets of their runs of five words (white-space separated, case of A-Z ignored) have weighted
    Jaccard similarity 0.8 or more; a text of under five words counts as one run. component_id is the smallest doc_id in reach by links. One
    row of each component is kept: kept is doc_id = component_id.

    Null or wordless texts are linked with nothing. Rows with a null doc_id are linked with nothing, have component_id null and are kept. Rows that repeat a
    doc_id count as one document, whose texts are in one component; all rows of the kept doc_id say kept. RuntimeError if components() gives up. Only doc_id and text are read, so
    other columns may have any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bands, width = tune_bands(threshold, recall, most_noise=0.03)
    m = bands * width
    docs = docs.select("doc_id", "text").withColumn("key", F.md5("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r, s, w = multisets(part, size)
                has = np.bincount(r, minlength=part.num_rows) > 0
                keys = fold_bands(bag_minhash(r, s, w, part.num_rows, m).view(np.uint64), bands)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), band_column(keys, has)], ["doc_id", "key", "bands"])

    signed = scratch.save(docs.filter("doc_id is not null").mapInArrow(sign, "doc_id long, key string, bands array<long>"))
    first = signed.filter("size(bands) > 0").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("s"))
    # a unit is a text, named by its smallest doc_id; units of one name belong to one document
    units = scratch.save(first.select("key", F.col("s.doc_id").alias("uid"), "s.bands"))

    def texts_of(uids: DataFrame) -> DataFrame:
        wanted = units.select("uid", "key").join(uids, "uid", "left_semi")
        return docs.join(wanted, (docs["doc_id"] == wanted["uid"]) & (docs["key"] == wanted["key"])).select("uid", docs["key"], "text").dropDuplicates(["uid", "key"]).select("uid", "text")

    linked, _ = link(scratch, units, texts_of, threshold, size, multiset=True)
    grouped = units.select("uid", "key").join(linked, F.col("uid") == F.col("node"), "left").select("key", F.coalesce("root", "uid").alias("part"))
    placed = scratch.save(signed.select("doc_id", "key").join(grouped, "key", "left"))  # wordless texts have no unit and no part
    scratch.drop(signed, units)
    told = placed.groupBy("doc_id").agg(F.min("part").alias("part"), F.max("part").alias("other"))
    # a repeated doc_id with several texts joins their components
    several = told.filter("part < other").select("doc_id", F.col("part").alias("b"))
    again = components(scratch, placed.join(several, "doc_id").select(F.col("part").alias("a"), "b"))
    told = told.join(again, F.col("part") == F.col("node"), "left").select(F.col("doc_id").alias("_id"), F.coalesce("root", "part", "doc_id").alias("component_id"))
    out = placed.select("doc_id").join(told, F.col("doc_id") == F.col("_id")).select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def drop_near_duplicates(docs: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """One row of docs, with all its columns, for each component of near_duplicates(), and all rows with a null doc_id.

    Of the rows that repeat a kept doc_id the one with a word and the smallest MD5 of its text stays; if these are equal, the
    first as JSON.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    told = scratch.save(near_duplicates(docs, scratch=scratch, **how))
    left = docs.join(told.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    again = scratch.save(told.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return left
    row = F.struct(*[left[c] for c in docs.columns])
    order = F.struct(F.coalesce(F.trim("text") == "", F.lit(True)), F.md5("text"), F.to_json(row))
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)
