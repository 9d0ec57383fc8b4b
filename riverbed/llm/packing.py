"""Sequence packing: shortest-pack-first over the histogram of piece lengths, joined back to the pieces by rank."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.llm.chunks import Cache, parts
from riverbed.llm.common import Scratch, slices

#: Fixed value: the split pattern of byte-level BPE in this format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_caches: dict[str, tuple[Cache, Cache, list[str], object]] = {}


def _encoder(path: str) -> tuple[Cache, Cache, list[str], object]:
    """Caches of little-endian ids for parts at the start of a text and for parts after a space, the added tokens, and the tokenizer; one of each for each worker.

    path: a byte-level BPE in the JSON form of the library tokenizers. Parts that no cache holds are encoded with its
    vocabulary as ranks by tiktoken, which gives the same ids in a seventh of the time; it knows no added tokens, so texts that hold one
    take the library's own tokenizer. The tests compare the ids of both ways with the library's.
    """
    if path not in _caches:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the format writes a byte as a printable character: itself if it is one, else the next from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            width[i] = len(t)

        def heads(texts: list[str]) -> list[bytes]:
            return [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]

        def tails(texts: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(texts), 5000):
                some = [" " + t for t in texts[at : at + 5000]]
                ids = np.array(own.encode_ordinary("".join(some)), "<u4")
                ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(t.encode()) for t in some])) + 1
                raw, start = ids.tobytes(), 0
                for end in (4 * ends).tolist():
                    out.append(raw[start:end])
                    start = end
            return out

        _caches[path] = Cache(heads, 20_000), Cache(tails, 120_000), sorted(t["content"] for t in spec["added_tokens"]), Tokenizer.from_file(path)
    return _caches[path]


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text, four bytes each."""
    heads, tails, added, tokenizer = _encoder(path)
    whole = {k for k, t in enumerate(texts) if any(a in t for a in added)}
    cut = [parts("" if k in whole else t) for k, t in enumerate(texts)]
    first = heads.fill({p[0] for p in cut})
    need: set[str] = set()
    for p in cut:
        need.update(p[1:])
    rest = tails.fill(need)
    for k, p in enumerate(cut):
        if k in whole:
            yield np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        else:
            yield first[p[0]] + b"".join(map(rest.__getitem__, p[1:]))


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each text's ids and an end id, cut at every size ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                keep, cols = [], ([], [], [], [])
                for row, raw in enumerate(encode_texts(part.column("text").fill_null("").to_pylist(), tokenizer)):
                    raw += int(end).to_bytes(4, "little")
                    n = len(raw) // 4
                    for s in range(0, n, size):
                        some = raw[4 * s : 4 * (s + size)]
                        keep.append(row)
                        for c, v in zip(cols, (s, len(some) // 4, zlib.crc32(some), n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of packing patterns: lengths are placed longest first, each into the emptiest patterns that take it.

    Works on counts alone: a pattern that gets only some of the pieces is split. Every step uses up a length or a pattern, so
    there are fewer than twice as many patterns as lengths, however many pieces there are.
    """
    free: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, p in free.items() if p), default=-1)
            if room < length:
                free[size - length].append((left, [length]))
                break
            count, lengths = free[room].pop()
            take = min(count, left)
            if take < count:
                free[room].append((count - take, lengths))
            free[room - length].append((take, [*lengths, length]))
            left -= take
    return [p for room in sorted(free) for p in free[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go to which run of sequences, and where there."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of every row of docs (doc_id, text).

    Pieces of size ids fill a sequence; the last piece of a text shares one. What the driver gets is the histogram of lengths,
    at most size rows; the table of slots it sends has a bound that depends on size alone. Ranks within a length are row numbers within
    a salt plus the number of pieces in smaller salts, so no task holds all pieces of a common length.

    A null text counts as empty: its piece is the end id alone. Null doc_ids and repeated rows are packed like any other. Only doc_id and
    text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    table = scratch.save(pieces(docs, tokenizer, size, end))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(8, -(-max(histogram.values(), default=0) // 100_000))
    table = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = table.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = table.withColumn("k", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    rows = slots(shortest_pack_first(histogram, size))
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, base long, offset long")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    placed = ranked.join(plan, "length").filter("rank >= lo and rank < hi")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
