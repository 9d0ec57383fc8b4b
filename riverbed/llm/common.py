"""What the corpus operators share: scratch tables, Arrow batches of text, word and shingle hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel takes, unless a single text is longer.
SLICE_BYTES = 1 << 20


class Scratch:
    """Tables written to the folder that driver and executors share, so that no lost executor takes them away."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:  # a single machine, as in tests
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            local = tempfile.mkdtemp(prefix="riverbed-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            root = "file://" + local
        self.root = f"{root.rstrip('/')}/riverbed-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and reads it back; this cuts the lineage."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that save() returned and that nothing reads any more."""
        for df in tables:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def end(self) -> None:
        """Deletes all tables of this Scratch and lets Spark delete the shuffle files that nothing refers to any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.sweep()

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
        self.spark._jvm.System.gc()


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns with clashing names never meet those of an operator."""
    return df.select(*names)


def crc(column: str) -> Column:
    """The CRC-32 of a value's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    texts = texts.fill_null("")
    _, at, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, *names: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about limit bytes in the named columns (text if none is named), whole rows only."""
    offsets = sum(bytes_of(batch.column(c))[1] for c in names or ("text",))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(k: int) -> np.uint64:
    """A well spread 64-bit constant for a small number."""
    return np.uint64(k * _BASE % (1 << 64))


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses, up to n at least."""
    global _powers
    if not _powers or len(_powers[0]) <= n:
        _powers = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, SLICE_BYTES) + 2, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without bytes that between marks, by default ASCII white space) of all rows: a 64-bit hash that ignores the case of A-Z, first byte, end, row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    p, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:], dtype=np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, starts, ends, rows


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words within a row, and their rows in ascending order; a row of fewer words has one shingle of them all."""
    if not len(hashes):
        return hashes, rows
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    row_padded = np.concatenate([rows, np.full(size, -1)])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        same = row_padded[k : n + k] == rows
        total += np.where(same, mix(padded[k : n + k] + odd(k + 1)), np.uint64(0))
    first = np.empty(n, bool)
    first[0], first[1:] = True, rows[1:] != rows[:-1]
    whole = row_padded[size - 1 : n + size - 1] == rows
    take = whole | first
    # a first word whose window is cut stands for a short row; other cut windows are left out
    return mix(total[take]), rows[take]


def word_hash(word: str) -> int:
    """The hash that words() gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]), np.zeros(256, bool))[0][0])


def sampled(df: DataFrame, most: int, column: str = "doc_id") -> DataFrame:
    """At most about most rows of df: those whose hashed column is small; all rows if there are no more than that."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.lit(17), column), F.lit(1 << 30)) < int((1 << 30) * most / n))


def hash_to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
