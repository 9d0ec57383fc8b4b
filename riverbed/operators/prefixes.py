"""Prefix hashes: the text so far as its length and two numbers, so that growing texts are compared without being held.

The hash of a text is the sum of code point times base to the power of its place, modulo two primes below 2**31. The hash of texts one after another is then the sum of their hashes, each
shifted by what stands before: a running sum. Different texts of a length have equal pairs with a probability of about their length over 2**62.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.operators.scans import Running, scan

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
_KIND = "struct<chars: bigint, a: bigint, b: bigint>"


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** k modulo prime for k below n, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def _text_hash(texts: pd.Series) -> pd.DataFrame:
    parts = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    out = {"chars": sizes}
    for name, base, prime in zip("ab", BASES, PRIMES):
        table = powers(base, prime, int(sizes.max(initial=0)) or 1)
        # products stay below 2**52, sums of remainders below 2**62 for any text that fits a row
        out[name] = np.array([int((p * table[: len(p)] % prime).sum() % prime) for p in parts], np.int64)
    return pd.DataFrame(out)


def _shifted(a: pd.Series, b: pd.Series, by: pd.Series) -> pd.DataFrame:
    out = {}
    for name, values, base, prime in zip("ab", (a, b), BASES, PRIMES):
        places, result = by.to_numpy(np.int64).copy(), values.to_numpy(np.int64).copy()
        square = base % prime
        while places.any():  # bit by bit, all rows at once
            result = np.where(places & 1 == 1, result * square % prime, result)
            square, places = square * square % prime, places >> 1
        out[name] = result
    return pd.DataFrame(out)


def text_hash(text: Column) -> Column:
    """Length in code points and hash of a text; a null counts as empty."""
    return F.pandas_udf(_text_hash, _KIND)(text)


def shifted(a: Column, b: Column, by: Column) -> Column:
    """The hash of a text that stands so many code points after the beginning."""
    return F.pandas_udf(_shifted, "struct<a: bigint, b: bigint>")(a, b, by)


def prefix_hashes(df: DataFrame, keys: list[str], order: list[str], delta: Column, part_rows: int = 1_000_000) -> DataFrame:
    """df with chars, a, b of all deltas of the key up to each row. The deltas themselves are hashed where they are; only numbers are scanned."""
    own = df.withColumn("_h", text_hash(delta)).select("*", F.col("_h.chars").alias("_n"), F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b")).drop("_h")
    placed = scan(own, keys, order, {"chars": Running("sum", F.col("_n"))}, part_rows)
    terms = placed.withColumn("_t", shifted(F.col("_a"), F.col("_b"), F.col("chars") - F.col("_n"))).select("*", F.col("_t.a").alias("_x"), F.col("_t.b").alias("_y")).drop("_t", "_n", "_a", "_b")
    summed = scan(terms, keys, order, {"a": Running("sum", F.col("_x")), "b": Running("sum", F.col("_y"))}, part_rows)
    return summed.withColumns({"a": F.col("a") % PRIMES[0], "b": F.col("b") % PRIMES[1]}).drop("_x", "_y")


def rewrites(df: DataFrame, keys: list[str], order: list[str], delta: Column, claimed: Column, part_rows: int = 1_000_000) -> DataFrame:
    """Rows of df whose claimed text is not what the deltas so far amount to: an audit of a growing text that holds none. Adds chars (so far) and claimed_chars."""
    told = prefix_hashes(df.withColumn("_c", text_hash(claimed)), keys, order, delta, part_rows)
    same = (F.col("_c.chars") == F.col("chars")) & (F.col("_c.a") == F.col("a")) & (F.col("_c.b") == F.col("b"))
    return told.withColumn("claimed_chars", F.col("_c.chars")).filter(~same).drop("_c", "a", "b")
