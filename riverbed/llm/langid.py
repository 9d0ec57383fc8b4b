"""Language identification with hyperdimensional profiles: permuted random letter vectors bound into trigram vectors, bundled, compared by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import crc, sampled, slices

SYMBOLS = 128


@lru_cache(4)
def letters(dim: int, seed: int) -> np.ndarray:
    """Item memory: a random vector of +1 and -1 for each symbol; 0 is a non-letter, 1 to 26 are a to z, other letters share the rest by code point."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))


@lru_cache(1)
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return table


def padded(text: str) -> str:
    return f" {text.lower()} "


def bundles(low: list[str], dim: int, seed: int) -> np.ndarray:
    """The bundled trigram vectors (n x dim) of padded texts, or of one piece of such: sums over all trigrams whose middle is a letter; zero without letters."""
    sizes = np.array([len(t) for t in low])
    codes = symbol_table()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    row = np.repeat(np.arange(len(low)), sizes)
    middle = np.flatnonzero(codes[1:-1]) + 1  # never an end of a text or piece
    gram = (codes[middle - 1] << 14) | (codes[middle] << 7) | codes[middle + 1]
    seen = np.zeros(SYMBOLS**3, np.int32)
    seen[gram] = 1
    distinct = np.flatnonzero(seen)
    seen[distinct] = np.arange(len(distinct))
    counts = np.bincount(row[middle] * len(distinct) + seen[gram], minlength=len(low) * len(distinct)).reshape(len(low), -1)
    item = letters(dim, seed)
    vectors = np.roll(item, 2, 1)[distinct >> 14] * np.roll(item, 1, 1)[(distinct >> 7) & 127] * item[distinct & 127]
    return counts.astype(np.float32) @ vectors


#: Rows, and characters of a long text, that one step takes at most; a step's counts are a dense table of rows by trigrams.
STEP_ROWS, STEP_CHARS = 512, 1 << 20


def _steps(batch: pa.RecordBatch, dim: int, seed: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with the bundles of their texts; pieces of a long text share two characters, so that every trigram is in one of them."""
    for some in slices(batch, limit=1 << 20):
        for at in range(0, some.num_rows, STEP_ROWS):
            part = some.slice(at, STEP_ROWS)
            low = [padded(t) for t in part.column("text").fill_null("").to_pylist()]
            if len(low) > 1 or len(low[0]) <= STEP_CHARS:
                yield part, bundles(low, dim, seed)
            else:
                yield part, sum(bundles([low[0][k : k + STEP_CHARS + 2]], dim, seed).astype(np.float64) for k in range(0, len(low[0]) - 2, STEP_CHARS))


def fit(labelled: DataFrame, dim: int = 1024, seed: int = 11, most_docs: int = 20_000, most_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit vectors): sums of the unit vectors of labelled texts (text, lang, doc_id).

    Learns from a sample of most_docs rows at most, and of its languages the most_langs that most rows have (ties: the first in order). Executors bundle;
    the driver gets one vector for each of these.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, v in _steps(batch, dim, seed):
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs.tolist()):
                    total[lang] = total.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim)), pa.array(v.astype(np.float64))], ["lang", "k", "v"])

    known = sampled(labelled.filter("lang is not null").select("doc_id", "text", "lang"), most_docs)
    often = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    known = known.join(F.broadcast(often), "lang").select("text", "lang")  # one row for each language, most_langs at most
    sums = known.mapInArrow(bundle, "lang string, k long, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    at = {lang: i for i, lang in enumerate(langs)}
    proto = np.zeros((len(langs), dim))
    for r in sums:
        proto[at[r["lang"]], r["k"]] = r["v"]
    return langs, proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = 11) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text): the language of the most similar prototype and the cosine, from 0 to 1.

    A null text, one without letters, or any text if no language is known: und and 0. Ties go to the first language in order. Null doc_ids and
    repeated rows pass like any other; only doc_id and text are read. An empty table gives no rows.
    """
    dim = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in _steps(batch, dim, seed):
                norm = np.linalg.norm(v, axis=1)
                cos = v @ prototypes.T / np.maximum(norm, 1e-9)[:, None] if len(langs) else np.zeros((len(v), 1))
                best = cos.argmax(axis=1)
                ok = (norm > 0) & bool(langs)
                pred = [langs[k] if o else "und" for k, o in zip(best, ok)]
                score = np.where(ok, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int):
    """Whether a row is held out from learning: the CRC-32 of doc_id's decimal text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.pmod(crc("doc_id"), F.lit(modulus)) == remainder, F.lit(False))
