"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers for all other tokens."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import sampled

# Fixed values.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "markov"]

CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_CODE = np.full(128, len(CHARS), np.int64)
_CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
STATES = len(CHARS) + 1
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, leftmost and non-overlapping for each kind; matches that are too short are left out."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def transitions(token: str) -> np.ndarray:
    """Numbers of the pairs of neighbouring characters."""
    c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return c[:-1] * STATES + c[1:]


def union(spans: list[tuple[str, int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that spans cover, in order and apart from each other."""
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e, _ in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def outside(start: int, end: int, starts: list[int], ends: list[int]) -> bool:
    k = bisect_right(ends, start)
    return k == len(starts) or starts[k] >= end


def random_strings(n: int = 2000, seed: int = 5) -> list[str]:
    """Labelled samples of the kind that no corpus need hold: uniform strings over usual alphabets."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", CHARS[:62], CHARS[26:62], CHARS[:64], CHARS[:62] + "-_"]
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), int(rng.integers(16, 64)))) for k in range(n)]


def fit(docs: DataFrame, sample_docs: int = 5000) -> np.ndarray:
    """Log-likelihood ratio of each transition, random string against ordinary identifier (add-one smoothing).

    Labelled samples come from a sample of sample_docs documents at most: values of the fixed patterns are random strings, as are
    random_strings(); all other tokens of four characters or more are ordinary. Executors count transitions; the driver gets
    two tables whose size the alphabet fixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for text in batch.column("text").fill_null("").to_pylist():
                spans = base_spans(text)
                covered = union(spans)
                for _, _, _, value in spans:
                    total[1] += np.bincount(transitions(value), minlength=total.shape[1])
                rest = [m[0] for m in _TOKEN.finditer(text) if m.end() - m.start() >= 4 and (not spans or outside(m.start(), m.end(), *covered))]
                if rest:  # one array for all: a pair that spans two tokens has the extra state in it
                    codes = _CODE[np.frombuffer("\x7f".join(rest).encode("ascii"), np.uint8)]
                    total[0] += np.bincount(codes[:-1] * STATES + codes[1:], minlength=total.shape[1])
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(total[label, pair])], ["label", "pair", "n"])

    rows = sampled(docs, sample_docs).select("text").mapInArrow(count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, STATES * STATES))
    for r in rows:
        table[r["label"], r["pair"]] = r["n"]
    for s in random_strings():
        np.add.at(table[1], transitions(s), 1)
    table = table.reshape(2, STATES, STATES)[:, :-1, :-1] + 1.0
    table = np.log(table / table.sum(axis=2, keepdims=True))
    out = np.zeros((STATES, STATES))
    out[:-1, :-1] = table[1] - table[0]
    return out.reshape(-1)


def stretches(start: int, end: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """What covered places leave of a token."""
    left, k = [], bisect_right(ends, start)
    while k < len(starts) and starts[k] < end:
        if starts[k] > start:
            left.append((start, starts[k]))
        start = ends[k]
        k += 1
    return [*left, (start, end)] if start < end else left


def sums(parts: list[str], ratio: np.ndarray) -> np.ndarray:
    """The summed log-likelihood ratio of each string; the ratio of a pair that spans two of them is zero."""
    codes = _CODE[np.frombuffer("\x7f".join(parts).encode("ascii"), np.uint8)]
    total = np.r_[0.0, np.cumsum(ratio[codes[:-1] * STATES + codes[1:]])]
    ends = np.cumsum([len(x) + 1 for x in parts]) - 2
    return total[ends] - total[ends - [len(x) - 1 for x in parts]]


def markov_spans(text: str, known: list[tuple[str, int, int, str]], ratio: np.ndarray, min_chars: int, min_mean: float, min_sum: float) -> list[tuple[str, int, int, str]]:
    """What known spans leave of tokens, if its mean log-likelihood ratio is min_mean or more; with fewer than min_chars characters, if its sum is min_sum or more.

    Where a stretch as a whole falls short, its parts between = are scored one by one.
    """
    need = lambda n: min_mean * (n - 1) if n >= min_chars else min_sum
    least = min(min_chars, max(2, 1 + int(np.ceil(min_sum / max(ratio.max(), 1e-9)))))  # no shorter string can reach the sum
    places = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % least, text)]
    if known:
        covered = union(known)
        places = [x for s, e in places for x in stretches(s, e, *covered) if x[1] - x[0] >= least]
    found = []
    while places:
        parts, again = [text[s:e] for s, e in places], []
        for (s, e), part, total in zip(places, parts, sums(parts, ratio).tolist()):
            if total >= need(e - s):
                found.append(("markov", s, e, part))
            elif "=" in part:
                again += [(s + m.start(), s + m.end()) for m in re.finditer("[^=]{%d,}" % least, part)]
        places = again
    return found


def all_spans(text: str, ratio: np.ndarray, min_chars: int = 20, min_mean: float = 1.0, min_sum: float = 12.0) -> list[tuple[str, int, int, str]]:
    """All spans by start, then kind."""
    base = base_spans(text)
    return sorted(base + markov_spans(text, base, ratio, min_chars, min_mean, min_sum), key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every row of docs (doc_id, text).

    Spans are kind:start:end in code points, by start, then kind, joined by commas; base_sha256 is the digest of those of the
    fixed patterns alone. A null text counts as empty. Null doc_ids and repeated rows pass like any other; only doc_id and text are read. An empty table gives no rows.
    """
    ratio = fit(docs) if ratio is None else ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").fill_null("").to_pylist():
                found = all_spans(text, ratio)
                kinds = [x[0] for x in found]
                counts.append([kinds.count(k) for k in KINDS])
                digests.append(hashlib.sha256(joined([x for x in found if x[0] != "markov"]).encode()).hexdigest())
                spans.append(joined(found))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, ratio: np.ndarray | None = None, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; in text every span is replaced by mask, and overlapping ones by a single mask. Null stays null."""
    ratio = fit(docs) if ratio is None else ratio
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = all_spans(text, ratio) if text else []
        if not spans:
            return text
        out, done = [], 0
        for _, s, e, _ in spans:
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
