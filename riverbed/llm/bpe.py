"""Byte-level BPE by recursive queries: DuckDB contracts token-position rows within each Spark task."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riverbed.llm.chunks import Cache, parts
from riverbed.llm.common import slices

#: Bytes of pre-tokens for one query; a longer pre-token has a query of its own.
QUERY_BYTES = 400_000
#: Pre-tokens of more bytes contract all places of a merge in one step, and forget the rows of older steps; for short ones, which rarely hold a merge twice, one place a step is quicker.
ALL_STEPS = 32

# A row is a token of a word: its place, id, the place after it, the id to its right (-1: none) and the code of the merge that
# this pair allows, 2 * id + 1 for a careful merge and 2 * id for others. Each step takes a word's least code and contracts the leftmost of its pairs that allow it,
# and without need for care all others that do not overlap, from the left: what one after another gives, as no pair that arises comes before them.
# With USING KEY (place) only the newest row of each place is kept; rows of tokens that were contracted away are left at an older step.
_LONG = """
WITH RECURSIVE whole AS (SELECT p.word, v.id FROM pretokens p JOIN vocabulary v ON v.token = p.token),
t(place, step, w, id, after, right_id, code) USING KEY (place) AS (
    SELECT s.place, 0, s.w, s.id, s.place + 1, s.right_id, m.code
    FROM start s ANTI JOIN whole USING (word) LEFT JOIN merges m ON m.pair = (s.id::BIGINT << 17) | s.right_id
    UNION
    (WITH best AS (SELECT w, min(code) AS code FROM t WHERE code IS NOT NULL GROUP BY w),
     hit AS (SELECT t.w, t.place AS p, t.after AS q, t.code FROM t JOIN best b ON b.w = t.w AND b.code = t.code),
     leftmost AS (SELECT w, min(p) AS p, min(q) AS q, (min(code) >> 1)::INTEGER AS new_id, count(*) > 1 AND min(code) & 1 = 0 AS several FROM hit GROUP BY w),
     nth AS (
        SELECT h.*, row_number() OVER x AS nth, lag(h.q) OVER x AS before
        FROM hit h SEMI JOIN (FROM leftmost WHERE several) m USING (w) WINDOW x AS (PARTITION BY h.w ORDER BY h.p)),
     run AS (SELECT *, max(CASE WHEN before IS DISTINCT FROM p THEN nth END) OVER (PARTITION BY w ORDER BY p) AS first FROM nth),
     site AS (SELECT p, q, (code >> 1)::INTEGER AS new_id FROM run WHERE (nth - first) % 2 = 0),
     next AS (
        SELECT CASE WHEN t.place = m.q THEN m.p ELSE t.place END AS place, t.step, t.w, CASE WHEN t.place = m.q THEN m.new_id ELSE t.id END AS id, t.after,
            CASE WHEN t.after = m.p THEN m.new_id ELSE t.right_id END AS right_id, t.code, t.place = m.q OR t.after = m.p AS changed
        FROM t JOIN leftmost m ON m.w = t.w WHERE NOT m.several AND t.place <> m.p
        UNION ALL
        SELECT coalesce(l.p, t.place), t.step, t.w, coalesce(l.new_id, t.id), t.after, coalesce(r.new_id, t.right_id), t.code, l.p IS NOT NULL OR r.p IS NOT NULL
        FROM t SEMI JOIN (FROM leftmost WHERE several) m USING (w) ANTI JOIN site s ON s.p = t.place LEFT JOIN site l ON l.q = t.place LEFT JOIN site r ON r.p = t.after)
     SELECT n.place, n.step + 1, n.w, n.id, n.after, n.right_id, CASE WHEN n.changed THEN m.code ELSE n.code END
     FROM next n LEFT JOIN merges m ON m.pair = CASE WHEN n.changed THEN (n.id::BIGINT << 17) | n.right_id END)
),"""

# The same for words that contract their leftmost pair of least code only, one a step. The least number of code and place together tells both.
_SHORT = """
WITH RECURSIVE whole AS (SELECT p.word, v.id FROM pretokens p JOIN vocabulary v ON v.token = p.token),
t(place, step, w, id, after, right_id, code) AS (
    SELECT s.place, 0, s.w, s.id, s.place + 1, s.right_id, m.code
    FROM start s ANTI JOIN whole USING (word) LEFT JOIN merges m ON m.pair = (s.id::BIGINT << 17) | s.right_id
    UNION ALL
    (WITH least AS (SELECT w, min((code::BIGINT << 32) | place) AS k, arg_min(after, (code::BIGINT << 32) | place) AS q FROM t WHERE code IS NOT NULL GROUP BY w),
     next AS (
        SELECT CASE WHEN t.place = l.q THEN (l.k & 4294967295)::INTEGER ELSE t.place END AS place, t.step + 1 AS step, t.w, CASE WHEN t.place = l.q THEN (l.k >> 33)::INTEGER ELSE t.id END AS id, t.after,
            CASE WHEN t.after = l.k & 4294967295 THEN (l.k >> 33)::INTEGER ELSE t.right_id END AS right_id, t.code, t.place = l.q OR t.after = l.k & 4294967295 AS changed
        FROM t JOIN least l ON l.w = t.w WHERE t.place <> l.k & 4294967295)
     SELECT n.place, n.step, n.w, n.id, n.after, n.right_id, CASE WHEN n.changed THEN m.code ELSE n.code END
     FROM next n LEFT JOIN merges m ON m.pair = CASE WHEN n.changed THEN (n.id::BIGINT << 17) | n.right_id END)
),"""

_TOKENS = """
done AS (SELECT w, max(step) AS step FROM t GROUP BY w),
tokens AS (
    SELECT p.word, t.place, t.id FROM t JOIN done USING (w, step) JOIN pieces p USING (w)
    UNION ALL SELECT word, 0, id FROM whole),
ordered AS (SELECT t.word, t.id, v.hex FROM tokens t JOIN vocabulary v ON v.id = t.id ORDER BY t.place)
SELECT word, string_agg(id::VARCHAR, ' ') AS ids, unhex(string_agg(hex, '')) AS decoded FROM ordered GROUP BY word
"""

_engines: dict[tuple[str, str], Engine] = {}


class Engine:
    """A DuckDB connection with the merge table of a rank file, and caches; one for each worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        merges = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        l, r, i = map(np.array, zip(*merges))
        careful = np.zeros(max(ranks.values()) + 1, bool)  # a pair with such a token may allow a merge that comes before the token's own
        careful[l[i < l]] = careful[r[i < r]] = True
        self._table("merges", pair=pa.array((l << 17) | r, pa.int64()), code=pa.array(2 * i + careful[i], pa.int32()))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), token=pa.array(list(ranks), pa.binary()), hex=pa.array([t.hex() for t in ranks]))
        flat, ends = np.frombuffer(b"".join(ranks), np.uint8), np.cumsum([len(t) for t in ranks])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        self.side_by_side = np.zeros((256, 256), bool)  # bytes that some token holds side by side; no merge crosses others
        self.side_by_side[flat[at], flat[at + 1]] = True
        self.caches = Cache(lambda x: self.encode(x), 50_000), Cache(lambda x: self.encode([" " + t for t in x]), 250_000)

    def _table(self, name: str, **columns) -> None:
        arrow = pa.table(columns)
        self.db.register("arrow_rows", arrow)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of pre-tokens: decimal ids, each followed by a space."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")  # words of a query take about as many steps
        cut = np.diff((np.cumsum(lengths[order]) - 1) // QUERY_BYTES) | np.diff(lengths[order] > ALL_STEPS)
        for some in np.split(order, np.flatnonzero(cut) + 1):
            flat = np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8)
            last = np.zeros(len(flat), bool)
            last[np.cumsum(lengths[some]) - 1] = True
            last[:-1] |= ~self.side_by_side[flat[:-1], flat[1:]]
            w = np.cumsum(last) - last  # bytes between two cuts are merged by themselves
            ids = self.byte_ids[flat]
            right = np.where(last, np.int32(-1), np.r_[ids[1:], np.int32(-1)])
            self._table("pretokens", word=pa.array(some, pa.int32()), token=pa.array([words[k] for k in some.tolist()], pa.binary()))
            self._table("start", **{k: pa.array(v, pa.int32()) for k, v in (("place", np.arange(len(flat)) + w), ("w", w), ("word", np.repeat(some, lengths[some])), ("id", ids), ("right_id", right))})
            ends = np.flatnonzero(last)
            self._table("pieces", w=pa.array(np.arange(len(ends)), pa.int32()), word=pa.array(np.repeat(some, lengths[some])[ends], pa.int32()))
            for k, ids, decoded in self.db.execute((_LONG if len(words[some[-1]]) > ALL_STEPS else _SHORT) + _TOKENS).fetchall():
                if decoded != words[k]:  # rows are sorted by place before they are grouped; this makes sure that the groups kept the order
                    raise ValueError("decoded bytes differ from the pre-token")
                out[k] = (ids.encode() + b" ", decoded)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of parts: each part's pre-tokens are encoded once."""
        split = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        known = list({m for s in split for m in s})
        done: dict[bytes, tuple[bytes, bytes]] = {}
        for at in range(0, len(known), 50_000):
            some = known[at : at + 50_000]
            done.update(zip(some, self.words(some)))
        return [done[s[0]] if len(s) == 1 else (b"".join(done[m][0] for m in s), b"".join(done[m][1] for m in s)) for s in split]


def engine(ranks_path: str, pattern: str) -> Engine:
    key = (ranks_path, pattern)
    if key not in _engines:
        _engines[key] = Engine(ranks_path, pattern)
    return _engines[key]


def encode_texts(texts: list[str], ranks_path: str, pattern: str) -> Iterator[tuple[bytes, bytes]]:
    """(ids, decoded bytes) of each text; decimal ids, each followed by a space."""
    heads, tails = engine(ranks_path, pattern).caches
    cut = [parts(t) for t in texts]
    first = heads.fill({p[0] for p in cut})
    need: set[str] = set()
    for p in cut:
        need.update(p[1:])
    rest = tails.fill(need)
    for p in cut:
        found = [first[p[0]], *map(rest.__getitem__, p[1:])]
        yield b"".join([x[0] for x in found]), b"".join([x[1] for x in found])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    ids_sha256: of the decimal ids joined by one space; decoded_sha256: of the bytes that the ids decode to. A null text counts
    as empty: no tokens. Null doc_ids and repeated rows pass like any other. Only doc_id and text are read. An empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                n, ids_sha, decoded_sha = [], [], []
                for ids, decoded in encode_texts(part.column("text").fill_null("").to_pylist(), ranks_path, pattern):
                    n.append(ids.count(b" "))
                    ids_sha.append(hashlib.sha256(ids[:-1]).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
