"""Repeated passages: MinHash banding of paragraphs that content cuts and of all windows of 50 words, exact checks, components, and removal of all but the first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.buckets import link, tune_bands
from riverbed.llm.common import Scratch, bytes_of, mix, odd, powers, shingles, slices, words
from riverbed.llm.near_dup import band_column, fold_bands


def minhash(rows: np.ndarray, keys: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, uint64) of n sets of keys whose rows ascend."""
    sign = np.zeros((n, m), np.uint64)
    if len(keys):
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for k in range(m):
            h = keys * (odd(2 * k + 1) | np.uint64(1)) + odd(k + 77)
            sign[rows[at], k] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), at)
    return sign


#: Equal runs of RUN words are repeats. Each RUN words hold RUN - GRAM + 1 runs of GRAM words, and the least of their hashes stands for them.
RUN, GRAM = 50, 25


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, those across two rows among them."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    p, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * p[:n], out=sums[1:], dtype=np.uint64)
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbours."""
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = size - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def run_hash(hashes: np.ndarray, start: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each run of n words from start."""
    p, inverse = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + odd(seed)) * p[: len(hashes)], out=sums[1:], dtype=np.uint64)
    return mix((sums[start + n] - sums[start]) * inverse[start] + n.astype(np.uint64))


#: Words on both sides that decide whether a paragraph begins: paragraphs have more than so many, and twice as many on average.
REACH = 20


def paragraphs(hashes: np.ndarray, row: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the paragraphs of all rows, whose numbers ascend; every word is in exactly one.

    A paragraph begins at each row's first word, and where the hash of a word and the one before it is less than those of the
    reach words before and no more than those of the reach words after. So the same passage is cut alike wherever it stands, but for reach words at
    its ends, and line breaks do not matter. No border lies within reach words of a row's ends.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.r_[True, row[1:] != row[:-1]]
    if n > 2 * reach + 1:
        pair = np.r_[np.uint64(0), mix(hashes[:-1] * odd(9) + mix(hashes[1:]))]
        least = least_of(pair, reach)  # from k to k + reach - 1
        at = np.arange(reach + 1, n - reach)
        inner = (pair[at] < least[at - reach]) & (pair[at] <= least[at + 1]) & (row[at - reach - 1] == row[at + reach])
        border[at[inner]] = True
    start = np.flatnonzero(border)
    return start, np.diff(np.r_[start, n])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_digest", F.xxhash64("text"))


def similar_paragraphs(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, _digest, start, n, first_doc_id, first_start) for every paragraph that repeats an earlier one: its text's digest, its first word from 0, its words.

    Two paragraphs (see paragraphs()) are linked if the sets of their runs of five words have Jaccard similarity 0.8 or more; one
    of fewer words than a run has none and is left alone. Of each component the first by (doc_id, start) is not in the result; all others
    are, with that first one beside them. Links need a shared band; recall is that of a pair at the threshold.

    Rows with a null doc_id or text have no paragraphs. Rows that repeat doc_id and text count as one. Only doc_id and text
    are read. An empty table gives no rows. RuntimeError if components do not settle within 60 rounds.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bands, width = tune_bands(threshold, recall)
    docs = keyed(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, _, _, row = words(*bytes_of(part.column("text")))
                start, n = paragraphs(h, row)
                on = n >= size
                s, r = shingles(h, np.repeat(np.arange(len(n)), n), size)
                keep = on[r]
                start, n = start[on], n[on]
                keys = fold_bands(minhash((np.cumsum(on) - 1)[r[keep]], s[keep], len(n), bands * width), bands)
                of = pa.array(row[start])
                first = np.searchsorted(row, row[start])
                ints = lambda x: pa.array(x.astype(np.int32))
                longs = lambda k: pa.array(run_hash(h, start, n, k).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), part.column("_digest").take(of), ints(start - first), ints(n), longs(1), longs(2), band_column(keys, np.ones(len(n), bool))],
                    ["doc_id", "_digest", "start", "n", "uid", "check", "bands"],
                )

    place = F.struct("doc_id", "start", "_digest", "n")
    signed = scratch.save(docs.mapInArrow(sign, "doc_id long, _digest long, start int, n int, uid long, check long, bands array<long>"))
    # equal paragraphs are one unit: uid and check are two hashes of its words
    linked, shared = link(scratch, signed.groupBy("uid").agg(F.first("bands").alias("bands")), lambda uids: _texts(docs, signed, uids), threshold, size)
    units = scratch.save(signed.groupBy("uid").agg(F.min(F.struct("check", place.alias("place"))).alias("s"), F.count("*").alias("times")).join(shared.select("uid").distinct().withColumn("met", F.lit(True)), "uid", "left").filter("times > 1 or met").select("uid", "s.check", "s.place"))
    parts = units.join(linked, F.col("uid") == F.col("node"), "left").select("uid", "check", "place", F.coalesce("root", "uid").alias("part"))
    firsts = parts.groupBy("part").agg(F.min("place").alias("first"))
    known = scratch.save(parts.join(firsts, "part").select("uid", "check", "first"))
    placed = signed.select("doc_id", "_digest", "start", "n", "uid", "check").join(known, ["uid", "check"])
    again = placed.filter("not (doc_id = first.doc_id and start = first.start and _digest = first._digest)")
    return again.select("doc_id", "_digest", "start", "n", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")).distinct()


def _texts(docs: DataFrame, signed: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, text) of one place of each of these paragraphs."""
    one = signed.join(uids, "uid", "left_semi").groupBy("uid").agg(F.min(F.struct("doc_id", "_digest", "start", "n")).alias("s"))
    wanted = one.groupBy("s.doc_id", "s._digest").agg(F.collect_list(F.struct("uid", "s.start", "s.n")).alias("wanted"))  # no more than a text has words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = bytes_of(part.column("text"))
                _, begin, end, row = words(data, offsets)
                base = np.searchsorted(row, np.arange(part.num_rows))
                raw, uid, text = data.tobytes(), [], []
                for k, xs in enumerate(part.column("wanted").to_pylist()):
                    for x in xs:
                        s = base[k] + x["start"]
                        uid.append(x["uid"])
                        text.append(raw[begin[s] : end[s + x["n"] - 1]])
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["uid", "text"])

    return docs.join(wanted, ["doc_id", "_digest"]).dropDuplicates(["doc_id", "_digest"]).select("text", "wanted").mapInArrow(cut, "uid long, text string")


def run_starts(row: np.ndarray) -> np.ndarray:
    """Numbers of the words (with their rows, ascending) at which a run of RUN words starts that ends in the same row."""
    return np.flatnonzero(row[: max(0, len(row) - RUN + 1)] == row[RUN - 1 :]) if len(row) >= RUN else np.zeros(0, np.int64)


def window_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, _digest, least, start, n, region): neighbouring windows of RUN words from start on, n of them, that have one least hash; region is a hash of all their words.

    least is the MinHash, one band of one row, of a window's runs of GRAM words. Equal windows have equal ones.
    """

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, _, _, row = words(*bytes_of(part.column("text")))
                at = run_starts(row)
                if not len(at):
                    continue
                least = least_of(runs_of(h, GRAM), RUN - GRAM + 1)[at]
                new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[at[1:]] != row[at[:-1]])])
                begin = np.searchsorted(row, row[at[new]])
                n = np.diff(np.r_[new, len(at)])
                region = run_hash(h, at[new], n + RUN - 1, 3)
                of = pa.array(row[at[new]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), part.column("_digest").take(of), pa.array(least[new].view(np.int64)), pa.array((at[new] - begin).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(region.view(np.int64))],
                    ["doc_id", "_digest", "least", "start", "n", "region"],
                )

    return docs.select("doc_id", "_digest", "text").mapInArrow(fingerprint, "doc_id long, _digest long, least long, start int, n int, region long")


SALTS = 8
SPAN = "array<struct<start:int,n:int>>"


def _place() -> Column:
    return F.struct("doc_id", "_digest", "start")


def _apart(place: str) -> str:
    """Not the same window as that at place, nor one that overlaps it."""
    return f"not (doc_id = {place}.doc_id and _digest = {place}._digest and start - {place}.start < {RUN})"


def repeated_regions(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc_id, _digest, start, n): spans of words that repeat earlier ones, and windows from start on, n of them, that are still to be compared one by one.

    Regions whose least hash stands once are unique. Equal regions repeat the first of them. Where different regions share a least hash, the
    first place of each is to be compared; all its other places are repeats already.
    """
    prints = scratch.save(window_runs(docs))
    often = prints.groupBy("least").agg(F.sum(F.when(F.col("n") > RUN, 2).otherwise(1)).alias("times")).filter("times > 1").select("least")
    hot = scratch.save(prints.join(often, "least"))
    scratch.drop(prints)
    regions = scratch.save(hot.groupBy("least", "region").agg(F.min(_place()).alias("first"), F.max("n").alias("n"), F.count("*").alias("times")))
    repeats = hot.join(regions.filter("times > 1").select("least", "region", "first"), ["least", "region"]).filter(_apart("first"))
    mixed = regions.groupBy("least").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter(f"kinds > 1 or most > {RUN}").select("least")
    windows = regions.join(mixed, "least").select("first.doc_id", "first._digest", "first.start", "n")
    return repeats.select("doc_id", "_digest", "start", (F.col("n") + RUN - 1).alias("n")), windows


def repeated_windows(scratch: Scratch, held: DataFrame) -> DataFrame:
    """(doc_id, _digest, start, n) for windows of RUN words that repeat an earlier one, of the windows that column _hot of held lists."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, _, _, row = words(*bytes_of(part.column("text")))
                begin = np.searchsorted(row, np.arange(part.num_rows))
                at = [begin[k] + np.arange(x["start"], x["start"] + x["n"]) for k, xs in enumerate(part.column("_hot").to_pylist()) for x in xs]
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                of = pa.array(row[at])
                one, two = runs_of(h, RUN)[at], runs_of(mix(h + odd(RUN)), RUN)[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(of), part.column("_digest").take(of), pa.array((at - begin[row[at]]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc_id", "_digest", "start", "one", "two"],
                )

    whole = scratch.save(held.filter("_hot is not null").select("doc_id", "_digest", "text", "_hot").mapInArrow(compare, "doc_id long, _digest long, start int, one long, two long"))
    firsts = whole.groupBy("one", "two").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first <> last").select("one", "two", "first")
    salt = F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(SALTS)).cast("int")  # a common passage has as many windows as places
    firsts = firsts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return whole.withColumn("salt", salt).join(firsts, ["one", "two", "salt"]).filter(_apart("first")).select("doc_id", "_digest", "start", F.lit(RUN).alias("n")).distinct()


def without_words(text: str, spans: list[dict]) -> tuple[str, str]:
    """The text without these spans of words, and the spans joined: first:end, in words, commas between; of the white space on both sides of a
    span one stays, the one with a line break if there is one."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, begin, end, _ = words(data, np.array([0, len(data)]))
    gone = np.zeros(len(begin) + 1, np.int64)
    start, n = (np.array([x[k] for x in spans], np.int64) for k in ("start", "n"))
    np.add.at(gone, start, 1)
    np.add.at(gone, start + n, -1)
    gone = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    out, done, told = [], 0, []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        s, e = int(begin[a]), int(end[b - 1])
        before = int(end[a - 1]) if a else 0
        after = int(begin[b]) if b < len(begin) else len(raw)
        if a and (b == len(begin) or (b"\n" in raw[e:after] and b"\n" not in raw[before:s])):
            s = before
        else:
            e = after
        out.append(raw[done:s])
        told.append(f"{a}:{b}")
        done = e
    return b"".join([*out, raw[done:]]).decode(), ",".join(told)


def drop_repeats(docs: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """All rows and columns of docs (doc_id, text), text without its repeats; removed string (first:end of words, commas between; empty if none) comes after them.

    A paragraph goes if it is similar to an earlier one (similar_paragraphs, which takes how), and every run of RUN words goes that
    stands earlier too, in another text or before it in the same one. Words are those of shingles, the case of A-Z ignored; line breaks are
    white space like any other. Of equal runs the first by (doc_id, digest of the text, word) stays. No length, place or number of repeats
    is left out: equal windows of RUN words have equal least hashes of GRAM words, so windows whose least hash stands once are unique; the
    others are compared by region, then one by one, by 128 bits of hash.

    Rows with a null doc_id or text pass as they are, and so do empty texts. Rows that repeat doc_id and text count as one and get the same text. A column of docs named
    removed is replaced; others may have any name that does not begin with an underscore. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.drop("removed")
    columns = docs.columns
    rows = keyed(docs)
    some = rows.filter("doc_id is not null and text is not null")
    first, second = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    similar = scratch.save(similar_paragraphs(docs, scratch=first, **how).select("doc_id", "_digest", "start", "n"))
    first.end()
    repeats, windows = repeated_regions(second, some)
    span = F.struct("start", "n")
    gone = similar.unionByName(repeats).select("doc_id", "_digest", span.alias("gone"), F.lit(None).cast("struct<start:int,n:int>").alias("hot"))
    hot = windows.select("doc_id", "_digest", F.lit(None).cast("struct<start:int,n:int>").alias("gone"), span.alias("hot"))
    marks = gone.unionByName(hot).groupBy("doc_id", "_digest").agg(F.collect_set("gone").alias("_gone"), F.collect_set("hot").alias("_hot"))
    marks = marks.withColumn("_hot", F.when(F.size("_hot") > 0, F.col("_hot")))
    held = scratch.save(rows.join(marks, ["doc_id", "_digest"], "left").select(*columns, "_digest", "_gone", "_hot"))
    second.end()
    # written before the texts are joined with it, so that windows and their shuffles are gone by then
    third = Scratch(docs.sparkSession)
    more = scratch.save(repeated_windows(third, held).groupBy("doc_id", "_digest").agg(F.collect_set(span).alias("_more")))
    third.end()
    touched = held.filter("_gone is not null").join(more, ["doc_id", "_digest"], "left").select(*columns, F.concat("_gone", F.coalesce("_more", F.array().cast(SPAN))).alias("_gone"))
    schema = touched.drop("_gone").withColumn("removed", F.lit("")).schema
    text = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.columns[:-1]
            new = [without_words(t, spans) if spans else (t, "") for t, spans in zip(left[text].to_pylist(), batch.column("_gone").to_pylist())]
            left[text] = pa.array([x[0] for x in new], batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([*left, pa.array([x[1] for x in new], pa.string())], [*columns, "removed"])

    return held.filter("_gone is null").select(*columns, F.lit("").alias("removed")).unionAll(touched.mapInArrow(cut, schema))
