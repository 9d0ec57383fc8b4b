"""Fill-in-middle: whole texts cut at token borders and put together anew, with an exact way back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import SPACE, bytes_of, slices

#: Fixed values of the output's form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def ends(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Where tokens (white space and the word after it, or white space at the end of the text) end, in bytes low < end <= high."""
    word = ~SPACE[data[low:high]]
    last = np.ones(high - low, bool)
    after = data[low + 1 : high + 1]
    last[: len(after)] = SPACE[after]
    last &= word
    if high == len(data) and high > low:
        last[-1] = True
    return np.flatnonzero(last) + low + 1


def points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Checkpoints:
    """Sparse index of a text's tokens, made while they are counted: the byte and the code point after every step tokens.

    The text is read in windows, so that the index and one window are all that is held beside it. To find the end of any token, the
    last checkpoint before it is searched for by bisection, and the text is read again from there, step tokens at most.
    """

    def __init__(self, data: np.ndarray, step: int = 512, window: int = 1 << 16):
        self.data, self.window = data, window
        unit, at, place = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.n = seen = 0
        for low in range(0, len(data), window):
            part = data[low : low + window]
            found = ends(data, low, low + len(part))
            first = -(self.n + 1) % step
            marks = found[first::step]
            if len(marks):
                unit.append(self.n + first + 1 + step * np.arange(len(marks)))
                at.append(marks)
                place.append(seen + np.cumsum((part & 0xC0) != 0x80)[marks - low - 1])
            self.n += len(found)
            seen += points(part)
        self.unit, self.at, self.place = np.concatenate(unit), np.concatenate(at), np.concatenate(place)

    def cut(self, k: int) -> tuple[int, int]:
        """The byte and the code point where the k-th token ends; the start of the text for 0."""
        i = int(np.searchsorted(self.unit, k, "right")) - 1
        left, low, place = k - int(self.unit[i]), int(self.at[i]), int(self.place[i])
        while left:
            high = min(low + self.window, len(self.data))
            found = ends(self.data, low, high)
            if len(found) >= left:
                high = int(found[left - 1])
            left -= min(left, len(found))
            place += points(self.data[low:high])
            low = high
        return low, place


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 from the digest of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearrange(data: np.ndarray, doc_id: int | None, seed: int, percent: int, spm_percent: int, step: int, window: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, code points of prefix and middle (null if plain), output."""
    index, raw, h = Checkpoints(data, step, window), data.tobytes(), draws(doc_id, seed)
    if not raw or h[2] % 100 >= percent or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, raw
    (a, a_place), (b, b_place) = map(index.cut, sorted(x % (index.n + 1) for x in h[:2]))
    if h[3] % 100 < spm_percent:
        return index.n, "spm", a_place, b_place - a_place, b"".join((SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b]))
    return index.n, "psm", a_place, b_place - a_place, b"".join((PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, step: int = 512, window: int = 1 << 16) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs (doc_id, text).

    Tokens are white space with the word after it. Two of a text's n + 1 token borders, drawn by a digest of seed and doc_id, bound its middle. Of all texts, percent in a
    hundred are rearranged, spm_percent in a hundred of these with the suffix first; others, empty texts and those that hold a mark themselves are plain, that is left as they are.

    A null text counts as empty; a null doc_id draws by the digest of the seed and nothing, so equal texts with it are cut alike. Repeated rows give equal rows. A text of any length is read whole, in
    windows. Only doc_id and text are read, so other columns may have any names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = bytes_of(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                rows = [rearrange(data[offsets[k] : offsets[k + 1]], i, seed, percent, spm_percent, step, window) for k, i in enumerate(ids)]
                n, form, prefix, middle, output = zip(*rows)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip((n, form, prefix, middle), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made from. No mark stands in its parts, nor can one arise where a part meets a mark."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
