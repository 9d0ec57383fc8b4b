"""License scans: an exact set-similarity join of text blocks with license templates, beside places of fixed phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import bytes_of, slices, word_hash, words

# Phrases with their labels, notices of one sentence, headers of files, and whole license texts.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
}
#: A template of fewer distinct words must be there in full.
SHORT = 15

#: A word is a run of digits, ASCII letters and characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def template_words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = words(data, np.array([0, len(data)]), BETWEEN)
    return [data[s:e].tobytes().lower() for s, e in zip(starts, ends)]


def needed(size: int, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return size if size < SHORT else math.ceil(threshold * size - 1e-9)


def width(n: int) -> int:
    """Words of a block, for a template of n words: a quarter more, two at least."""
    return n + max(2, n // 4)


def token_frequencies(docs: DataFrame, vocabulary: list[int]) -> dict[int, int]:
    """In how many texts of the corpus each word hash of the vocabulary stands; executors count, the driver gets one row for each."""
    known = np.array(sorted(vocabulary), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch):
                h, _, _, row = words(*bytes_of(part.column("text")), BETWEEN)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                on = known[at] == h
                pairs = np.unique(row[on] * len(known) + at[on])
                total += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"] % (1 << 64): r["n"] for r in rows}


class Index:
    """Templates as sets of ranks in the order of rising frequency over all template words, indexed by their prefixes.

    A block that holds need of a template's words must hold one of its size - need + 1 rarest ones.
    """

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[int, int]):
        texts = [template_words(t) for t in templates.values()]
        spelled = {word_hash(w.decode()): w for t in texts for w in t}
        order = sorted(spelled, key=lambda x: (frequency.get(x, 0), x))
        rank = {x: k for k, x in enumerate(order)}
        self.spelled = [spelled[x] for x in order]
        self.known = np.array(sorted(order), np.uint64)
        self.rank = np.array([rank[int(x)] for x in self.known], np.int64)
        self.labels, self.sets, self.need, self.width = list(templates), [], [], []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, text in enumerate(texts):
            ordered = sorted({rank[word_hash(w.decode())] for w in text})
            self.sets.append(set(ordered))
            self.need.append(needed(len(ordered), threshold))
            self.width.append(width(len(text)))
            for k, x in enumerate(ordered[: len(ordered) - self.need[t] + 1]):
                self.index.setdefault(x, []).append((t, k))
        self.prefix = np.zeros(len(order) + 1, bool)
        self.prefix[list(self.index)] = True

    def search(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, template, containment) of all blocks that reach the threshold, for words with hashes h and their bytes; rows ascend. A block is any run of width words of a row."""
        if not len(h) or not len(self.known):
            return
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == h)
        ranks, of = self.rank[at[hits]], row[hits]
        for r in np.unique(of[self.prefix[ranks]]).tolist():
            lo, hi = np.searchsorted(of, [r, r + 1])
            have = np.unique(ranks[lo:hi]).tolist()
            first: dict[int, tuple[int, int]] = {}
            for j, x in enumerate(have):
                for t, k in self.index.get(x, ()):
                    first.setdefault(t, (k, j))
            for t, (k, j) in first.items():
                need, own = self.need[t], self.sets[t]
                # length; then what can follow the first shared word in the template and in the block; then what is shared
                if len(have) < need or min(len(own) - k, len(have) - j) < need or sum(x in own for x in have) < need:
                    continue
                places = [(int(p), x) for p, x in zip(hits[lo:hi], ranks[lo:hi].tolist()) if x in own and data[starts[p] : ends[p]].tobytes().lower() == self.spelled[x]]
                shared = most_distinct(places, self.width[t])
                if shared >= need:
                    yield r, t, shared / len(own)


def most_distinct(places: list[tuple[int, int]], width: int) -> int:
    """The most distinct values in a window of width places."""
    count: dict[int, int] = {}
    best = lo = 0
    for p, x in places:
        count[x] = count.get(x, 0) + 1
        while places[lo][0] <= p - width:
            old = places[lo][1]
            count[old] -= 1
            if not count[old]:
                del count[old]
            lo += 1
        best = max(best, len(count))
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    n_base counts all places where a phrase stands, first_word and last_word are the smallest and largest of them in words from
    0 (else null). A block is any run of as many words as a template has and a quarter (two at least) more, over line ends and
    blank lines alike; a template matches a block that holds at least threshold of its distinct words, or all of them if they are fewer than SHORT. labels are those of
    phrases and templates; score is the largest containment of a match, 1 if a phrase stands there, else 0.

    A null text counts as empty. Null doc_ids and repeated rows pass like any other; only doc_id and text are read. Templates and phrases are
    parameters of fixed size, sent to each task. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    frequency = token_frequencies(docs, sorted({x for t in templates.values() for x in map(word_hash, map(bytes.decode, template_words(t)))})) if templates else {}
    index = Index(templates, threshold, frequency)
    coded = [([np.uint64(word_hash(w)) for w in p.split(" ")], p.encode().split(b" "), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                data, offsets = bytes_of(part.column("text"))
                h, starts, ends, row = words(data, offsets, BETWEEN)
                n_words = np.bincount(row, minlength=n)
                begin = np.cumsum(n_words) - n_words
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set] = [set() for _ in range(n)]
                labels: list[set] = [set() for _ in range(n)]
                score = np.zeros(n)
                for hashes, plain, label in coded:
                    at = np.flatnonzero(h[: len(h) - len(hashes) + 1] == hashes[0]) if len(h) >= len(hashes) else np.zeros(0, np.int64)
                    for k in at.tolist():
                        if row[k + len(hashes) - 1] == row[k] and all(data[starts[k + j] : ends[k + j]].tobytes().lower() == w for j, w in enumerate(plain)):
                            places[row[k]].append(k - int(begin[row[k]]))
                            base[row[k]].add(label)
                            score[row[k]] = 1.0
                for r, t, c in index.search(data, h, starts, ends, row):
                    labels[r].add(index.labels[t])
                    score[r] = max(score[r], c)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels)]), pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
