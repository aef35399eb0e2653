"""License scans by patience alignment.

Words are compared without case and punctuation. Of a template's words, the rarest (the longest) are its seeds, as many as leave
too few for the wanted coverage: a text that covers enough holds one of them. Around each place of a seed a window as long as the
template, and a little wider, is aligned: words that occur once in both are anchors, the longest run of them that rises in both is
kept, and the gaps between them are aligned in the same way; where a gap has no anchor, equal words at its two ends are matched.
The share of the template's words that are aligned is its coverage.
"""

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words

MIN_COVERAGE = 0.8
#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose seconds rise: patience sorting with links to the pile before."""
    tops, at, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        once_a, once_b = {}, {}
        for once, words_, lo, hi in ((once_a, a, a0, a1), (once_b, b, b0, b1)):
            for i in range(lo, hi):
                once[words_[i]] = -1 if words_[i] in once else i
        anchors = rising([(i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0])
        if anchors:
            out += anchors
            last_a, last_b = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if last_a < i and last_b < j:
                    todo.append((last_a, i, last_b, j))
                last_a, last_b = i + 1, j + 1
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], min_coverage: float):
        self.min_coverage, self.all = min_coverage, []
        seeds = {}
        for k, (name, text) in enumerate(sorted(texts.items())):
            hashes, _, first = words.word_places([text.encode()], bare=True)
            hashes = hashes.tolist()
            n = len(hashes)
            if not n:
                continue
            need = int(np.ceil(min_coverage * n - 1e-9))
            length = np.diff(np.r_[first, len(text) + 1]).tolist()
            rare = sorted(range(n), key=lambda i: (-length[i], i))
            self.all.append((name, hashes, need))
            for i in rare[: n - need + 1]:
                seeds.setdefault(hashes[i], []).append((len(self.all) - 1, i))
        self.seeds = seeds
        self.hashes = np.array(sorted(seeds), dtype=np.uint64)

    def scan(self, text: bytes, hashes: np.ndarray, first: np.ndarray, hits: np.ndarray):
        """name, start, end (characters), coverage of the matches in one text, those of one template not overlapping: the best
        covered first, then the earliest."""
        tried: dict[int, dict[int, list]] = {}
        for h in hits.tolist():
            for k, i in self.seeds[int(hashes[h])]:
                tried.setdefault(k, {}).setdefault((h - i) // max(1, len(self.all[k][1]) // 8), [h, i])
        for k, windows in sorted(tried.items()):
            name, template, need = self.all[k]
            n, found = len(template), []
            for h, i in windows.values():
                best = []
                for slack in (0, max(2, n // 4)):
                    lo, hi = max(0, h - i - slack), min(len(hashes), h - i + n + slack)
                    got = align(template, hashes[lo:hi].tolist())
                    if len(got) > len(best):
                        best = [(x, y + lo) for x, y in got]
                if len(best) >= need:
                    found.append((-len(best), best[0][1], best[-1][1]))
            taken: list[tuple[int, int]] = []
            for m, lo, hi in sorted(set(found)):
                if all(hi < x or lo > y for x, y in taken):
                    taken.append((lo, hi))
                    end = int(first[hi])
                    while end < len(text) and words._BARE[text[end]]:
                        end += 1
                    yield name, len(text[: int(first[lo])].decode("utf-8", "ignore")), len(text[:end].decode("utf-8", "ignore")), -m / n

    def found(self, texts: list[bytes]):
        for a, z in words.chunks(texts):
            flat, cuts, first = words.word_places(texts[a:z], bare=True)
            if not len(flat) or not len(self.hashes):
                continue
            place = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
            hits = np.flatnonzero(self.hashes[place] == flat)
            starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts[a:z]])]
            for t in np.unique(np.searchsorted(cuts, hits, "right") - 1):
                mine = hits[(hits >= cuts[t]) & (hits < cuts[t + 1])] - cuts[t]
                own = slice(cuts[t], cuts[t + 1])
                for m in self.scan(texts[a + t], flat[own], first[own] - starts[t], mine):
                    yield a + int(t), *m


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, start, end, coverage of each match; start and end count characters of the text.

    Null and empty texts hold nothing; a text may hold several matches of one or more templates. Repeated rows are reported each."""
    shared = spark.sparkContext.broadcast(Templates(templates or TEMPLATES, min_coverage))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(shared.value.found(words.utf8(batch.column(1))))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], ["doc_id", "license", "start", "end", "coverage"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, license string, start long, end long, coverage double")
