"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation. A document and a benchmark item that share a run of MIN_TILE words (a seed) are
tiled: matches are found by Karp-Rabin hashes of runs of MIN_TILE words, extended, and taken longest first; each word of either
side is used once, and what a taken match leaves of another is tried again while it has MIN_TILE words. The share of an item's words
that tiles cover is its coverage, whatever their order in the document.
"""

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words
from .scratch import BATCH_ROWS

MIN_TILE, MIN_COVERAGE = 5, 0.6
#: Of the benchmark, so many bytes are broadcast at a time; a larger one takes several passes over the documents.
BLOCK_BYTES = 16 << 20


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles (place in a, place in b, length) of two sequences of word hashes. Of equally long matches the first in a, then in b."""
    if min(len(a), len(b)) < least:
        return []
    ha, hb = words.windows(a, least), words.windows(b, least)
    near = np.flatnonzero(np.isin(hb, ha))
    by = np.argsort(ha, kind="stable")
    low, high = np.searchsorted(ha[by], hb[near], "left"), np.searchsorted(ha[by], hb[near], "right")
    n = high - low
    pb = np.repeat(near, n)
    pa = by[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    way = np.lexsort((pa, pb - pa))  # along the diagonals, where seeds that follow each other make one match
    pa, pb = pa[way], pb[way]
    cut = np.flatnonzero(np.r_[True, (np.diff(pa) != 1) | (np.diff(pb) != 1)]) if len(pa) else np.zeros(0, np.int64)
    length = np.diff(np.r_[cut, len(pa)]) + least - 1
    heap = [(-int(m), int(x), int(y)) for x, y, m in zip(pa[cut], pb[cut], length)]
    heapq.heapify(heap)
    free_a, free_b, out = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool), []
    while heap:
        m, x, y = heapq.heappop(heap)
        m = -m
        free = free_a[x : x + m] & free_b[y : y + m]
        if free.all():
            out.append((x, y, m))
            free_a[x : x + m] = free_b[y : y + m] = False
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


class Benchmark:
    """The items of one block and their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        texts = [(t or "").encode() for _, t in items]
        flat, cuts = words.word_hashes(texts, bare=True)
        self.ids, self.words, self.least = [i for i, _ in items], [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])], least
        seeds, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, w in enumerate(self.words):
            if len(w) >= least:
                seeds.append(np.unique(words.windows(w, least)))
                owner.append(np.full(len(seeds[-1]), k))
        seeds, owner = np.concatenate(seeds), np.concatenate(owner)
        by = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[by], owner[by]

    def found(self, texts: list[bytes], min_coverage: float):
        """text number, item id, words covered, words of the item, tiles for each item that is covered enough."""
        for a, z in words.chunks(texts):
            flat, cuts = words.word_hashes(texts[a:z], bare=True)
            if len(flat) < self.least or not len(self.seeds):
                continue
            runs = words.windows(flat, self.least)
            place = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
            hits = np.flatnonzero(self.seeds[place] == runs)
            for t in np.unique(np.searchsorted(cuts, hits, "right") - 1):
                own = flat[cuts[t] : cuts[t + 1]]
                if len(own) < self.least:
                    continue
                mine = np.unique(runs[hits[(hits >= cuts[t]) & (hits <= cuts[t + 1] - self.least)]])
                low, high = np.searchsorted(self.seeds, mine, "left"), np.searchsorted(self.seeds, mine, "right")
                for k in np.unique(np.concatenate([self.owner[x:y] for x, y in zip(low, high)] or [np.zeros(0, np.int64)])):
                    got = tiles(self.words[k], own, self.least)
                    covered = sum(m for _, _, m in got)
                    if covered >= min_coverage * len(self.words[k]):
                        yield a + int(t), self.ids[k], covered, len(self.words[k]), len(got)


def blocks(spark: SparkSession, benchmark: DataFrame, least: int):
    """The benchmark in broadcasts of about BLOCK_BYTES, by its measured size. Null texts are empty."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.select(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield spark.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id, r.text or ""))], least))


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, item_id, covered, item_words, coverage, n_tiles: one row for each row of docs and of benchmark with enough coverage.

    Texts that are null, empty or shorter than a seed contain nothing, and an item of fewer than MIN_TILE words can't be told from
    chance and is in nothing. Repeated rows are reported each."""
    found = None
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, covered int, item_words int, coverage double, n_tiles int"
    for shared in blocks(spark, benchmark, least):

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                rows = list(shared.value.found(words.utf8(batch.column(1)), min_coverage))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3)), pa.array([r[2] / r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.int32())], ["doc_id", "item_id", "covered", "item_words", "coverage", "n_tiles"])

        part = cols.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def leaks(shared, min_coverage: float):
    """A column function: does a text cover an item of a broadcast block?"""
    import pandas as pd

    @F.pandas_udf("boolean")
    def run(text: pd.Series) -> pd.Series:
        hit = set()
        for k in range(0, len(text), BATCH_ROWS):
            texts = [t.encode() if isinstance(t, str) else b"" for t in text.iloc[k : k + BATCH_ROWS]]
            hit |= {k + r[0] for r in shared.value.found(texts, min_coverage)}
        return pd.Series([i in hit for i in range(len(text))], dtype=bool)

    return run


def without_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows, with all their columns, that cover no item."""
    for shared in blocks(spark, benchmark, least):
        docs = docs.where(~leaks(shared, min_coverage)(F.col("text").cast("string")))
    return docs
