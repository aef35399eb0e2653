"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of its NEAREST nearest pivots and posted in the inverted files of those pivots with its
place in that order. A query walks the files of its own nearest pivots and ranks what it meets by the footrule distance of the two
orders, where a pivot outside an order counts as standing behind it; with that, the distance is a constant less twice the sum of
NEAREST - max(place, place) over the pivots that both have. The first SHARE of a block's vectors by footrule are reranked by their
exact distance.

The index is dealt in blocks of about BLOCK vectors by a hash of vec_id, so many equal vectors or a large cluster are spread, and
each block of queries goes over each block of the index; a block gives its nearest k a query. Pivots are distinct vectors from a
bounded sample (the PIVOT_SAMPLE rows with the smallest hash of vec_id); every vector is indexed.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PIVOTS, PIVOT_SAMPLE, NEAREST = 512, 4096, 64
SHARE, LEAST = 0.15, 1000
BLOCK, QUERY_BLOCK = 50_000, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part: an id, and a vector without null or non-finite parts that isn't zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors of the sample, of the length that is most common there."""
    sample = [tuple(r.v) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return np.zeros((0, 0))
    length = pd.Series([len(x) for x in sample]).mode().iloc[0]
    return np.array(list(dict.fromkeys(x for x in sample if len(x) == length))[:pivots])


def orders(v: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, nearest first, ties to the smaller number."""
    far = (pivots**2).sum(axis=1)[None] - 2 * v @ pivots.T
    part = np.argpartition(far, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(len(pivots)), (len(v), 1))
    return np.take_along_axis(part, np.lexsort((part, np.take_along_axis(far, part, axis=1)), axis=1), axis=1)


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, nearest: int):
        self.ids, self.v, self.pivots, self.nearest = ids, v, pivots, nearest
        order = orders(v, pivots, nearest)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.who, self.place = by // nearest, (by % nearest).astype(np.int32)
        self.cuts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def candidates(self, q: np.ndarray, count: int) -> np.ndarray:
        """The vectors with the smallest footrule distance; at equal distance those that come first (ids are sorted)."""
        sums = np.zeros(len(self.ids), np.int32)
        for place, p in enumerate(orders(q[None], self.pivots, self.nearest)[0]):
            a, b = self.cuts[p], self.cuts[p + 1]
            sums[self.who[a:b]] += self.nearest - np.maximum(self.place[a:b], place)
        if count >= len(sums):
            return np.arange(len(sums))
        least = np.partition(sums, len(sums) - count)[len(sums) - count]
        over, ties = np.flatnonzero(sums > least), np.flatnonzero(sums == least)
        return np.r_[over, ties[: count - len(over)]]

    def nearest_to(self, query_id: int, q: np.ndarray, k: int, share: float):
        """Up to k ids and exact distances, by distance and id. The query's own row is no candidate."""
        found = self.candidates(q, max(LEAST, k + 1, int(share * len(self.ids))))
        found = found[self.ids[found] != query_id]
        d = np.sqrt(((self.v[found] - q) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[found], d))[:k]
        return self.ids[found][best], d[best]


def distinct_rows(frame: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and their vectors; of rows with one id, that with the smallest vector."""
    frame = frame[frame.v.map(len) == length]
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros((0, length))
    ids, v = frame.vec_id.to_numpy(np.int64), np.stack(frame.v.to_numpy()).astype(np.float64)
    by = np.lexsort((*v.T[::-1], ids))
    ids, v = ids[by], v[by]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], v[first]


def search(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, pivots: int = PIVOTS, nearest: int = NEAREST, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest found of each row whose vec_id is divisible by every.

    vectors: vec_id, embedding, ... Rows that usable() leaves out, and vectors of another length than the pivots, take no part.
    Rows with one vec_id are one vector, the smallest. Fewer than k candidates give fewer rows, one vector or none give no row.
    score is the Euclidean distance in double precision; ties go to the smaller vec_id."""
    rows = usable(vectors)
    chosen = choose_pivots(rows, pivots)
    length, nearest = chosen.shape[1], min(nearest, len(chosen))
    shared = spark.sparkContext.broadcast(chosen)  # PIVOTS vectors at most
    blocks = max(1, -(-vectors.count() // BLOCK))
    asked = rows.where(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def deal(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other))

    def one_block(index: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        ids, v = distinct_rows(index, length)
        query_ids, q = distinct_rows(query, length)
        out = []
        if len(ids):
            block = Block(ids, v, shared.value, nearest)
            for i, x in zip(query_ids, q):
                found, d = block.nearest_to(i, x, k, share)
                out.append(pd.DataFrame({"query_id": i, "vec_id": found, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    index = deal(rows, "block", blocks, "query_block", query_blocks).groupBy("query_block", "block")
    query = deal(asked, "query_block", query_blocks, "block", blocks).groupBy("query_block", "block")
    found = index.cogroup(query).applyInPandas(one_block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
