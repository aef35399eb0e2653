"""Fingerprints of documents by prefix polynomial hashes.

A text c0 c1 ... has the prefix hashes P[m] = sum of (c[j] + 1) * B^j for j < m, modulo each of two primes. With them any span has a hash
without being read again, (P[j] - P[i]) / B^i, so that two spans of any two texts are compared in one step, and the longest common
extension from two places is found by binary search over its length.

A fingerprint is the number of code points, the hash of the whole text and a sketch of all spans of SPAN code points (the whole text, if it
is shorter): the spans' hashes fall into BINS bins, and each bin shows the least of its hashes. The likeness of two fingerprints is the
share of equal bins among those that one of them fills, an estimate of the share of spans that the texts have in common (Jaccard) with a
standard error of at most 0.5 / sqrt(BINS). Equal texts have equal fingerprints and likeness 1; an empty text is like an empty text only.

The query puts documents in order (descending doc_id, null last; repeated ids by the hash of their text) and compares each with the next.
The order is cut into blocks by bounds from a sample of keys of bounded size; the first document of a block goes to the block before it
too, so each task reads one block as a stream, with two texts and their prefix hashes (8 bytes a character) in memory. The whole text
is shuffled once.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN, BINS = 12, 64
#: Primes below 2^31, so that products fit into 64 bits, and the base of the polynomials.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003
#: Code points hashed at a time, and keys sampled for each block.
CHUNK, SAMPLE_PER_BLOCK = 1 << 20, 20
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, common_suffix long"

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) by doubling; kept for the next text, up to CHUNK of them."""
    have = _powers.get((base, prime), np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), prime))
        have = np.r_[have, have * step % np.uint64(prime)]
    if n <= CHUNK + SPAN:
        _powers[base, prime] = have
    return have[:n]


class Prefixes:
    """The prefix hashes of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.sums = []
        for prime in PRIMES:
            p, out, carry, scale = np.uint64(prime), np.zeros(self.n + 1, np.uint32), np.uint64(0), 1
            for a in range(0, self.n, CHUNK):
                part = points[a : a + CHUNK].astype(np.uint64) + np.uint64(1)
                terms = part * powers(BASE, prime, len(part)) % p
                if scale != 1:
                    terms = terms * np.uint64(scale) % p
                sums = (np.cumsum(terms, dtype=np.uint64) + carry) % p
                out[a + 1 : a + 1 + len(part)] = sums
                carry, scale = sums[-1], scale * pow(BASE, len(part), prime) % prime
            self.sums.append(out)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of the code points from i up to j: equal for equal spans of any texts."""
        return tuple((int(s[j]) - int(s[i])) * pow(BASE, -i, p) % p for s, p in zip(self.sums, PRIMES))

    def same(self, i: int, other: "Prefixes", j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common(self, i: int, other: "Prefixes", j: int) -> int:
        """The longest common extension to the right of i here and of j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.same(i, other, j, half) else (low, half - 1)
        return low

    def common_before(self, i: int, other: "Prefixes", j: int) -> int:
        """The same to the left of i and j."""
        low, high = 0, min(i, j)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.same(i - half, other, j - half, half) else (low, half - 1)
        return low

    def spans(self, a: int, b: int) -> np.ndarray:
        """The hashes of the runs of SPAN code points between a and b as 62-bit numbers; of all of them as one run, if they are fewer."""
        length = min(SPAN, b - a)
        if not length:
            return np.zeros(0, np.uint64)
        out = np.empty(b - a - length + 1, np.uint64)
        for at in range(0, len(out), CHUNK):
            k = min(CHUNK, len(out) - at)
            both = []
            for s, prime in zip(self.sums, PRIMES):
                p, i = np.uint64(prime), a + at
                ends, starts = s[i + length : i + length + k].astype(np.uint64), s[i : i + k].astype(np.uint64)
                back = powers(pow(BASE, -1, prime), prime, k)
                both.append((ends + p - starts) % p * back % p * np.uint64(pow(BASE, -i, prime)) % p)
            out[at : at + k] = both[0] << np.uint64(31) | both[1]
        return out


def mix(h: np.ndarray) -> np.ndarray:
    from .words import mix as finish

    return finish(h + np.uint64(0x9E3779B97F4A7C15))


class Sketch:
    """The least hash of each bin, over spans that are given in parts."""

    def __init__(self):
        self.least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)

    def add(self, spans: np.ndarray) -> "Sketch":
        for a in range(0, len(spans), CHUNK):
            h = np.sort(mix(spans[a : a + CHUNK]))
            first = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
            there = first < len(h)
            found = h[first[there]]
            mine = found >> np.uint64(64 - BINS.bit_length() + 1) == np.flatnonzero(there).astype(np.uint64)
            at = np.flatnonzero(there)[mine]
            self.least[at] = np.minimum(self.least[at], found[mine])
        return self

    def merged(self, other: "Sketch") -> "Sketch":
        out = Sketch()
        out.least = np.minimum(self.least, other.least)
        return out

    def show(self, n: int, whole: tuple[int, ...]) -> str:
        """16 bits of each bin (the last ones; 0000 if it is empty), behind the length and the hash of the whole text."""
        bits = np.where(self.least == np.iinfo(np.uint64).max, 0, self.least % np.uint64(65535) + np.uint64(1))
        return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{b:04x}" for b in bits.tolist())


def likeness(a: str, b: str) -> float:
    """The likeness of two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u2") for f in (a, b))
    filled = (x > 0) | (y > 0)
    return float((x == y)[filled].mean()) if filled.any() else 0.0


class Printed:
    """A text with its prefix hashes and its fingerprint."""

    def __init__(self, text: str):
        self.text, self.prefixes = text, Prefixes(text)
        n = self.prefixes.n
        self.fingerprint = Sketch().add(self.prefixes.spans(0, n)).show(n, self.prefixes.span(0, n))

    def spliced(self, other: "Printed") -> tuple[str, str]:
        """This text with its last half replaced by as many code points (or all) of the start of another, and its fingerprint: from the
        prefix hashes of both and, at the seam, of a few code points."""
        n = self.prefixes.n
        keep, take = n - n // 2, min(n // 2, other.prefixes.n)
        text = self.text[:keep] + other.text[:take]
        if keep < SPAN or take < SPAN:
            return text, Printed(text).fingerprint
        seam = Prefixes(self.text[keep - SPAN + 1 : keep] + other.text[: SPAN - 1])
        sketch = Sketch().add(self.prefixes.spans(0, keep)).add(seam.spans(0, seam.n)).add(other.prefixes.spans(0, take))
        whole = tuple((x + y * pow(BASE, keep, p)) % p for x, y, p in zip(self.prefixes.span(0, keep), other.prefixes.span(0, take), PRIMES))
        return text, sketch.show(keep + take, whole)


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text; null is null."""

    @F.pandas_udf("string")
    def show(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Printed(t).fingerprint for t in texts], dtype=object)

    return show(text)


# ── each document and the next ───────────────────────────────────────────────
def key(doc_id: pd.Series, digest: pd.Series) -> np.ndarray:
    """Keys of 17 bytes that sort as the documents do: descending doc_id, null last, then the hash of the text."""
    null = doc_id.isna().to_numpy()
    out = np.zeros((len(null), 17), np.uint8)
    out[:, 0] = null
    ids = np.where(null, 0, doc_id.fillna(0).to_numpy().astype(np.int64))
    out[:, 1:9] = (~ids.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = (digest.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("V17").ravel()


def as_text(keys: np.ndarray) -> np.ndarray:
    return np.array([k.tobytes().hex() for k in keys], dtype=object) if len(keys) else np.zeros(0, object)


def print_block(batches):
    """Rows in order of block, extra, key: each with the row behind it; an extra row is only the one behind the last."""
    from itertools import islice

    before = None

    def rows():
        nonlocal before
        for batch in batches:
            for doc_id, text, extra, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if before is not None and before[2] != block:
                    before = None
                if extra and before is None:
                    continue
                here = doc_id, Printed(text), block
                if before is not None:
                    yield compared(*before[:2], here[1])
                before = None if extra else here

    stream = rows()
    while some := list(islice(stream, 1000)):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=[x.split()[0] for x in FIELDS.split(", ")])


def compared(doc_id, own: Printed, following: Printed) -> tuple:
    text, edited = own.spliced(following)
    a, b = own.prefixes, following.prefixes
    prefix, suffix = a.common(0, b, 0), a.common_before(a.n, b, b.n)
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, a.n, digest, own.fingerprint, edited, likeness(own.fingerprint, edited), likeness(own.fingerprint, following.fingerprint), prefix, suffix


def compare_with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix and common_suffix (code points
    shared with the next document's start and end) of every document; edited: Printed.spliced() with the next document.

    A null text is empty. A table with one row has itself as the next. Rows that share a doc_id are documents of their own, in the order of
    their texts' hashes; rows that are wholly the same give the same result as often as they stand there. An empty table gives no rows."""
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))

    @F.pandas_udf("string")
    def sort_key(doc_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(as_text(key(doc_id, digest)), index=doc_id.index, dtype=object)

    # Bounds of blocks, from a sample of bounded size; any bounds give the same result.
    n = docs.select("doc_id").count()
    sample = sorted(r.k for r in docs.sample(min(1.0, SAMPLE_PER_BLOCK * blocks / max(n, 1)), seed=1).select(sort_key(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("k")).collect())
    bounds = sorted({sample[len(sample) * i // blocks] for i in range(1, blocks)}) if sample else []
    return between(rows, sort_key, bounds, blocks)


def between(rows: DataFrame, sort_key, bounds: list[str], blocks: int) -> DataFrame:
    edges = rows.sparkSession.sparkContext.broadcast(np.array(bounds, dtype="S34"))

    @F.pandas_udf("int")
    def block_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, keys.to_numpy().astype("S34"), side="right").astype(np.int32), index=keys.index)

    # The first key of each block, one row a block. The block before gets that document too; the last one gets the very first.
    keyed = rows.withColumn("key", sort_key("doc_id", "digest")).withColumn("block", block_of("key"))
    order = Window.orderBy("block")
    heads = keyed.groupBy("block").agg(F.min("key").alias("key"))
    heads = heads.select("key", F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    place = lambda extra, block: F.struct(F.lit(extra).alias("extra"), F.col(block).alias("block"))
    places = F.when(F.col("to").isNull(), F.array(place(False, "block"))).otherwise(F.array(place(False, "block"), place(True, "to")))
    dealt = keyed.join(F.broadcast(heads), "key", "left").select("doc_id", "text", "digest", F.explode(places).alias("at")).select("doc_id", "text", "digest", "at.*")
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "extra", F.desc_nulls_last("doc_id"), "digest")
    return dealt.select("doc_id", "text", "extra", "block").mapInArrow(print_block, FIELDS)
