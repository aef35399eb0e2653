"""Near-duplicate documents by a join over the coordinates of MinHash signatures, confirmed on full shingle sets.

1. A document is the set of its distinct 5-word shingles; equal sets fall into one class, which takes part once.
2. A class gets COORDS minima. The first POSTED of them are posted, each under its coordinate and value. Two sets with a
   Jaccard similarity of just the threshold agree in fewer than posted_match of those with a probability of at most
   POSTED_MISS, so pairs that agree in posted_match are wanted (both counts follow from the threshold, see needed()). By the
   prefix principle such a pair meets in the first POSTED - posted_match + 1 postings of both in any one order of all
   postings. The order here is by list length: lists of one document come first and use up the prefix without making a
   posting, and the long lists (of common passages) are skipped unless nearly all of a document is common.
3. In a list the collisions of all COORDS coordinates are counted (on their low bytes); pairs with as many as step 2 asks of
   all COORDS (with MISS) are linked.
   Only a forest of such links leaves a list: a document that is linked already is compared with no more than each document
   outside the largest tree. Lists of over LIST_ROWS are dealt in pairs of blocks.
4. The components of these links hold every pair that could pass. For each the full sets are built from the texts, and links
   with 100 * intersection >= percent * union are found exactly, again as a forest, in pairs of blocks where a component has
   over BLOCK_SHINGLES shingles. The components of these links are the result.

What can be lost is a pair that MinHash misses in 2 or 3 (at most POSTED_MISS + MISS for a pair exactly at the threshold, and
less for closer ones or where other documents link the two). Nothing is capped.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words
from .components import components
from .scratch import BATCH_ROWS, Scratch, unused

COORDS, POSTED = 64, 32
POSTED_MISS, MISS = 2e-5, 1e-4
LIST_ROWS, BLOCK_SHINGLES = 4000, 2_000_000
_MULTIPLY = words.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit digest of the set), keys (POSTED posting keys), sig (COORDS bytes).
    Null or empty texts and texts without words: no shingles, null keys and sig."""

    def make(batches):
        import pyarrow as pa

        coord = np.arange(POSTED, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for batch in (whole.slice(k, BATCH_ROWS) for whole in batches for k in range(0, whole.num_rows, BATCH_ROWS)):
            ids, texts = batch.column(0), words.utf8(batch.column(1))
            for a, b in words.chunks(texts):
                sets = words.shingle_sets(texts[a:b])
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.r_[0, np.cumsum(n[full])[:-1]]
                    low = np.empty((len(full), COORDS), dtype=np.uint64)
                    for c in range(COORDS):
                        low[:, c] = np.minimum.reduceat(flat * _MULTIPLY[c], starts)
                    low = words.mix(low)
                    digest = [np.add.reduceat(words.mix(flat ^ np.uint64(k)), starts).astype(np.int64) for k in (0x51ED27, 0xB5297A4D)]
                    keys = words.mix(low[:, :POSTED] + coord).astype(np.int64)
                    sig = (low & np.uint64(255)).astype(np.uint8)
                place = np.full(b - a, -1)
                place[full] = np.arange(len(full))
                has = [int(p) for p in place]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(n),
                    *(pa.array([None if p < 0 else int(d[p]) for p in has], pa.int64()) for d in (digest if len(full) else ([], []))),
                    pa.array([None if p < 0 else keys[p] for p in has], pa.list_(pa.int64())),
                    pa.array([None if p < 0 else sig[p].tobytes() for p in has], pa.binary()),
                ], ["doc_id", "n_shingles", "set_a", "set_b", "keys", "sig"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(make, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sig binary")


def forest(n: int, linked) -> list[tuple[int, int]]:
    """Links that join what all links among n nodes would join. linked(i): a mask of the nodes that i is linked with. A node is
    asked unless it is in the largest tree by then: any link between two trees has an end outside the largest one, which was
    asked or has since joined it."""
    tree, size, out = np.arange(n), np.ones(n, dtype=np.int64), []
    asked, largest = np.zeros(n, dtype=bool), 0
    while True:
        todo = np.flatnonzero(~asked & ((tree != largest) | (size[largest] == 1)))
        if not len(todo):
            return out
        for i in todo:
            if tree[i] == largest and size[largest] > 1:
                continue
            asked[i] = True
            near = linked(i)
            mine = tree[i]
            for t in np.unique(tree[near]):
                if t != mine:
                    j = int(np.flatnonzero(near & (tree == t))[0])
                    out.append((i, j))
                    tree[tree == t] = mine
                    size[mine] += size[t]
            if size[mine] > size[largest] or size[largest] == 1:
                largest = mine


def grouped(batches, key: str):
    """The groups of equal keys in sorted Arrow batches, as tables."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(ks[1:] != ks[:-1]) + 1, len(ks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != ks[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def link_batches(links: list):
    import pyarrow as pa

    a, b = (np.array([x[i] for x in links], dtype=np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def needed(n: int, percent: int, miss: float) -> int:
    """The largest number, 1 at least, of n coordinates in which two sets with so many percent in common agree but for a
    probability of at most miss."""
    p, below = percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return max(k, 1)
    return n


def list_links(percent: int):
    """Sorted postings (key, rep, sig) to links between signatures that agree as sets of at least percent do."""
    match = needed(COORDS, percent, MISS)

    def find(batches):
        links = []
        for group in grouped(batches, "key"):
            if group.num_rows < 2:
                continue
            reps = group.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, COORDS)
            if len(reps) == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= match:
                    links.append((reps[0], reps[1]))
            else:
                links += [(reps[i], reps[j]) for i, j in forest(len(reps), lambda i: np.count_nonzero(sig == sig[i], axis=1) >= match)]  # noqa: B023
            if len(links) > 50_000:
                yield link_batches(links)
                links = []
        yield link_batches(links)

    return find


def exact_links(percent: int):
    """Sorted rows (key, rep, text) to links between sets with 100 * intersection >= percent * union."""

    def find(batches):
        links = []
        for group in grouped(batches, "key"):
            reps, texts = group.column("rep").to_numpy(), words.utf8(group.column("text").combine_chunks())
            sets = [s for a, b in words.chunks(texts) for s in words.shingle_sets(texts[a:b])]
            n = np.array([len(s) for s in sets])
            if len(reps) < 2 or not n.all():
                reps, sets, n = reps[n > 0], [s for s in sets if len(s)], n[n > 0]
                if len(reps) < 2:
                    continue
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            cuts, mark = np.r_[0, np.cumsum(n)], np.zeros(len(names), dtype=bool)

            def linked(i):
                mine = flat[cuts[i] : cuts[i + 1]]  # noqa: B023
                mark[mine] = True  # noqa: B023
                both = np.add.reduceat(mark[flat], cuts[:-1], dtype=np.int64)  # noqa: B023
                mark[mine] = False  # noqa: B023
                return 100 * both >= percent * (n + n[i] - both)  # noqa: B023

            links += [(reps[i], reps[j]) for i, j in forest(len(reps), linked)]
            if len(links) > 50_000:
                yield link_batches(links)
                links = []
        yield link_batches(links)

    return find


def in_blocks(df: DataFrame, blocks: str, key: str, *cols: str) -> DataFrame:
    """Deals each row of a group with so many blocks to the pairs of blocks that hold its own; one pair for one block."""
    own = F.pmod(F.xxhash64("rep"), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias("other")
    dealt = df.select(*cols, key, own.alias("own"), other)
    return dealt.select(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("key"), *cols)


def by_key(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "key").sortWithinPartitions("key")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_shingles, component_id, kept; one row a row.

    component_id is the smallest doc_id reachable over links of at least percent, kept says whether it is the row's own. Rows
    with one doc_id are one node; all its texts link. Without words: no shingles, linked with nothing. A null doc_id can't name
    a component: such a row links nothing, its component_id is null and it is kept. An empty table gives an empty one."""
    s = Scratch(spark, "minhash")
    sig = s.save(signatures(docs), "sig")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    reps = s.save(reps, "reps")
    # A doc_id with several texts is one node.
    twin = real.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).where("x <> y").select("doc_id")
    twin = real.join(twin, "doc_id", "left_semi").join(reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    postings = reps.select("rep", F.explode("keys").alias("key"))
    lists = s.save(postings.groupBy("key").agg(F.count(F.lit(1)).alias("len")).where("len > 1"), "lists")
    slots = postings.join(lists, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("len", "key"))).alias("slots"))
    room = F.greatest(F.lit(1 - needed(POSTED, percent, POSTED_MISS)) + F.size("slots"), F.lit(0))
    prefix = slots.select("rep", F.explode(F.slice("slots", 1, room)).alias("x")).select("rep", F.col("x.key").alias("list"), F.ceil(F.col("x.len") / LIST_ROWS).cast("long").alias("blocks"))
    dealt = in_blocks(prefix.join(reps.select("rep", "sig"), "rep"), "blocks", "list", "rep", "sig")
    maybe = s.save(by_key(dealt).mapInArrow(list_links(percent), "a long, b long"), "maybe")
    group = components(maybe, s, "maybe")

    group = group.join(reps.groupBy("rep").agg(F.max("n").alias("n")), F.col("node") == F.col("rep")).select("root", "rep", "n")
    weight = s.save(group.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks")), "weight")
    member = s.save(group.join(weight, "root").select("root", "rep", "blocks"), "member")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(member, "rep")
    dealt = in_blocks(texts, "blocks", "root", "rep", "text")
    links = by_key(dealt).mapInArrow(exact_links(percent), "a long, b long").unionByName(twin)
    roots = components(links, s, "links")
    s.drop("lists", "maybe", "maybe-roots", "weight", "member")

    known = reps.select("set_a", "set_b", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("component_id"))
    known = s.save(known, "known")
    s.drop("reps")
    found = sig.drop("keys", "sig").join(known, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return found.select("*", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows, with all their columns, of the documents that near_duplicates() keeps: one doc_id of each component, and all rows
    without doc_id."""
    (late,) = unused(docs, "late_id")
    found = Scratch(spark, "near").save(near_duplicates(spark, docs, percent).where("not kept").select(F.col("doc_id").alias(late)).distinct(), "late")
    return docs.join(found, F.col("doc_id").cast("long") == F.col(late), "left_anti")
