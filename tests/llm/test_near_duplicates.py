import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import components, lines, minhash, words
from quarry.llm.scratch import Scratch


def word_list(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = word_list(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(a), top(i) if i is not None else None, i is None or top(i) == i) for i, a in sets), key=str)


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(6, 120))] for _ in range(25)]
    rows, n = [], 100
    for b in base:
        for _ in range(r.randint(1, 6)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, r.choice([" ", "\n", " \t"]).join(w)))
            n += r.randint(1, 3)
    big = [r.choice(vocabulary) for _ in range(150)]  # one large group, each copy with edits of its own
    for _ in range(120):
        w = list(big)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary) + "x"
        rows.append((n, " ".join(w)))
        n += 1
    r.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("rep", "n", "key", "root"):  # clashing names
        df = df.withColumn(c, df.doc_id)
    return sorted((tuple(r) for r in minhash.near_duplicates(spark, df).collect()), key=str)


def test_minhash_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_minhash_in_blocks(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(minhash, "LIST_ROWS", 20)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    assert run(spark, rows) == brute(rows)


def test_minhash_edges(spark):
    same = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\x0btwo"), (6, "two one"), (None, same), (7, same.upper()), (8, same), (8, same), (9, "È é"), (10, "è é"), (11, "a b c d e"), (11, same), (12, "x " * 50_000), (13, "x " * 49_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_filter_keeps_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (None, "a b c d e f", "n")], "doc_id long, text string, kept string")
    got = minhash.without_near_duplicates(spark, df)
    assert got.columns == df.columns and {r.kept for r in got.collect()} == {"x", "z", "n"}
    named = df.withColumns({c: F.col("doc_id") for c in ("late_id", "_late_id", "__doc_id")})
    assert {r.kept for r in minhash.without_near_duplicates(spark, named).collect()} == {"x", "z", "n"}


def test_pipeline_stage_at_80_percent(spark):
    r = random.Random(8)
    rows, n = [], 0
    for gap in range(60):  # runs of words changed in the middle: n shingles, of which 5 to 30 differ on each side
        w = [f"v{gap}x{i}" for i in range(r.randint(60, 160))]
        x = list(w)
        at, k = r.randint(10, 40), r.randint(1, 10)
        x[at : at + k] = [f"new{gap}x{i}" for i in range(k)]
        rows += [(n, " ".join(w)), (n + 1, " ".join(x))]
        n += 2
    sets = {i: shingles(t) for i, t in rows}
    between = [i for i in range(0, n, 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85]
    assert len(between) >= 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(i for i, _, _, kept in brute(rows, 80) if kept) and not any(i + 1 in got for i in between)


def test_needed_matches_follow_the_threshold():
    assert (minhash.needed(64, 85, minhash.MISS), minhash.needed(32, 85, minhash.POSTED_MISS)) == (43, 18)
    for percent in range(1, 101):
        for size, miss in ((64, minhash.MISS), (32, minhash.POSTED_MISS)):
            k, p = minhash.needed(size, percent, miss), percent / 100
            below = lambda m: sum(math.comb(size, i) * p**i * (1 - p) ** (size - i) for i in range(m))  # noqa: B023, E731
            assert k == 1 or below(k) <= miss
            assert k == size or below(k + 1) > miss


def test_shingles_in_chunks():
    texts = [b"", b" ", "é a b".encode(), b"a b c d e f " * 9, b"A  B c\x0bd e f"]
    sets = words.shingle_sets(texts)
    assert [len(s) for s in sets] == [0, 0, 1, 6, 2]
    assert set(sets[4].tolist()) <= set(sets[3].tolist())
    alone = [words.shingle_sets([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone))


def test_forest_joins_what_links_join():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 30)
        m = np.eye(n, dtype=bool)
        for _ in range(r.randint(0, 40)):
            i, j = r.randrange(n), r.randrange(n)
            m[i, j] = m[j, i] = True
        want = np.linalg.matrix_power(m.astype(float), n) > 0
        got = np.eye(n, dtype=bool)
        links = minhash.forest(n, lambda i: m[i].copy())
        for i, j in links:
            assert m[i, j]
            got[i, j] = got[j, i] = True
        assert ((np.linalg.matrix_power(got.astype(float), n) > 0) == want).all() and len(links) < n


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)] + [(None, 1), (7, 7)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    up = {}

    def top(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def line_set(x):
    return {w for w in x.lower().translate({9: " ", 13: " ", 11: " ", 12: " "}).split(" ") if w}


def brute_lines(rows):
    every = sorted(((i if i is not None else -(2**63), p), line_set(x)) for i, t in rows for p, x in enumerate((t or "").split("\n")))
    out = []
    for i, t in rows:
        kept, n = [], 0
        for p, x in enumerate((t or "").split("\n")):
            a, me = line_set(x), (i if i is not None else -(2**63), p)
            gone = bool(a) and any(k < me and b and 5 * len(a & b) >= 4 * len(a | b) for k, b in every)
            n += gone
            if not gone:
                kept.append(x)
        out.append((i, t if not t else "\n".join(kept) if n else t, n))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    r = random.Random(7)
    pool = [" ".join(r.choice([f"w{i}" for i in range(60)] + ["the", "of"]) for _ in range(r.randint(1, 30))) for _ in range(40)]

    def variant(x):
        w = x.split()
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"v{r.randrange(400)}"
        return r.choice([" ", "  ", "\t"]).join(w)

    rows = [(i, "\n".join(variant(r.choice(pool)) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[5][1]), (None, "null first\nw1 w2"), (104, "Null FIRST\n\nw9")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in lines.line_report(spark, df).collect()), key=str)
    assert got == brute_lines(rows)
    assert lines.line_report(spark, df.limit(0)).count() == 0


def test_lines_in_blocks_by_shuffles_and_with_long_lines(spark, monkeypatch):
    r = random.Random(11)
    common = [f"c{i}" for i in range(30)]

    def line(n):
        return [r.choice(common) for _ in range(n // 4)] + [f"w{r.randrange(n * 3)}" for _ in range(n)]

    rows, pool = [], [line(r.choice([3, 8, 20, 60, 100, 130, 200, 400])) for _ in range(50)]
    for i in range(70):
        text = []
        for _ in range(r.randint(1, 4)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 1, len(w) // 12, len(w) // 9, len(w) // 8])):
                w[r.randrange(len(w))] = f"v{r.randrange(900)}"
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    rows += [(100 + i, "one line that many documents share") for i in range(40)] + [(200 + i, f"one line that many documents share x{i}") for i in range(40)]
    rows += [(300, " ".join(f"long{i}" for i in range(20_000))), (301, " ".join(f"long{i}" for i in range(19_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("BLOCK_ROWS", 2), ("FIRST_ROWS", 8), ("BROADCAST_ROWS", 3), ("FIRST_BEFORE", 1), ("LIKELIEST", 1)):
        monkeypatch.setattr(lines, name, value)
    blocks = []

    def counted(*args, long_lists=lines.long_lists):
        found = long_lists(*args)
        blocks.append(found.agg(F.count("*"), F.max("ones"), F.max("twos")).first())
        return found

    monkeypatch.setattr(lines, "long_lists", counted)
    got = sorted((tuple(x) for x in lines.line_report(spark, df).collect()), key=str)
    assert got == brute_lines(rows)
    assert blocks and min(blocks[0]) > 1 and blocks[0][0] > 3  # both sides in blocks, and more lists than are broadcast


def test_lines_whatever_the_columns_are_named(spark):
    df = spark.createDataFrame([(1, "a b c d\nx"), (2, "A b c d"), (3, None)], "doc_id long, text string")
    for c in ("doc", "text_key", "gone", "_gone", "n_removed", "__n", "__doc", "tok", "a.b"):
        df = df.withColumn(c, F.col("doc_id") + 5)
    got = lines.without_later_lines(spark, df)
    assert got.columns == df.columns
    assert sorted(tuple(x) for x in got.collect()) == [(1, "a b c d\nx", *[6] * 9), (2, "", *[7] * 9), (3, None, *[8] * 9)]


def test_lines_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b c d\nx", 9, "l"), (2, "A b c d", 7, "m"), (2, "A b c d", 7, "m")], "doc_id long, text string, n_chars long, tok string")
    got = lines.without_later_lines(spark, df)
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d\nx", 9, "l"), (2, "", 0, "m"), (2, "", 0, "m")]
    kept = lines.without_later_lines(spark, df.unionByName(spark.createDataFrame([(3, None, 0, "n"), (4, "", 0, "e"), (5, " \n", 2, "b")], df.schema)), keep_emptied=False)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_chunks(n):
    texts = [b"x" * 10] * n
    assert [i for a, b in words.chunks(texts, 25) for i in range(a, b)] == list(range(n))


def test_batches_of_texts_are_small(spark):
    """A table with Python in its plan is written in small Arrow batches, and the session's own number comes back."""
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

    rows = spark.range(3000).coalesce(1).mapInArrow(sizes, "id long")
    for own, most in (("10000", 1000), ("0", 1000), ("300", 300)):
        spark.conf.set(key, own)
        assert Scratch(spark, "batches").save(rows, "rows").agg(F.max("id")).first()[0] == most
        assert spark.conf.get(key) == own
    spark.conf.set(key, before)


def test_a_worker_takes_few_texts_at_a_time(spark, monkeypatch):
    """Whatever the batch, signatures come for BATCH_ROWS texts at a time."""
    import pyarrow as pa

    class Documents:
        select = lambda self, *cols: self
        mapInArrow = lambda self, make, schema: make

    taken, chunks = [], words.chunks
    monkeypatch.setattr(words, "chunks", lambda texts, *more: taken.append(len(texts)) or chunks(texts, *more))
    n = 2 * minhash.BATCH_ROWS + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"text {i}" for i in range(n)])], ["doc_id", "text"])
    out = list(minhash.signatures(Documents())([batch]))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
    assert taken == [minhash.BATCH_ROWS, minhash.BATCH_ROWS, 5]
