import hashlib
import random

from pyspark.sql import functions as F

from quarry.operators import hits, sampling, verdicts
from quarry.plans import readonly


def in_turn(posts, n):
    """Queries take turns; each gives its best post that isn't taken."""
    queues = {}
    for p in posts:
        for q in p["matched_by"] or [""]:
            queues.setdefault(q, []).append(p)
    order = sorted(queues, key=lambda q: (len(queues[q]), q))
    taken = []
    while len(taken) < n:
        before = len(taken)
        for q in order:
            rest = [p for p in queues[q] if p["id"] not in taken]
            if rest and len(taken) < n:
                taken.append(min(rest, key=lambda p: (not p["text_match"], -len(p["matched_by"]), -p["score"], p["id"]))["id"])
        if len(taken) == before:
            break
    return taken


def test_round_robin(spark):
    r = random.Random(1)
    posts = [dict(id=f"p{i:03}", matched_by=r.sample("abcde", r.randint(0, 3)), text_match=r.random() < 0.5, score=r.randint(0, 5)) for i in range(80)]
    df = spark.createDataFrame(posts, "id string, matched_by array<string>, text_match boolean, score long")
    got = {n: [x.id for x in sampling.round_robin(df, n).orderBy("place").collect()] for n in (1, 7, 30, 200)}
    for n, ids in got.items():
        assert ids == in_turn(posts, n) and got[200][:n] == ids


def test_stratified(spark):
    pool = spark.createDataFrame([(f"p{i}", i < 3) for i in range(20)], "id string, text_match boolean")
    key = lambda i: hashlib.sha1(i.encode()).hexdigest()
    own, via = sorted((f"p{i}" for i in range(3)), key=key), sorted((f"p{i}" for i in range(3, 20)), key=key)
    got = {r.id: r.label for r in sampling.stratified(pool, 10).collect()}
    assert {i for i, x in got.items() if x == "hit in the post"} == set(own) and {i for i, x in got.items() if x == "found only through comments"} == set(via[:5])
    assert sorted(x for x in got.values()).count("other") == 2 and len(got) == 10


def test_stratified_reads_the_pool_once(spark):
    """The strata, what makes them up and whoever uses the sample don't search again."""
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            passed.add(len(x))
            yield x

    pool = spark.createDataFrame([(f"p{i}", i < 3) for i in range(20)], "id string, text_match boolean").mapInPandas(counted, "id string, text_match boolean")
    got = sampling.stratified(pool, 10, spark.createDataFrame([("p4",), ("p9",)], "id string"))
    assert got.count() == 10 == len({r.id for r in got.collect()}) and passed.value == 20


def test_budget(spark):
    r = random.Random(4)
    sizes = [(i, r.randint(0, 900), r.randint(1, 60), r.randint(1, 9)) for i in range(1500)]
    for entries, head, limit in ((sizes[:10], 10, 350), (sizes, 100, 30_000), (sizes, 100, 10), (sizes, 0, 10**9)):
        df = spark.createDataFrame(entries, "i int, chars int, line_chars int, id_chars int").repartition(3)
        shown = {x.rank: x.shown for x in sampling.budget(df, [F.desc("i")], head, limit).collect()}
        used, rest = head, sorted(entries, reverse=True)
        n = 0
        for n, (_, chars, _, _) in enumerate(rest):
            listed = sum(x[2] for x in rest[n + 1 : n + 101]) + sum(x[3] for x in rest[n + 101 : n + 1101])
            if n and used + (chars + listed) // 4 > limit:
                break
            used += chars // 4
        else:
            n += 1
        assert shown == {k + 1: k < n for k in range(len(entries))}
    assert sampling.budget(df.limit(0), [F.col("i")], 1, 1).count() == 0


def test_verdict_boundaries(spark):
    qs = verdicts.Questions(q=("a", "b"), must="m", nots=("n",))
    cases = [([0.35, 0.5, 0.1, 0.69], None, True), ([0.34, 0.9, 0.9, 0.0], "must", False), ([0.1, 0.9, 0.9, 0.7], "not", False), ([1.0, 0.4999, 0.2, 0.0], None, False), (None, None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(cases)], "i int, p array<double>")
    got = [r.v for r in df.select("i", verdicts.post_verdict(F.col("p"), qs).alias("v")).orderBy("i").collect()]
    assert [(v.excluded, v.keep) if v else (None, None) for v in got] == [(e, k) for _, e, k in cases] and got[-1] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.999, 1.0, None)], "s double")
    assert [r.n for r in verdicts.histogram(df, "s").orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]


def test_parts_stop_at_the_first_that_is_enough(spark):
    rows = [("a", 0, [0.2, 0.4]), ("a", 1, [0.6, 0.1]), ("a", 2, None), ("b", 0, [0.1, 0.1]), ("b", 1, None), ("c", 0, [0.1, 0.3]), ("c", 1, [0.2, 0.2])]
    df = spark.createDataFrame(rows, "t string, part int, probs array<double>")
    assert {r.t: r.q for r in verdicts.combine_parts(df, ["t"], 0.5).collect()} == {"a": [0.6, 0.4], "b": None, "c": [0.2, 0.3]}


def test_flair_exclusions(spark):
    posts = spark.createDataFrame([("1", "A", ":x: News"), ("2", "b", "NEWS"), ("3", "a", "Pics"), ("4", "a", None)], "id string, sub string, link_flair string")
    e = spark.createDataFrame([("news", "a")], "pattern string, sub string")
    assert {r.id for r in hits.without_excluded(posts, e).collect()} == {"2", "3", "4"}
    assert hits.exclude_flair(e, "NEWS", "A").count() == 1 and hits.include_flair(e, "NEWS", "A").count() == 0 and hits.include_flair(e, "news").count() == 1


def test_read_only(spark):
    spark.range(3).createOrReplaceTempView("posts")
    assert readonly.select(spark, "WITH a AS (SELECT id FROM posts) SELECT id FROM a -- x").count() == 3
    for bad in ("DROP VIEW posts", "INSERT INTO posts VALUES (1)", "SELECT 1; SELECT 2", "SET x=1"):
        try:
            readonly.select(spark, bad)
        except readonly.NotReadOnly:
            continue
        raise AssertionError(bad)
