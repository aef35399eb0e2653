import random

from quarry.operators import spans

K = ["sub", "kind"]


def union(xs, apart=0):
    out = []
    for s, e in sorted(xs):
        if out and s <= out[-1][1] + apart:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def uncovered(xs, a, b):
    return [(s, e) for s, e in runs(sorted(set(range(a, b)) - {t for s, e in xs for t in range(s, e)}))]


def runs(seconds):
    out = []
    for t in seconds:
        if out and out[-1][1] == t:
            out[-1][1] = t + 1
        else:
            out.append([t, t + 1])
    return [tuple(x) for x in out]


def random_spans(seed):
    r = random.Random(seed)
    return [(str(i % 3), "posts", s, s + r.randint(0, 12)) for i, s in ((i, r.randint(0, 100)) for i in range(30))]


def test_islands_and_gaps(spark):
    for seed in range(3):
        rows = random_spans(seed)
        df = spark.createDataFrame(rows, "sub string, kind string, start long, end long")
        windows = spark.createDataFrame([(k, "posts", 10, 90) for k in "0123"], "sub string, kind string, after long, before long")
        got = spans.islands(df, K).collect()
        gone = spans.gaps(df, windows, K).collect()
        for k in "0123":
            mine = [(s, e) for x, _, s, e in rows if x == k]
            assert sorted((r.start, r.end) for r in got if r["sub"] == k) == union(mine)
            assert sorted((r.start, r.end) for r in gone if r["sub"] == k) == uncovered(mine, 10, 90)


def test_to_fetch_trusts_and_joins(spark):
    day = 86400
    chunks = spark.createDataFrame(
        [("a", "posts", 0, 10 * day, 20 * day), ("a", "posts", 10 * day, 12 * day, 12 * day), ("a", "posts", 14 * day, 15 * day, None)],
        "sub string, kind string, start long, end long, finished_at long")
    windows = spark.createDataFrame([("a", "posts", 0, 15 * day + 100)], "sub string, kind string, after long, before long")
    got = lambda **kw: sorted((r.start // day, r.end / day) for r in spans.to_fetch(chunks, windows, K, **kw).collect())
    assert got() == [(10, 14.0), (15, 15 + 100 / day)]
    assert got(resume=False) == [(10, 15 + 100 / day)]
    near = spark.createDataFrame([("a", "posts", 1000, 1000 + day - 1, 10**9)], "sub string, kind string, start long, end long, finished_at long")
    window = spark.createDataFrame([("a", "posts", 0, 5 * day)], "sub string, kind string, after long, before long")
    assert [(r.start, r.end) for r in spans.to_fetch(near, window, K).collect()] == [(0, 5 * day)]
    far = near.withColumn("end", near.end + 1)
    assert sorted((r.start, r.end) for r in spans.to_fetch(far, window, K).collect()) == [(0, 1000), (1000 + day, 5 * day)]


def test_plan_chunks(spark):
    day = 86400
    windows = spark.createDataFrame([("a", "posts", 0, 5 * day), ("b", "posts", 7, 9)], "sub string, kind string, after long, before long")
    days = spark.createDataFrame([("a", "posts", i * day, n) for i, n in enumerate([19999, 1, 5, 20000, 30000])], "sub string, kind string, day long, n long")
    got = sorted(tuple(r) for r in spans.plan_chunks(days, windows, K).collect())
    assert got == [("a", "posts", 0, 2 * day, 20000), ("a", "posts", 2 * day, 4 * day, 20005), ("a", "posts", 4 * day, 5 * day, 30000), ("b", "posts", 7, 9, 0)]


def test_superseded_goes_oldest_first(spark):
    rows = [("a", "posts", "f1", 0, 10, 1), ("a", "posts", "f2", 0, 10, 2), ("a", "posts", "f3", 5, 20, 3), ("a", "posts", "f4", 8, 9, 4), ("a", "posts", "f5", 0, 99, None)]
    df = spark.createDataFrame(rows, "sub string, kind string, file string, start long, end long, finished_at long")
    assert {r.file for r in spans.superseded(df, K).collect()} == {"f1", "f4"}


def test_holes_and_uncached(spark):
    df = spark.createDataFrame([("a", "posts", 5, 10, 1), ("a", "posts", 20, 30, 1), ("a", "posts", 10, 20, None)], "sub string, kind string, start long, end long, finished_at long")
    windows = spark.createDataFrame([("a", "posts", 0, 99), ("b", "posts", 0, 99)], "sub string, kind string, after long, before long")
    assert sorted(((r["sub"], r.start, r.end) for r in spans.holes(df, windows, K).collect()), key=str) == [("a", 0, 5), ("a", 10, 20), ("b", None, None)]
    days = spark.createDataFrame([("a", "posts", 0, 3), ("a", "posts", 86400, 4), ("a", "posts", 172800, 5)], "sub string, kind string, day long, n long")
    todo = spark.createDataFrame([("a", "posts", 86399, 86401), ("a", "posts", 86500, 86600)], "sub string, kind string, start long, end long")
    assert [tuple(r) for r in spans.uncached_items(days, todo, K).collect()] == [("a", "posts", 7)]


def test_superseded_as_by_trying_each(spark):
    r = random.Random(9)
    rows = [(str(k % 3), "posts", f"f{k}", a, a + r.choice([0, 1, 5, 20]), r.randint(0, 9)) for k in range(120) for a in [r.randint(0, 40)]]
    df = spark.createDataFrame(rows, "sub string, kind string, file string, start long, end long, finished_at long")
    want = set()
    for key in "012":
        left = sorted((x for x in rows if x[0] == key), key=lambda x: (x[5], x[3], x[4], x[2]))
        for x in list(left):
            others = {s for y in left if y is not x for s in range(y[3], y[4])}
            if all(s in others for s in range(x[3], x[4])):
                left.remove(x)
                want.add(x[2])
    assert {x.file for x in spans.superseded(df, ["sub", "kind"]).collect()} == want
