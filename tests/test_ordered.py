import random

from pyspark.sql import functions as F

from quarry.operators import ordered


def test_running_sums_and_next_rows(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(5)
    inorder = sorted(rows, key=lambda t: (t[0] is not None, t[0] or "", -t[1]))
    order = [F.asc_nulls_first("k"), F.desc("i")]
    got = {t.i: (t.place, t.before) for t in ordered.running(df, order, {"before": F.col("x")}).collect()}
    total = 0
    for place, (_, i, x) in enumerate(inorder, 1):
        assert got[i] == (place, total)
        total += x
    after = {t.i: t.next and t.next.i for t in ordered.with_next(df, order, ["i"]).collect()}
    assert after == {t[1]: (n[1] if n else None) for t, n in zip(inorder, [*inorder[1:], None])}
    none = df.limit(0)
    assert ordered.running(none, order, {"before": F.col("x")}).count() == 0 and ordered.with_next(none, order, ["i"]).count() == 0
