import random

from pyspark.sql import functions as F

from quarry.operators import forest

SCHEMA = "id string, post_id string, parent string, author string, score long, created long, body string"
GONE = {"", "[deleted]", "[removed]"}


def noise(c, all_of, asks):
    if c["body"] in GONE or c["score"] < 0 or c["author"] == "x_bot" or c["body"] == "lol":
        return True
    parent = all_of.get(c["parent"])
    asked = asks if c["parent"] is None else bool(parent) and parent["body"].endswith("?")
    if len(c["body"]) >= 40 or (asked and "?" not in c["body"]):
        return False
    return c["score"] <= 2


def leaf_by_leaf(comments, asks):
    """Deletes prunable leaves until there is none."""
    left = {c["id"]: c for c in comments}
    every = dict(left)
    while True:
        parents = {c["parent"] for c in left.values()}
        gone = [i for i, c in left.items() if i not in parents and noise(c, every, asks)]
        if not gone:
            return set(left)
        for i in gone:
            del left[i]


def random_forest(r, post):
    out = []
    for i in range(r.randint(1, 14)):
        parent = r.choice([None, "missing"] + [c["id"] for c in out]) if out else None
        body = r.choice(["yes", "lol", "x" * 39, "x" * 40, "why is that so?", "[deleted]", "really?"])
        out.append(dict(id=f"{post}_{i}", post_id=post, parent=parent, author=r.choice(["a", "x_bot"]), score=r.choice([-1, 0, 2, 3]), created=r.randint(0, 5), body=body))
    return out


def test_prune_equals_leaf_by_leaf(spark):
    r = random.Random(5)
    forests = {f"p{k}": (random_forest(r, f"p{k}"), r.random() < 0.5) for k in range(60)}
    df = spark.createDataFrame([c for cs, _ in forests.values() for c in cs], SCHEMA)
    asks = spark.createDataFrame([(p, a) for p, (_, a) in forests.items()], "post_id string, asks boolean")
    kept = forest.prune(df, asks)
    got = {r.id for r in kept.select("id").collect()}
    assert got == {i for cs, a in forests.values() for i in leaf_by_leaf(cs, a)}
    assert {r.id for r in forest.prune(kept, asks).select("id").collect()} <= got


def depth_first(comments):
    ids = {c["id"] for c in comments}
    kids = {}
    for c in sorted(comments, key=lambda c: (c["created"], c["id"])):
        kids.setdefault(c["parent"] if c["parent"] in ids else None, []).append(c)
    out = []

    def visit(c, depth, root):
        out.append((c["id"], root, depth))
        for k in kids.get(c["id"], []):
            visit(k, depth + 1, root)

    for c in kids.get(None, []):
        visit(c, 0, c["id"])
    return out


def test_reading_order(spark):
    r = random.Random(6)
    forests = [random_forest(r, f"p{k}") for k in range(30)]
    forests.append([dict(id=f"d{i}", post_id="deep", parent=f"d{i - 1}" if i else None, author="a", score=0, created=i, body="x") for i in range(120)])
    got = forest.reading_order(spark.createDataFrame([c for cs in forests for c in cs], SCHEMA)).orderBy("post_id", "place").collect()
    for cs in forests:
        assert [(x.id, x.root, x.depth) for x in got if x.post_id == cs[0]["post_id"]] == depth_first(cs)


def test_render_marks_depth(spark):
    rows = [dict(id=f"d{i}", post_id="p", parent=f"d{i - 1}" if i else None, author="a", score=i, created=i, body="# h\nx") for i in range(8)]
    text = forest.render_threads(forest.reading_order(spark.createDataFrame(rows, SCHEMA))).first().text
    assert text.startswith("> **u/a** (0) · c/d0\n> \\# h\n> x\n>\n> > **u/a** (1)")
    assert "> > > > > > **u/a** (6) · c/d6 · [d7]" in text and "> " * 7 not in text


def test_survival(spark):
    posts = spark.createDataFrame([("a", "text"), ("b", ""), ("c", "")], "id string, selftext string")
    kept = spark.createDataFrame([("1", "b")], "id string, post_id string")
    assert {r.id for r in forest.surviving_posts(posts, kept).collect()} == {"a", "b"}


def test_circles_end_and_are_in_no_thread(spark):
    one = lambda i, parent: dict(id=i, post_id="p", parent=parent, author="a", score=5, created=1, body="x" * 50)
    rows = [one("a", "c"), one("b", "a"), one("c", "b"), one("below", "a"), one("self", "self"), one("top", None), one("under", "top"), one("under", "top")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = forest.reading_order(df).collect()
    assert sorted((r.id, r.root, r.depth, r.place) for r in got) == [("top", "top", 0, 1), ("under", "top", 1, 2), ("under", "top", 1, 2)]
    assert {r.id for r in forest.prune(df, spark.createDataFrame([("p", False)], "post_id string, asks boolean")).collect()} == {"top", "under"}
    assert forest.reading_order(df.limit(0)).count() == 0


def test_deep_and_wide(spark):
    deep = [dict(id=f"d{i:05}", post_id="deep", parent=f"d{i - 1:05}" if i else None, author="a", score=0, created=0, body="x" if i != 1500 else "y" * 50) for i in range(3000)]
    wide = [dict(id=f"w{i:05}", post_id="wide", parent="w00000" if i else None, author="a", score=0, created=-i, body="lol" if i % 2 else "y" * 50) for i in range(3000)]
    df = spark.createDataFrame(deep + wide, SCHEMA)
    got = {r.id: (r.depth, r.place) for r in forest.reading_order(df).collect()}
    assert all(got[f"d{i:05}"] == (i, i + 1) for i in range(3000))
    assert got["w00000"] == (0, 1) and all(got[f"w{i:05}"] == (1, 3001 - i) for i in range(1, 3000))
    kept = {r.id for r in forest.prune(df, spark.createDataFrame([("deep", False), ("wide", False)], "post_id string, asks boolean")).collect()}
    assert kept == {f"d{i:05}" for i in range(1501)} | {f"w{i:05}" for i in range(0, 3000, 2)}


def test_sums_over_subtrees(spark):
    r = random.Random(8)
    forests = [random_forest(r, f"p{k}") for k in range(20)]
    df = spark.createDataFrame([c for cs in forests for c in cs], SCHEMA)
    got = {x.id: (x.n, x.chars) for x in forest.tour(df, {"n": F.lit(1), "chars": F.length("body")}).collect()}
    for cs in forests:
        up, by_id = {c["id"]: c["parent"] for c in cs}, {c["id"]: c for c in cs}
        below = {i: [] for i in by_id}
        for i in by_id:
            at = i
            while at in by_id:
                below[at].append(i)
                at = up[at]
        assert all(got[i] == (len(b), sum(len(by_id[x]["body"]) for x in b)) for i, b in below.items())
