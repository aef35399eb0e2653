from pyspark.sql import functions as F

from quarry.operators import hits, spans, verdicts
from quarry.plans import filtering, ingest, judging

QS = verdicts.Questions(q=("a", "b"), must="m", nots=("n",))


class Fixed:
    """Answers that stand in the state: numbers, or nothing for a failure."""

    name = "fixed"

    def score(self, state, questions):
        numbers = [float(x) for x in state.split()]
        return ((numbers * 4)[: len(questions)] if numbers else None), False


def test_dry_run_shows_every_probability(spark):
    posts = spark.createDataFrame([("p1", "s", None, "0.5 0.6 0.1 0.2"), ("p2", "s", None, "0.2 0.9 0.9 0.1"), ("p3", "s", None, "0.9 0.9 0.9 0.9"), ("p4", "s", None, ""), ("p5", "s", None, "0.4 0.3 0.3 0.0"), ("p6", "s", None, "0.5 0.5 0.5 0.5")], "id string, sub string, link_flair string, state string")
    threads = [("p1", f"r{k}", 1, f"0.{k} 0.1" if k else "", 50, False) for k in range(6)] + [("p5", "t", 1, "0.7 0.2", 50, False)]
    parts = spark.createDataFrame(threads, "post_id string, root string, part int, state string, chars int, has_hit boolean")
    picked = spark.createDataFrame([(f"p{k}", "chosen") for k in range(1, 6)], "id string, label string")
    rows, outcome = judging.dry_run(picked, posts, parts, QS, filtering.Answers(spark, Fixed()))
    got = {r.id: r for r in rows.collect()}
    assert {i: (r.decision, r.probs) for i, r in got.items()} == {
        "p1": ("KEEP", "[Must 0.50 | Q1 0.60 Q2 0.10 | Not1 0.20]"), "p2": ("EXCLUDED by must", "[Must 0.20 | Q1 0.90 Q2 0.90 | Not1 0.10]"), "p3": ("EXCLUDED by not", "[Must 0.90 | Q1 0.90 Q2 0.90 | Not1 0.90]"),
        "p4": ("UNJUDGED", "[failed]"), "p5": ("KEEP via thread", "[Must 0.40 | Q1 0.30 Q2 0.30 | Not1 0.00]"),
    }
    assert [(t.root, t.probs, t.kept) for t in got["p1"].threads] == [("r0", "[failed]", True), ("r5", "[Q1 0.50 Q2 0.10]", True), ("r4", "[Q1 0.40 Q2 0.10]", False), ("r3", "[Q1 0.30 Q2 0.10]", False)]
    assert (got["p1"].n_threads, got["p1"].n_kept, got["p2"].n_threads, got["p2"].threads) == (6, 2, 0, None)
    assert judging.dry_run_totals(outcome, QS).first().asDict() == {"n": 5, "kept": 3, "via": 1, "must_only": 1, "excluded": 1, "only_1": 2, "only_2": 0}


def test_dry_run_reads_its_tables_once(spark):
    """The sample is picked once, and posts and parts are read as often as it takes to find those of the sample, whatever the run does with them."""
    passed = {name: spark.sparkContext.accumulator(0) for name in ("picked", "posts", "parts")}

    def counted(df, name):
        def each(batches):
            for x in batches:
                passed[name].add(len(x))
                yield x

        return df.mapInPandas(each, df.schema)

    posts = counted(spark.createDataFrame([(f"p{i}", "s", None, "0.4 0.3 0.3 0.0") for i in range(30)], "id string, sub string, link_flair string, state string"), "posts")
    parts = counted(spark.createDataFrame([(f"p{i}", "t", k, "0.2 0.1", 50, False) for i in range(30) for k in (1, 2)], "post_id string, root string, part int, state string, chars int, has_hit boolean"), "parts")
    picked = counted(spark.createDataFrame([(f"p{i}", "chosen") for i in range(4)], "id string, label string"), "picked")
    rows, outcome = judging.dry_run(picked, posts, parts, QS, filtering.Answers(spark, Fixed()))
    assert {r.id: (r.decision, r.n_threads) for r in rows.collect()} == {f"p{i}": ("drop", 1) for i in range(4)}
    assert judging.dry_run_totals(outcome, QS).first().n == 4
    assert {name: n.value for name, n in passed.items()} == {"picked": 4, "posts": 30, "parts": 60}


def test_show(spark):
    posts = spark.createDataFrame([("x1", 1, "sub", "ann", "One", "text", 1704067200, 3, "https://example.com"), ("x2", 2, "sub", "bob", "Two", "", 1704067200, 3, "")], "id string, pid long, sub string, author string, title string, selftext string, created long, score long, url string")
    comments = spark.createDataFrame([("a", "x1", None, "c", 1, 5, "later"), ("b", "x1", None, "c", 1, 4, "first"), ("k", "x1", "b", "d", 1, 9, "below")], "id string, post_id string, parent string, author string, score long, created long, body string")
    got = {r.n: r for r in judging.show(posts, comments, ["P2", "t3_x1", "nobody", "P2"]).collect()}
    assert [got[k].id for k in (1, 2, 3, 4)] == ["x2", "x1", None, "x2"] and got[3].text is None
    assert got[2].text == "# P1 One\nr/sub | u/ann | 2024-01-01 | score 3 | https://www.reddit.com/r/sub/comments/x1/\nLink: https://example.com\n\ntext\n\n> **u/c** (1) · c/b\n> first\n>\n> > **u/d** (1) · c/k\n> > below\n> >\n> **u/c** (1) · c/a\n> later\n>\n\n---\n"
    assert got[1].text.endswith("\n\n\n\n\n---\n") and judging.show(posts, comments, []).count() == 0


def test_thread_order(spark):
    qs = verdicts.Questions(q=("a",))
    posts = spark.createDataFrame([("p", [0.1]), ("q", [0.15]), ("r", None)], "post_id string, probs array<double>").withColumn("verdict", verdicts.post_verdict(F.col("probs"), qs))
    jobs = spark.createDataFrame([("p", "1", "c"), ("q", "2", "c"), ("q", "1", "c"), ("r", "9", "a"), ("p", "0", "b"), ("q", "0", "b")], "post_id string, root string, set string")
    assert [(r.post_id, r.root) for r in verdicts.thread_order(jobs, posts).orderBy("place").collect()] == [("r", "9"), ("p", "0"), ("q", "0"), ("q", "1"), ("q", "2"), ("p", "1")]


def test_missed_and_reset(spark):
    own, via = spark.createDataFrame([("p",), ("q",)], "id string"), spark.createDataFrame([("c1", "q"), ("c2", "r"), ("c3", "r")], "id string, post_id string")
    found = spark.createDataFrame([("p", "x")], "id string, query string")
    assert sorted(tuple(r) for r in hits.missed_on_both_sides(own, via, found).collect()) == [("q", True, 1), ("r", False, 2)]
    assert [t.count() for t in hits.reset(own, via, found)] == [0, 0, 0]


def test_catalogue(spark):
    subs = spark.createDataFrame([("Alpha",), ("alps",), ("beta",)], "sub string")
    days = spark.createDataFrame([("Alpha", "posts", 0, 100), ("Alpha", "comments", 86400, 50), ("beta", "posts", 0, 7)], "sub string, kind string, day long, n long")
    todo = spark.createDataFrame([("Alpha", "posts", 86000, 90000), ("Alpha", "comments", 0, 86400), ("beta", "posts", 0, 1)], "sub string, kind string, start long, end long")
    got = {r["sub"]: tuple(r)[1:] for r in spans.catalogue(subs, days, todo, "AL", ["BETA", "nowhere", "alpha"]).collect()}
    assert got == {"Alpha": (True, 100, 50, 100, 6, 0), "alps": (True, 0, 0, 0, 0, 0), "beta": (True, 7, 0, 7, 0, 0), "nowhere": (False, None, None, None, None, None)}
    assert set(r["sub"] for r in spans.catalogue(subs, days, todo, "al", most=1).collect()) == {"Alpha"}


def test_counts_of_what_is_written(spark, tmp_path):
    posts = spark.createDataFrame([("a", "s", "Title", "text", None), ("b", "s", "Title", "[deleted]", None), ("c", "s", "Title", "x", True)], "id string, subreddit string, title string, selftext string, over_18 boolean")
    raw_posts = posts.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("author", "string"), ("author_flair_text", "string"), ("link_flair_text", "string"), ("score", "long"), ("created_utc", "long"), ("num_comments", "long"), ("url", "string"))))
    comments = spark.createDataFrame([("1", "t3_a", "lol"), ("2", "t3_a", "y" * 60), ("3", "t3_b", "lol"), ("4", "t3_c", "y" * 60)], "id string, link_id string, body string")
    raw_comments = comments.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("parent_id", "string"), ("author", "string"), ("author_flair_text", "string"), ("score", "long"), ("created_utc", "long"))))
    counts = ingest.build_counted(raw_posts, raw_comments, str(tmp_path), "S")
    assert counts == {"posts_in": 3, "comments_in": 3, "posts": 1, "comments": 1}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "comments")).collect()} == {"2"} and spark.read.parquet(str(tmp_path / "posts")).first().sub_key == "s"
