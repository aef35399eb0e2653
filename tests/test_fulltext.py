import pytest
from pyspark.sql import functions as F

from quarry.operators import fulltext
from quarry.operators.fulltext import BadQuery, Leaf, Node, parse
from quarry.plans import readonly

DOCS = [("1", "Breeding geckos", "the eggs hatch in sand"), ("2", "breed", "sand in the eggs"), ("3", "bred", "an incubator for eggs"), ("4", "Incubation times", "hatch the eggs"), ("5", "eggs", "the gecko"), ("6", None, "")]


@pytest.fixture(scope="module")
def postings(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, selftext string")
    return {a: fulltext.build_postings(docs, "post", "id", ["title", "selftext"], a).cache() for a in ("plain", "porter")}


def found(postings, q, analyser="porter"):
    return {r.doc for r in fulltext.search(postings[analyser], "post", ["title", "selftext"], q, analyser).collect()}


def test_parse_binds():
    tree = parse("a b OR c NOT d")
    assert tree.op == "or" and tree.kids[0].op == "and" and tree.kids[1].op == "not"
    assert parse("(a OR b) c").op == "and"
    assert parse("title:x") == Leaf([["x"]], col="title")
    assert parse('NEAR(a "b c", 3)') == Leaf([["a"], ["b", "c"]], near=3)
    assert isinstance(parse("a AND b"), Node)


@pytest.mark.parametrize("bad", ["", "AND", "a OR", "(a", "a )", '""', "NEAR()", "NEAR(a, x)", "NOT a", "title:(a b)"])
def test_bad_queries(bad):
    with pytest.raises(BadQuery):
        parse(bad)


def test_search(postings):
    assert found(postings, "breed") == {"1", "2"}
    assert found(postings, "incub*") == {"3", "4"} and found(postings, "incubat*") == set()
    assert found(postings, "eggs sand") == {"1", "2"}
    assert found(postings, "eggs NOT sand") == {"3", "4", "5"}
    assert found(postings, "gecko NOT (sand OR title:eggs)") == set()
    assert found(postings, '"the eggs"') == {"1", "2", "4"}
    assert found(postings, '"eggs hatch in"') == {"1"}
    assert found(postings, "title:eggs") == {"5"}
    assert found(postings, '"geckos the"') == set()  # no phrase over two columns
    assert found(postings, "NEAR(eggs sand, 1)") == set() and found(postings, "NEAR(eggs sand, 2)") == {"1", "2"}
    assert found(postings, "NEAR(sand hatch eggs, 1)") == {"1"}
    with pytest.raises(BadQuery):
        found(postings, "body:x")


def test_two_sided(spark, postings):
    comments = spark.createDataFrame([("c1", "p1", "eggs"), ("c2", "p2", "sand")], "id string, post_id string, body string")
    both = postings["plain"].unionByName(fulltext.build_postings(comments, "comment", "id", ["body"]))
    posts, via = fulltext.two_sided(both, comments, "title:eggs")
    assert {r.id for r in posts.collect()} == {"5"} and via.count() == 0
    posts, via = fulltext.two_sided(both, comments, "body:eggs")
    assert posts.count() == 0 and {(r.id, r.post_id) for r in via.collect()} == {("c1", "p1")}
    with pytest.raises(BadQuery):
        fulltext.two_sided(both, comments, "other:eggs")


def test_hints(spark, postings):
    got = {r.word: (r.prefix, r.terms) for r in fulltext.zero_hit_hints(postings["porter"].select("term"), "incubat* OR egg* zzzzzz*").collect()}
    assert got == {"incubat": ("incub", ["incub"]), "zzzzzz": (None, None)}


def test_stored_postings_push_the_terms_down(spark, postings, tmp_path):
    fulltext.write_postings(postings["plain"], str(tmp_path / "p"))
    df = fulltext.search(spark.read.parquet(str(tmp_path / "p")), "post", ["title", "selftext"], "eggs OR hat*")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,hat)" in plan and "EqualTo(term,eggs)" in plan
    assert {r.doc for r in df.collect()} == {"1", "2", "3", "4", "5"}


def test_a_common_term_is_spread_over_files(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("concat('d', id) as id", "concat('the w', id % 50) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fulltext.write_postings(fulltext.build_postings(docs, "post", "id", ["text"]), str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = fulltext.read_postings(spark, str(tmp_path / "p")).where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(rows) >= 2 and sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 15_000


def test_searches_in_sql(spark, postings, tmp_path):
    fulltext.write_postings(postings["porter"], str(tmp_path / "p"))
    index = readonly.Index(fulltext.read_postings(spark, str(tmp_path / "p")), {"posts": ("post", ("title", "selftext"))}, "porter")
    spark.createDataFrame(DOCS, "id string, title string, selftext string").createOrReplaceTempView("match_posts")
    run = lambda sql: [tuple(r) for r in readonly.select(spark, sql, index).collect()]
    before = {t.name for t in spark.catalog.listTables()}
    assert sorted(run("SELECT p.id FROM match_posts p JOIN fts_posts('breeding OR \"eggs hatch\"') f ON f.id = p.id")) == [("1",), ("2",)]
    assert sorted(run("WITH f AS (SELECT * FROM FTS_posts ( 'eggs' )) SELECT id FROM f WHERE id NOT IN (SELECT id FROM fts_posts('sand'))")) == [("3",), ("4",), ("5",)]
    assert run("SELECT 'fts_posts(''x'')' AS a, \"fts_posts('y')\" AS b -- fts_posts('(')") == [("fts_posts('x')", "fts_posts('y')")]
    df = readonly.select(spark, "SELECT count(*) FROM fts_posts('hatch* egg')", index)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,hatch)" in plan and "EqualTo(term,egg)" in plan
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(BadQuery):
        run("SELECT * FROM fts_posts('(')")
    for bad in ("SELECT * FROM fts_other('x')", "DROP VIEW match_posts", "SELECT nothing FROM fts_posts('egg')"):
        with pytest.raises(readonly.NotReadOnly):
            run(bad)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_no_token_is_shuffled(spark):
    """Only whole documents are, by one exchange for all columns (one more for a UDF's terms), before their terms become rows. Rows of one
    document have their positions together."""
    docs = spark.createDataFrame([("1", "b a", "a b a"), ("1", None, "c a"), ("2", "", None), (None, "x", "x y")], "id string, title string, selftext string")
    for analyser in ("plain", "porter"):
        df = fulltext.build_postings(docs, "post", "id", ["title", "selftext"], analyser)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Generate")[0] and plan.count("Generate") == plan.count("Scan") == 1
        assert plan.count("- Exchange") == (1 if analyser == "plain" else 2)
        got = sorted((r.kind, r.doc or "", r.col, r.term, r.positions) for r in df.collect())
        assert got == [
            ("post", "", "selftext", "x", [0]), ("post", "", "selftext", "y", [1]), ("post", "", "title", "x", [0]), ("post", "1", "selftext", "a", [0, 1, 2]), ("post", "1", "selftext", "b", [1]),
            ("post", "1", "selftext", "c", [0]), ("post", "1", "title", "a", [1]), ("post", "1", "title", "b", [0]),
        ]


@pytest.mark.parametrize("analyser", ["plain", "porter"])
def test_texts_are_searched_as_their_postings_are(spark, postings, analyser):
    """Only postings of the queries' terms are made, at their places in the whole text, with the hits of all postings."""
    docs = spark.createDataFrame(DOCS, "id string, title string, selftext string")
    queries = {q: q for q in ["eggs OR gecko", '"the eggs"', "NEAR(eggs sand, 2)", "eggs NOT sand", "hat*", "title:eggs", "the (sand OR geck*)", '"in the eggs" OR breed']}
    found = fulltext.search_texts(docs, "post", "id", ["title", "selftext"], queries, analyser)
    want = fulltext.search_all(postings[analyser], "post", ["title", "selftext"], queries, analyser)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    some = fulltext.build_postings(docs, "post", "id", ["title", "selftext"], analyser, fulltext.wanted_by([parse("eggs inc*", analyser)]))
    key = lambda df: sorted((r.doc, r.col, r.term, tuple(r.positions)) for r in df.collect())
    eggs = parse("eggs", analyser).phrases[0][0]
    assert key(some) == key(postings[analyser].where((F.col("term") == eggs) | F.col("term").startswith("inc"))) and some.count() >= 6
    twice = fulltext.search_texts(docs.unionByName(spark.createDataFrame([("1", None, "gecko")], docs.schema)), "post", "id", ["title", "selftext"], {"q": "gecko eggs"}, analyser)
    assert {r.doc for r in twice.collect()} == {"1", "5"}
