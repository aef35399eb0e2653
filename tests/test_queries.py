import os

import pytest

from quarry.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert sorted(plain([r[c] for c in cols]) for r in rows) == sorted(plain([r[i] for i in at]) for r in want.fetchall())
    else:
        assert df.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
def test_fetch_order_all_leaves_no_chunk_out(spark):
    from quarry.plans import queries

    d = DATA.replace("sf0.001", "sf0.01")
    want = queries.A.chunks(spark, d).where("finished_at is null").select("est", "start", "file").collect()
    rows = QUERIES["fetch_order_all"](spark, d).collect()
    assert QUERIES["fetch_order"](spark, d).collect() == rows
    assert len(want) > 50
    assert [(r.file, r.est) for r in rows] == [(r.file, r.est) for r in sorted(want, key=lambda r: (-r.est, r.start, r.file))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
def test_nested_results_hold_all_hits_of_the_searches(spark):
    import re

    from quarry.plans import queries

    want = {}
    for r in queries.A.threads_posts(spark, DATA).select("id", "selftext").collect():
        has = set(re.findall(r"[^\W_]+", (r.selftext or "").lower())).__contains__
        by = [q for q, yes in (("q1", has("the") and has("of")), ("q2", has("and") and has("to") and has("in")), ("q3", has("der") or has("la")), ("q4", has("de") and not has("la"))) if yes]
        want |= {r.id: by} if by else {}
    rows = QUERIES["nested_results"](spark, DATA).collect()
    assert {r.id: r.matched_by for r in rows} == want and any(int(i[1:]) % 2 for i in want)
    assert all(r.text_match for r in rows)
