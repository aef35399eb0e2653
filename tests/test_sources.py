import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import ingest
from quarry.sources import archive, chunks, results
from quarry.streaming import ingest as stream


def server(rows, size, log=None):
    def get(path, params):
        if log is not None:
            log.append(params)
        page = sorted((r for r in rows if r["created_utc"] > params["after"]), key=lambda r: (r["created_utc"], r["id"]))
        return {"data": page[:size]}

    return get


def test_pages_give_each_row_once():
    rows = [{"id": f"a{i:02}", "created_utc": 100 + i // 3} for i in range(40)]
    got = [r["id"] for r in archive.pages(server(rows, 7), "posts", "s", 101, 110)]
    assert got == [r["id"] for r in rows if 101 <= r["created_utc"] < 110]


def test_a_second_longer_than_a_page_is_noted():
    rows = [{"id": f"{i:04}", "created_utc": 5} for i in range(150)] + [{"id": "z", "created_utc": 6}]
    skipped = []
    got = [r["id"] for r in archive.pages(server(rows, 100), "posts", "s", 0, 10, skipped)]
    assert got[-1] == "z" and len(got) == 101 and skipped == [("s", "posts", 5)]


def test_retries():
    calls, slept = [], []

    def flaky(path, params):
        calls.append(dict(params))
        if len(calls) == 1:
            raise archive.HttpError(429, "limit", 7)
        if len(calls) < 5:
            raise OSError("reset")
        return {"data": []}

    limiter = archive.Limiter(clock=lambda: 1e9, sleep=lambda s: None)
    limiter.limited = slept.append
    assert archive.get_with_retry(flaky, "p", {"limit": "auto"}, limiter, slept.append) == {"data": []}
    assert slept == [7, 2, 4, 8] and calls[-1]["limit"] == archive.MIN_PAGE
    with pytest.raises(archive.HttpError):
        archive.get_with_retry(lambda *_: (_ for _ in ()).throw(archive.HttpError(404, "no")), "p", {}, archive.Limiter(), slept.append)


def test_limiter_widens_and_halves():
    now = [0.0]
    limiter = archive.Limiter(most=3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    widths = []
    for _ in range(7):
        limiter.call(lambda: None)
        widths.append(limiter.allowed)
    assert widths == [2, 2, 3, 3, 3, 3, 3]
    assert [limiter.try_begin() for _ in range(3)] == [0.0] * 3 and limiter.try_begin() > 0
    limiter.limited(5)
    limiter.limited(5)  # two calls that met the same limit
    assert limiter.allowed == 1 and limiter.stopped_until == 5
    limiter.running = 0
    assert limiter.try_begin() == 5.0
    limiter.call(lambda: None)
    assert now[0] >= 5 and limiter.running == 0 and limiter.allowed == 2
    now[0] += 1
    limiter.allowed = 3
    limiter.limited(1)
    limiter.limited(1)
    assert limiter.allowed == 1


def test_a_failed_call_gives_its_place_back():
    limiter = archive.Limiter(clock=lambda: 1.0)
    with pytest.raises(OSError):
        limiter.call(lambda: (_ for _ in ()).throw(OSError()))
    assert limiter.running == 0 and limiter.well == 0


def stub(path, params):
    return server([{"id": f"a{i}", "created_utc": i, "title": "half \ud83d"} for i in range(50)], 20)(path, params)


def test_data_source(spark):
    spark.dataSource.register(archive.ArchiveSource)
    df = spark.read.format("archive").options(kind="posts", transport="tests.test_sources:stub", chunks=json.dumps([["s", 0, 20], ["s", 20, 45]])).load()
    try:
        rows = df.collect()
    except Exception as e:  # the stub's module isn't on the path of the workers
        if "No module named" not in str(e):
            raise
        reader = archive.ArchiveReader({"kind": "posts", "transport": f"{__name__}:stub", "chunks": '[["s", 0, 20], ["s", 20, 45]]'})
        rows = [dict(zip(archive.FIELDS["posts"], r)) for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 45 and {r["title"] for r in rows} == {"half �"}


def crowded(path, params):
    return server([{"id": f"{i:04}", "created_utc": 5} for i in range(150)] + [{"id": f"z{i}", "created_utc": i, "subreddit": "s"} for i in range(6, 40)], 100)(path, params)


def test_filters_narrow_the_chunks(spark):
    spark.dataSource.register(archive.ArchiveSource)
    options = {"kind": "posts", "transport": "tests.test_sources:crowded", "chunks": json.dumps([["s", 0, 20], ["other", 0, 20], ["S", 20, 45]]), "pushdown": "true"}
    reader = archive.PushingReader(options)
    rest = list(reader.pushFilters([archive.GreaterThan(("created_utc",), 7), archive.LessThanOrEqual(("created_utc",), 21), archive.In(("subreddit",), ("s",))]))
    assert len(rest) == 3 and reader.chunks == [["s", 8, 20], ["S", 20, 22]]
    assert not [*archive.PushingReader(options).pushFilters([])] and len(archive.PushingReader(options).chunks) == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("archive").options(**options).load().where("created_utc >= 8 and created_utc < 22 and subreddit = 's'")
        assert sorted(r.id for r in rows.select("id").distinct().collect()) == sorted(f"z{i}" for i in range(8, 22))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_seconds_that_cannot_be_read_are_rows(spark):
    spark.dataSource.register(archive.ArchiveSource)
    df = spark.read.format("archive").options(kind="posts", transport="tests.test_sources:crowded", chunks=json.dumps([["s", 0, 30]])).load()
    rows, skipped = archive.split_skipped(df)
    assert [tuple(r) for r in skipped.collect()] == [("s", 5)] and rows.where("created_utc = 5").count() == 100 and rows.where("created_utc > 5").count() == 24 and "_skipped" not in rows.columns


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(archive.ArchiveSource)

    def go(before, fail=False):
        rows = spark.readStream.format("archive").options(kind="posts", transport="tests.test_sources:stub", subs='["s", "t"]', after="3", before=str(before), slice="7").load()

        def take(batch, n):
            batch.select("id", "created_utc", F.lit(n).alias("n")).write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}"))
            if fail:
                raise RuntimeError("stopped")

        q = rows.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    read = lambda: sorted(r.created_utc for r in spark.read.parquet(str(tmp_path / "out")).collect())
    go(20)
    assert read() == sorted([*range(3, 20)] * 2)
    with pytest.raises(Exception, match="stopped"):
        go(31, fail=True)
    go(45)
    assert read() == sorted([*range(3, 45)] * 2)
    stream_ = archive.ArchiveStream({"kind": "posts", "subs": '["s"]', "after": "100", "lag": "60"}, now=lambda: 500)
    assert stream_.latestOffset() == {"second": 440} and [p.value for p in stream_.partitions({"second": 100}, {"second": 440})] == [[("s", 100, 440)]]
    assert archive.ArchiveStream({"kind": "posts", "subs": "[]", "after": "1000"}, now=lambda: 500).latestOffset() == {"second": 1000}


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_chunks_newest_wins_and_build(spark, tmp_path):
    old = [{"id": "p1", "title": "Is it?", "selftext": "[removed]", "score": 1, "created_utc": 5}, {"id": "p2", "title": "b", "selftext": "", "created_utc": 6}, '{"id": "torn', {"id": "p3", "over_18": True, "selftext": "x", "created_utc": 7}]
    new = [{"id": "p1", "title": "Is it?", "selftext": "", "score": 9, "created_utc": 5, "url": "https://r/comments/p1/x"}, {"id": "late", "selftext": "x", "created_utc": 50}]
    write(tmp_path / "sub" / "posts.1", old)
    write(tmp_path / "sub" / "posts.2", new)
    write(tmp_path / "sub" / "comments.1", [{"id": "c1", "link_id": "t3_p1", "parent_id": "t3_p1", "body": "yes", "created_utc": 8}, {"id": "c2", "link_id": "t3_p3", "parent_id": "t3_p3", "body": "x" * 50, "created_utc": 8}, {"id": "c3", "link_id": "t3_p2", "parent_id": "t1_c9", "body": "lol", "created_utc": 9}])
    catalogue = [("Sub", "posts", "posts.1", 0, 10, 0, 4, 100), ("Sub", "posts", "posts.2", 0, 60, 0, 2, 200), ("Sub", "posts", "posts.3", 0, 60, 0, None, None), ("Sub", "comments", "comments.1", 0, 10, 0, 3, 100)]
    cat = spark.createDataFrame(catalogue, "sub string, kind string, file string, start long, end long, est long, rows long, finished_at long")
    windows = spark.createDataFrame([("SUB", 0, 40)], "sub string, after long, before long")
    raw = {k: chunks.newest_wins(chunks.read_chunks(spark, str(tmp_path), cat, windows, k), ["id"], ["finished_at", "file", "__line"]) for k in ("posts", "comments")}
    assert {r.id: r.score for r in raw["posts"].collect()} == {"p1": 9, "p2": None, "p3": None}
    posts, comments = ingest.build(raw["posts"], raw["comments"])
    assert [(r.id, r.title, r.selftext, r.score, r.author, r.url) for r in posts.collect()] == [("p1", "Is it?", "", 9, "[deleted]", "")]
    assert [(r.id, r.post_id, r.parent) for r in comments.collect()] == [("c1", "p1", None)]
    assert chunks.read_chunks(spark, str(tmp_path), cat, windows.withColumn("before", F.lit(0).cast("long")), "posts").count() == 0


def test_numbers_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i:03}", 1000 - i) for i in range(100)], "id string, created long").repartition(4)
    got = [r.pid for r in ingest.numbered(rows, "pid").orderBy("created").collect()]
    assert got == list(range(1, 101))
    a = spark.createDataFrame([("1", "a")], "id string, sub_key string")
    b = spark.createDataFrame([("2", "b")], "id string, sub_key string")
    for posts in (a, b, a.withColumn("id", F.lit("3"))):
        ingest.write_tables(posts, posts, str(tmp_path))
    assert {(r.id, r.sub_key) for r in spark.read.parquet(str(tmp_path / "posts")).collect()} == {("2", "b"), ("3", "a")}


def test_import_and_resume(spark, tmp_path):
    write(tmp_path / "r_x_posts.jsonl", [{"id": "b", "subreddit": "X", "created_utc": 9}, {"id": "a", "subreddit": "x", "created_utc": 3}, {"id": "o", "subreddit": "other", "created_utc": 3}, "{torn"])
    got = chunks.import_file(spark, str(tmp_path / "r_x_posts.jsonl"), "x", "posts", 0, 10)
    assert [r.id for r in got.collect()] == ["a", "b"] and "subreddit" in got.columns
    with pytest.raises(ValueError):
        chunks.import_file(spark, str(tmp_path / "r_x_posts.jsonl"), "zz", "posts", 0, 10)
    r = chunks.resume_point(spark.createDataFrame([("a", 3), ("b", 9), ("c", 9)], "id string, created_utc long")).first()
    assert (r.n, r["last"], r.ids) == (3, 9, ["b", "c"])
    assert chunks.parse_marker("12 34\n") == (12, 34) and chunks.parse_marker("") is None and chunks.parse_marker("x 1") is None
    files = spark.createDataFrame([("/d/r_X_posts.jsonl", 1), ("/d/r_x_posts (2).jsonl", 5), ("/d/r_xy_posts.jsonl", 9)], "path string, modified long")
    assert chunks.newest_file(files, "x", "posts").first().path == "/d/r_x_posts (2).jsonl"


def test_runs_beside_each_other(spark, tmp_path):
    path = str(tmp_path / "kept")
    read = lambda before=None: [(r.id, r.queries) for r in results.read_run(spark, path, results.KEPT, before).collect()]
    assert read() == []
    for run in (1, 2):
        results.write_run(spark.createDataFrame([(str(run), 1, 0.5, True, ["q"])], results.KEPT), path, run)
    assert read() == [("2", ["q"])] and read(2) == [("1", ["q"])] and read(1) == []
    broken = spark.createDataFrame([("3", 1, 0.5, True, ["q"])], results.KEPT).where(F.assert_true(F.lit(False), F.lit("broken")).isNotNull())
    with pytest.raises(Exception, match="broken"):
        results.write_run(broken, path, 3)
    assert read() == [("2", ["q"])]
    results.write_run(spark.createDataFrame([], results.KEPT), path, 2)
    assert read() == [("1", ["q"])]


def test_stream_keeps_the_newest(spark, tmp_path):
    write(tmp_path / "in" / "1.jsonl", [{"id": "a", "score": 1}, {"id": "b", "score": 1}])
    rows = stream.read_stream(spark, str(tmp_path / "in"), "posts")

    def go():
        q = rows.writeStream.foreachBatch(stream.merge_batch(str(tmp_path / "t"), ["arrived", "score"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    go()
    write(tmp_path / "in" / "2.jsonl", [{"id": "a", "score": 5}, "{torn"])
    go()
    assert {r.id: r.score for r in stream.current(spark, str(tmp_path / "t"), "posts").collect()} == {"a": 5, "b": 1}
    made = stream.generations(spark, str(tmp_path / "t"))
    assert sorted(map(len, made.values())) == [1, 2]  # only a's bucket was written again
    write(tmp_path / "in" / "3.jsonl", [{"id": "a", "score": 7}])
    go()
    write(tmp_path / "in" / "4.jsonl", [{"id": "a", "score": 6}])
    go()
    assert {r.id: r.score for r in stream.current(spark, str(tmp_path / "t"), "posts").collect()} == {"a": 6, "b": 1}
    assert sorted(map(len, stream.generations(spark, str(tmp_path / "t")).values())) == [1, 2]
    again = spark.createDataFrame([("a", 9)], "id string, score long").selectExpr("id", *(f"cast(null as {t}) as {c}" for c, t in (x.split() for x in stream.RAW["posts"].split(", ")) if c not in ("id", "score")), "score", "timestamp '2100-01-01' as arrived")
    again = again.select(*[f.split()[0] for f in stream.RAW["posts"].split(", ")], "arrived")
    for _ in range(2):  # a batch that is run again
        stream.merge_batch(str(tmp_path / "t"), ["arrived", "score"])(again, 9)
        assert {r.id: r.score for r in stream.current(spark, str(tmp_path / "t"), "posts").collect()} == {"a": 9, "b": 1}


def test_numbers_follow_time(spark):
    rows = [(f"i{k}", None if k == 7 else (k * 7919) % 500 * 40) for k in range(600)]
    df = spark.createDataFrame(rows, "id string, created long").repartition(5)
    got = ingest.numbered(df, "pid")
    assert got.columns == ["id", "created", "pid"]
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r.id, r.created, r.pid) for r in got.orderBy("pid").collect()] == [(*r, k + 1) for k, r in enumerate(order)]
    assert ingest.numbered(df.where("false"), "pid").count() == 0


def test_import_registers_a_chunk(spark, tmp_path):
    folder, root = tmp_path / "saved files", tmp_path / "root"
    write(folder / "r_x_posts.jsonl", [{"id": "old", "subreddit": "x", "created_utc": 1}])
    write(folder / "r_x_posts (1).jsonl", [{"id": "b", "subreddit": "X", "created_utc": 9}, {"id": "a", "subreddit": "x", "created_utc": 3}, "{torn"])
    write(folder / "r_y_posts.jsonl", [{"id": "a", "subreddit": "y", "created_utc": 3}])
    write(folder / "r_y_posts.jsonl.crswap", [])
    os.utime(folder / "r_x_posts.jsonl", (100, 100))
    os.utime(folder / "r_x_posts (1).jsonl", (200, 200))
    have = spark.createDataFrame([("X", "posts", "posts.0004.jsonl", 0, 5, 0, 1, 50)], chunks.CHUNKS)
    got = chunks.import_chunk(spark, str(folder), str(root), "x", "posts", 0, None, have, 999, remove=True)
    assert sorted(tuple(r) for r in got.where("finished_at = 999").collect()) == [("x", "posts", "posts.0005.jsonl", 0, 200, 0, 2, 999)] and got.count() == 2
    assert not (folder / "r_x_posts (1).jsonl").exists() and (folder / "r_x_posts.jsonl").exists()
    windows = spark.createDataFrame([("X", 0, 40)], "sub string, after long, before long")
    rows = chunks.read_chunks(spark, str(root), got.where("finished_at = 999"), windows, "posts")
    assert sorted((r.id, r.file) for r in rows.collect()) == [("a", "posts.0005.jsonl"), ("b", "posts.0005.jsonl")]
    for sub, why in (("y", "still being written"), ("z", "no saved file")):
        with pytest.raises(ValueError, match=why):
            chunks.import_chunk(spark, str(folder), str(root), sub, "posts", 0, 10, have, 999)


def test_spans_are_dealt_over_few_tasks():
    spans = [("s", k, k + 10 * (k % 4 + 1)) for k in range(20)]
    hands = archive.dealt(spans, 3)
    assert sorted(s for h in hands for s in h.value) == sorted(spans) and len(hands) == 3
    read = [sum(b - a for _, a, b in h.value) for h in hands]
    assert max(read) - min(read) <= 40 and [len(archive.dealt(spans[:2], 6)), archive.dealt([], 6)[0].value] == [2, []]
