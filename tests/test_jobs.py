"""The jobs on copies: small tables that grow between runs, and runs that are cut short."""

import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import search_watch, thread_digest

REPO = Path(__file__).resolve().parents[1]
WATCH = {"searches": {"a": "cat AND dog", "b": '"red cat" OR fish'}, "max_files_per_trigger": 1}
DIGEST = {"short_chars": 10, "budget_tokens": 30, "hide_images": True}
TURNS = "conv_id long, turn long, role string, text string"


def write_docs(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode(mode).parquet(str(path))


def found(rows):
    return sorted((r.pid, r.search, r.shown) for r in rows.collect())


def test_watch_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    docs, out, mark = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark")
    write_docs(spark, [(1, "a red cat and a dog", "en"), (2, "nothing here", "en"), (3, None, None), (None, "fish", "en"), (4, "", "en")], docs)
    first = found(search_watch.run(spark, docs, out, mark, WATCH))
    assert first == [(1, "a", "a red cat and a dog"), (1, "b", "a red cat and a dog")]
    files = sorted(str(p) for p in Path(out).rglob("*.parquet"))
    assert found(search_watch.run(spark, docs, out, mark, WATCH)) == first and sorted(str(p) for p in Path(out).rglob("*.parquet")) == files  # nothing new
    # a document again, a new version of one, a new one twice
    write_docs(spark, [(1, "a red cat and a dog", "fr"), (2, "now fish", "en"), (5, "Dog, cat", "en"), (5, "Dog, cat", "en")], docs)
    caplog.clear()
    second = search_watch.run(spark, docs, out, mark, WATCH)
    assert found(second) == sorted([*first, (2, "b", "now fish"), (5, "a", "Dog, cat")])
    assert {r.batch for r in second.where("pid = 1").collect()} == {0} and {r.batch for r in second.where("pid <> 1").collect()} == {1}
    assert all(Path(f).exists() for f in files)
    assert any("read 4 documents in 1 batches" in m for m in caplog.messages) and any(m.startswith("batch 1: read 4 documents, wrote") for m in caplog.messages)
    # all at once gives the same
    whole = search_watch.run(spark, docs, str(tmp_path / "out2"), str(tmp_path / "mark2"), WATCH)
    assert found(whole) == found(second)


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    write_docs(spark, [(1, "cat dog", "en"), (2, "fish", "en")], docs)
    spark.createDataFrame([], search_watch.SCHEMA).write.partitionBy("search", "batch").parquet(out)
    take = search_watch.taking(out, WATCH["searches"], [])
    batch = spark.read.parquet(docs)
    take(batch, 0)
    once = found(spark.read.schema(search_watch.SCHEMA).parquet(out))
    take(batch, 0)  # the stream had not yet noted that it was done
    take(batch, 1)  # the same documents later give nothing
    assert found(spark.read.schema(search_watch.SCHEMA).parquet(out)) == once == [(1, "a", "cat dog"), (2, "b", "fish")]


def test_watch_of_one_file_and_of_none(spark, tmp_path):
    write_docs(spark, [(1, "fish", "en")], tmp_path / "one")
    one = next(Path(tmp_path / "one").glob("part-*"))
    got = search_watch.run(spark, str(one), str(tmp_path / "out"), str(tmp_path / "mark"), WATCH)
    assert found(got) == [(1, "b", "fish")]
    write_docs(spark, [], tmp_path / "none")
    assert search_watch.run(spark, str(tmp_path / "none"), str(tmp_path / "out3"), str(tmp_path / "mark3"), WATCH).count() == 0


def test_a_search_that_cannot_be_read_ends_the_stream(spark, tmp_path):
    write_docs(spark, [(1, "fish", "en")], tmp_path / "docs")
    args = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark")
    with pytest.raises(Exception, match="(?i)parenthesis"):
        search_watch.run(spark, *args, {**WATCH, "searches": {"x": "(fish"}})
    assert found(search_watch.run(spark, *args, WATCH)) == [(1, "b", "fish")]  # the batch that failed is still new


CONVERSATIONS = [
    (1, 0, "user", "Is it a cat?"), (1, 1, "x_bot", "I am a bot, and this text is long"), (1, 2, "assistant", "A long answer to the question, longer than all."), (1, 3, "user", "lol"),
    (2, 0, "user", "[deleted]"), (2, 1, "user", "lol"), (7, 0, "user", ""), (7, 1, "user", "# Some heading\nand see https://example.com/a/b?c for more"),
    (4, 1, "user", "an answer without its post, and long"), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, None, None), (800, 0, "user", "In the next month?"), (800, 1, "user", None),
]


def test_digest(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out = str(tmp_path / "conversations"), str(tmp_path / "out")
    spark.createDataFrame(CONVERSATIONS, TURNS).withColumn("place", F.lit("x")).write.parquet(source)
    rows = sorted(tuple(r) for r in thread_digest.run(spark, source, out, DIGEST).select("post_id", "place", "month", "text", "tokens", "used", "shown").collect())
    by_post = {}
    for post, place, month, text, tokens, used, shown in rows:
        by_post.setdefault(post, []).append((place, month, text))
        assert tokens == len(text) // 4 and used == sum(r[4] for r in rows if r[0] == post and r[1] < place) and shown == (used + tokens <= 30)
    assert [p for p, _, _ in by_post["c1"]][:1] == [0] and by_post["c1"][0][2] == "### Is it a cat?\nIs it a cat?"
    assert any("A long answer" in t for _, _, t in by_post["c1"]) and "c4" not in by_post and "c6" not in by_post
    assert any("> \\# Some heading\n> and see [example.com] for more" in t for _, _, t in by_post["c7"])
    assert {m for _, m, _ in by_post["c800"]} == {"2024-02"} and {p.name for p in Path(out).glob("month=*")} == {"month=2024-01", "month=2024-02"}
    assert any("read 14 turns" in m for m in caplog.messages) and any(m.startswith(f"wrote {len(rows)} rows") for m in caplog.messages)
    again = sorted(tuple(r) for r in thread_digest.run(spark, source, out, DIGEST).select("post_id", "place", "month", "text", "tokens", "used", "shown").collect())
    assert again == rows
    # what is gone from the input is gone from the output
    spark.createDataFrame([r for r in CONVERSATIONS if r[0] != 800], TURNS).write.parquet(str(tmp_path / "less"))
    thread_digest.run(spark, str(tmp_path / "less"), out, DIGEST)
    assert {p.name for p in Path(out).glob("month=*")} == {"month=2024-01"}
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "none"))
    assert thread_digest.run(spark, str(tmp_path / "none"), str(tmp_path / "out0"), DIGEST).count() == 0


@pytest.mark.parametrize("name", ["thread_digest", "search_watch"])
def test_command_line(spark, tmp_path, name):
    write_docs(spark, [(1, "of the cat", "en")], tmp_path / "documents")
    spark.createDataFrame(CONVERSATIONS, TURNS).write.parquet(str(tmp_path / "conversations"))
    args = ["--conversations", tmp_path / "conversations"] if name == "thread_digest" else ["--documents", tmp_path / "documents", "--checkpoint", tmp_path / "mark"]
    r = subprocess.run([sys.executable, "-m", f"jobs.{name}", *map(str, args), "--output", str(tmp_path / "out")], cwd=REPO, capture_output=True, text=True, timeout=280)
    assert r.returncode == 0, r.stderr[-2000:]
    assert f"jobs.{name} read" in r.stderr and list((tmp_path / "out").rglob("*.parquet"))
    json.loads((REPO / "jobs" / f"{name}.json").read_text())


def test_jobs_stand_alone():
    for path in [*(REPO / "jobs").glob("*.py"), Path(__file__)]:
        lines = path.read_text().splitlines()
        assert not [x for x in lines if x.startswith(("import", "from")) and ("llm" in x or "corpus_pipeline" in x)]
