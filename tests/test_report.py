"""Reports against the same text written by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import verdicts
from quarry.plans import report
from quarry.plans.filtering import Outcome

QS = verdicts.Questions(q=("first", "second"), must="about it", nots=("adverts",))
POST = "id string, pid long, sub string, link_flair string, title string, selftext string, author string, score long, created long, url string, probs array<double>"


def made(spark, n=40, seed=1):
    r = random.Random(seed)
    posts, threads, texts = [], [], []
    for i in range(n):
        probs = None if i % 17 == 3 else [r.random() * 0.5 + 0.4, *(r.choice([0.1, 0.6, 0.9]) for _ in range(2)), r.choice([0.1, 0.1, 0.8])]
        words = " ".join(r.choice(["word", "# mark", "longer-word", "\n> quote"]) for _ in range(r.choice([0, 3, 60, 400])))
        posts.append((f"p{i:02}", i, "sub", r.choice([None, ":x: Big", "Small"]), f"Title {i}", words, r.choice(["ann", "bob", "[deleted]"]), r.randint(0, 3), 1704067200 + i * 86400, r.choice(["", "https://example.com/a", "https://i.redd.it/x"]), probs))
        for t in range(r.randint(0, 4)):
            q = r.choice([None, [0.7, 0.2], [0.1, 0.1]])
            threads.append((f"p{i:02}", f"r{t}", "abc"[t % 3], q))
            texts.append((f"p{i:02}", f"r{t}", t, r.randint(1, 5), "\n".join("> " + "x" * r.randint(1, 60) for _ in range(r.choice([1, 5, 30])))))
    p = spark.createDataFrame(posts, POST).withColumn("verdict", verdicts.post_verdict(F.col("probs"), QS)).withColumn("judged", F.lit(True))
    t = spark.createDataFrame(threads, "post_id string, root string, set string, q array<double>")
    t = t.join(p.select(F.col("id").alias("post_id"), F.col("verdict").alias("pv")), "post_id").select("post_id", "root", "set", verdicts.thread_verdict(F.col("q"), F.col("pv"), QS).alias("verdict"))
    decided = verdicts.decided(p.withColumnRenamed("id", "post_id"), t).withColumnRenamed("post_id", "id")
    skipped = spark.createDataFrame([], "id string, sub string, flair string")
    return Outcome(decided, t, skipped), spark.createDataFrame(texts, "post_id string, root string, place int, n_comments int, text string"), posts, threads, texts


def escaped(t):
    return "\n".join("\\" + x if x.lstrip().startswith(("#", ">")) else x for x in t.split("\n"))


def entry(row, kept_threads, others, cap):
    kind = "image" if "i.redd.it" in row["url"] else ""
    flair = (row["link_flair"] or "").replace(":x: ", "")
    matched = [f"Q{k} {x:.2f}" for x, k in sorted(((x, k) for k, x in enumerate(row["facets"], 1) if x >= 0.5), key=lambda s: (-s[0], s[1]))]
    day = f"2024-{'01' if row['pid'] < 31 else '02'}-{row['pid'] % 31 + 1:02}"
    meta = [f"r/{row['sub']}", *([flair] if flair else []), day, f"score {row['score']}", f"kept comments {sum(t[3] for t in kept_threads)}", *([f"matched {', '.join(matched)}"] if matched else []), *([f"{kind} post"] if kind else []), *(["via thread"] if row["included"] == "thread" else []), *([f"same author as {', '.join(others)}"] if others else []), f"https://www.reddit.com/r/{row['sub']}/comments/{row['id']}/"]
    out = f"\n---\n\n## P{row['pid']} · {row['title']}\n" + " · ".join(meta) + "\n\n"
    if row["url"] and not kind:
        out += f"Link: {row['url']}\n\n"
    body = escaped(row["selftext"])
    if len(body) > cap // 2:
        cut = body[: cap // 2].rsplit(" ", 1)[0]
        body = f"{cut}\n\n_[{len(body) - len(cut)} more characters]_"
    out += body + "\n\n" if body else ""
    n = 0
    for t in kept_threads:
        room = cap - len(out)
        if len(t[4]) > room:
            if n == 0 and room > 500:
                out += t[4][:room].rsplit("\n", 1)[0] + "\n\n_[thread cut]_\n\n"
                n = 1
            break
        out += t[4] + "\n\n"
        n += 1
    return out + (f"_{len(kept_threads) - n} more kept threads_\n\n" if n < len(kept_threads) else "")


@pytest.mark.parametrize("budget", [600, 4000, 100_000])
def test_entries_and_budget(spark, budget):
    outcome, texts, _, threads, text_rows = made(spark)
    hits = outcome.posts.select("id", F.lit("a|b").alias("query"))
    got = report.report(outcome, texts, hits, QS, budget=budget)
    rows = {r.id: r.asDict() for r in outcome.posts.collect()}
    kept = sorted((r for r in rows.values() if r["included"] in ("post", "thread") and not (r["n_kept"] == 0 and len(r["selftext"]) < 300)), key=lambda r: (-r["facet_score"], -r["score"], r["id"]))
    alive = {(p, r) for p, r, _, q in threads if q is None or max(q) >= 0.5}
    cap, want, lines = budget * 4 // 10, [], []
    for k, r in enumerate(kept):
        mine = [t for t in text_rows if t[0] == r["id"] and (t[0], t[1]) in alive]
        others = [o["id"] for o in kept if o["author"] == r["author"] and o["id"] != r["id"]][:3] if r["author"] != "[deleted]" else []
        want.append(entry(r, mine, others, cap))
        lines.append(f"- P{r['pid']} · {r['facet_score']:.2f} · {r['title']} · {r['n_kept']} kept threads")
    used, shown = sum(len(x) + 1 for x in got.head) // 4, 0
    for k, e in enumerate(want):
        if k and used + (len(e) + sum(len(x) + 1 for x in lines[k + 1 :])) // 4 > budget:
            break
        used, shown = used + len(e) // 4, k + 1
    table = {r.rank: r for r in got.entries.collect()}
    assert [table[k + 1].id for k in range(len(kept))] == [r["id"] for r in kept]
    assert [table[k + 1].entry for k in range(shown)] == want[:shown] and all(table[k + 1].entry is None for k in range(shown, len(kept)))
    assert got.lines() == [*got.head, *want[:shown], *(["\n---\n\n## Also kept, over the budget\n", *lines[shown:]] if shown < len(kept) else [])]
    assert shown == len(kept) or budget < 100_000
    said = "\n".join(got.head)
    assert f"{len(kept):,}" in said and "| a/b |" in said and f"Q1: first (kept {sum(r['facets'][0] >= 0.5 for r in kept)}," in said


def test_verdict_rows_and_files(spark, tmp_path):
    outcome, texts, posts, threads, _ = made(spark, 12)
    skipped = spark.createDataFrame([("p01", "sub", "Big")], "id string, sub string, flair string")
    rows = {r.id: r for r in report.verdict_rows(Outcome(outcome.posts, outcome.threads, skipped)).collect()}
    assert len(rows) == 12 and [i for i, r in rows.items() if r.flair_skipped] == ["p01"]
    for i, *_ in posts:
        assert [(t.root, t.set, t.verdict is None) for t in rows[i].threads] == [(r, s, q is None) for p, r, s, q in threads if p == i]
    made_report = report.report(outcome, texts, outcome.posts.select("id", F.lit("q").alias("query")), QS, previous=outcome.posts.select("id"))
    report.write_report(spark, made_report, str(tmp_path / "r"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == "\n".join(made_report.lines())
    assert "| 12 | 12 |" in "\n".join(made_report.head) and next(x for x in made_report.head if x.endswith("| q |")).split(" | ")[4] == "0"


def test_listing_of_very_many(spark):
    rows = spark.range(1, 1301).selectExpr("concat('p', id) as id", "id as pid", "cast(id as int) as rank", "id = 1 as shown", "if(id = 1, 'ENTRY', null) as entry", "concat('- P', id) as listed")
    lines = report.Report(rows, ["head"]).lines()
    assert lines[:2] == ["head", "ENTRY"] and lines[3:103] == [f"- P{k}" for k in range(2, 102)]
    assert lines[103] == "\nAlso kept, by score: " + ", ".join(f"P{k}" for k in range(102, 1102)) + " and 199 more" and len(lines) == 104
