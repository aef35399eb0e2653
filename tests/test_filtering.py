"""Filter runs with a scripted model, against the same run written as plain loops."""

import hashlib
import re
from collections import Counter

import pytest

from quarry.operators import verdicts
from quarry.plans import filtering

QS = verdicts.Questions(q=("a", "b"), must="m", nots=("n",))


class Scripted:
    """Answers by a digest, as far as the log says; the log of calls is a file. It fails on states with a hash sign, and gives up the run
    after so many calls."""

    name = "scripted"

    def __init__(self, log, most=None):
        self.log, self.most = str(log), most

    def score(self, state, questions):
        with open(self.log, "a+") as f:
            f.seek(0)
            if self.most is not None and sum(1 for _ in f) >= self.most:
                raise RuntimeError("stopped")
            f.write(f"{state}\t{len(questions)}\n")
        return answer(state, questions)

    def calls(self):
        with open(self.log) as f:
            return [line.rstrip("\n") for line in f]


def answer(state, questions):
    if "#" in state:
        return None, False
    return [hashlib.sha1(f"{q}{state}".encode()).digest()[0] / 255 for q in questions], "~" in state


POSTS = [(f"p{i}", "s", ("Big" if i % 3 else "Other") if i % 7 else None, f"post {i}" + ("#" if i in (5, 31) else "~" if i == 8 else "")) for i in range(60)]
PARTS = [(f"p{i}", f"r{i}{t}", k, f"thread {i} {t} {k}" + ("#" if (i, t, k) in ((4, 0, 2), (9, 1, 1)) else ""), 10 if i == 12 else 50, i % 2 == 0) for i in range(60) for t in range(2) for k in range(1, 2 + (i + t) % 3)]
PARTS += [("p1", "same", 1, "thread 0 0 1", 50, False)]


def by_loops(min_posts, samples):
    """included by post, verdict scores by thread, skipped posts, and the questions asked about each state."""
    asked, posts, threads = Counter(), {}, {}

    def ask(state, qs):
        asked[f"{state}\t{len(qs)}"] += 1
        return answer(state, qs)[0]

    def judge(ids):
        for i, _, _, state in POSTS:
            if i in ids and i not in posts:
                p = ask(state, QS.all)
                posts[i] = p and {"q": p[1:3], "score": max(p[1:3]), "excluded": "not" if p[3] >= 0.7 else "must" if p[0] < 0.35 else None}
                v = posts[i]
                if v:
                    v["keep"] = v["excluded"] is None and v["score"] >= 0.5
                for root in dict.fromkeys(r for pid, r, *_ in PARTS if pid == i):
                    mine = [x for x in PARTS if x[:2] == (i, root)]
                    if v and (v["excluded"] or not (v["keep"] or v["score"] >= 0.2 or mine[0][5])) or mine[0][4] < 25:
                        continue
                    best = None
                    for x in mine:
                        p = ask(x[3], QS.q)
                        best = p and [max(a, b) for a, b in zip(best or p, p)]
                        if best is None or max(best) >= 0.5:
                            break
                    threads[i, root] = best and round(max(best), 4)

    def included(i):
        v = posts[i]
        if v is None:
            return "unjudged"
        if v["excluded"]:
            return None
        kept = [t for (p, _), t in threads.items() if p == i and (t is None or t >= 0.5)]
        return "post" if v["keep"] else "thread" if any(t is not None for t in kept) else "unjudged" if kept else None

    skipped = set()
    for flair in ("Big", "Other"):
        ids = sorted((i for i, _, f, _ in POSTS if f == flair), key=lambda i: hashlib.sha1(i.encode()).hexdigest())
        if len(ids) > min_posts:
            n = 0
            for size in samples:
                judge(ids[n : n + size])
                n += size
                if any(included(i) for i in ids[:n]):
                    break
            else:
                skipped |= set(ids[n:])
    judge([i for i, *_ in POSTS if i not in skipped])
    return {i: included(i) if i in posts else "skipped" for i, *_ in POSTS}, threads, skipped, asked


def frames(spark, qs=QS):
    posts = spark.createDataFrame(POSTS, "id string, sub string, link_flair string, state string")
    parts = spark.createDataFrame(PARTS, "post_id string, root string, part int, state string, chars int, has_hit boolean")
    return posts, parts


@pytest.mark.parametrize("samples", [(2, 3), (1,), (1, 1)])
def test_as_by_loops(spark, tmp_path, samples):
    posts, parts = frames(spark)
    scorer = Scripted(tmp_path / "log")
    out = filtering.FilterRun(posts, parts, QS, filtering.Answers(spark, scorer, str(tmp_path / "answers"), wave=20)).run(min_posts=10, samples=samples)
    included, threads, skipped, asked = by_loops(10, samples)
    assert {r.id: r.included if r.judged else "skipped" for r in out.posts.collect()} == included
    assert {(r.post_id, r.root): r.verdict and round(r.verdict.score, 4) for r in out.threads.collect()} == threads
    assert {r.id for r in out.skipped.collect()} == skipped
    # each state once, none of a skipped post
    assert Counter(scorer.calls()) == Counter(set(asked))


def test_a_gate_without_keeps_spares_the_rest(spark, tmp_path):
    posts, parts = frames(spark)
    hard = verdicts.Questions(q=("a", "b"), must="m", nots=("n",), must_at=1.1)  # everything is excluded
    scorer = Scripted(tmp_path / "log")
    out = filtering.FilterRun(posts.where("state not like '%#'"), parts, hard, filtering.Answers(spark, scorer, str(tmp_path / "answers"))).run(min_posts=10, samples=(2, 3))
    gone = {r.id for r in out.skipped.collect()}
    big = [p for p in POSTS if p[2] and "#" not in p[3]]
    assert len(gone) == len(big) - 10 and len(scorer.calls()) == sum("#" not in p[3] for p in POSTS) - len(gone)
    assert not {p[3] for p in POSTS if p[0] in gone} & {c.split("\t")[0] for c in scorer.calls()}
    out = filtering.FilterRun(posts, parts, hard, filtering.Answers(spark, scorer, str(tmp_path / "answers"))).run(min_posts=10, samples=(2, 3), all_flairs=True)
    assert out.skipped.count() == 0 and out.posts.where("not judged").count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    posts, parts = frames(spark)
    path, log = str(tmp_path / "answers"), tmp_path / "log"
    stopped = filtering.Answers(spark, Scripted(log, most=45), path, workers=1, wave=10)
    with pytest.raises(Exception, match="stopped"):
        filtering.FilterRun(posts, parts, QS, stopped).run(min_posts=10, samples=(2, 3))
    written = {r.key for r in spark.read.parquet(f"{path}/answers").where("probs is not null and not shortened").collect()}
    assert 20 <= len(written) <= 45
    log2 = tmp_path / "log2"
    out = filtering.FilterRun(posts, parts, QS, filtering.Answers(spark, Scripted(log2), path, wave=10)).run(min_posts=10, samples=(2, 3))
    included, _, _, asked = by_loops(10, (2, 3))
    assert {r.id: r.included if r.judged else "skipped" for r in out.posts.collect()} == included
    again = Counter(Scripted(log2).calls())
    assert max(again.values()) == 1 and sum(again.values()) == len(asked) - len(written)
    # a third run asks about failures and shortened states alone
    log3 = tmp_path / "log3"
    filtering.FilterRun(posts, parts, QS, filtering.Answers(spark, Scripted(log3), path)).run(min_posts=10, samples=(2, 3))
    assert set(Scripted(log3).calls()) == {a for a in asked if "#" in a or "~" in a}


def test_a_model_that_is_down_ends_the_run(spark, tmp_path):
    posts = spark.createDataFrame([(f"p{i}", "s", None, f"x{i}#") for i in range(8)], "id string, sub string, link_flair string, state string")
    with pytest.raises(RuntimeError, match="fails"):
        filtering.FilterRun(posts, frames(spark)[1], QS, filtering.Answers(spark, Scripted(tmp_path / "log"))).run()


def test_a_wave_reads_its_own_states(spark, tmp_path, monkeypatch):
    """Of 8 waves none reads the states of another or the answers before it: what a run reads grows with its states, not with their square."""
    states = spark.range(2_000).selectExpr("concat('s', id) as state")
    answers = filtering.Answers(spark, Scripted(tmp_path / "log"), wave=250)
    waves, tables, append, table = [], [], answers.store.append, answers.store.read

    def appended(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        waves.extend(re.findall(r"PartitionFilters: \[[^\]]*\(__wave#\d+ = (\d+)\)", plan))
        append(df, name)

    monkeypatch.setattr(answers.store, "append", appended)
    monkeypatch.setattr(answers.store, "read", lambda *a: tables.append(a) or table(*a))
    answers.ask(states, ["a"])
    assert sorted(waves) == [str(w) for w in range(8)] and len(tables) == 1
    assert len(set(Scripted(tmp_path / "log").calls())) == 2_000 == answers.table().count() == answers.calls
