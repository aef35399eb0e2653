"""A filter run: a probability model asked about posts and their threads in stages, each of which reads what the one before decided.

    the flair gate    flairs with many posts are sampled first, and the rest of a flair without a keep is never asked about
    posts             every other post is asked all questions
    threads           of posts kept or nearly kept, and those with a comment that matched, are asked the content questions, part by part,
                      until a part says yes

Answers go to a table in waves as they come. A run that is stopped and started again over the same table asks only what isn't answered
there, so at most the states of the wave under way are asked twice. Failures and answers about shortened states count for their run only.
"""

import math
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from quarry.functions import text
from quarry.operators import verdicts
from quarry.plans.scoring import memo_key
from quarry.stored import Stored

#: States asked before their answers are written.
WAVE = 5_000
ANSWERS = "key string, probs array<double>, shortened boolean, run string, at timestamp"


class Answers:
    """The answers of one scorer, kept below a path. workers bounds the calls under way."""

    def __init__(self, spark: SparkSession, scorer, path: str | None = None, workers: int = 6, wave: int = WAVE):
        self.spark, self.scorer, self.workers, self.wave, self.run = spark, scorer, workers, wave, uuid.uuid4().hex
        self.store, self.work = Stored(spark, "answers", path), Stored(spark, "asking")
        self.calls = self.failed = 0

    def table(self) -> DataFrame:
        """key, probs of what is known: the latest answer that may be remembered, else one of this run."""
        rows = self.store.read("answers", ANSWERS).withColumn("lasting", F.col("probs").isNotNull() & ~F.col("shortened"))
        rows = rows.where(F.col("lasting") | (F.col("run") == self.run))
        return rows.groupBy("key").agg(F.max_by("probs", F.struct("lasting", "at", "run")).alias("probs"))

    def keyed(self, rows: DataFrame, questions: list[str]) -> DataFrame:
        return rows.withColumn("__key", memo_key(self.scorer.name, questions, F.col("state")))

    def ask(self, rows: DataFrame, questions: list[str]) -> None:
        """Asks about the states of rows that have no answer yet, each once. They are written by wave, so a wave reads its own rows alone."""
        known = self.table().select(F.col("key").alias("__key"))
        misses = self.work.save(self.keyed(rows.select("state"), questions).dropDuplicates(["__key"]).join(known, "__key", "left_anti"))
        waves, scorer, run = math.ceil(misses.count() / self.wave), self.scorer, self.run
        if waves > 1:
            misses = self.work.save(misses.withColumn("__wave", F.pmod(F.xxhash64("__key"), F.lit(waves)).cast("int")).repartition("__wave"), by="__wave")

        def score(batches):
            for x in batches:
                got = [scorer.score(s, questions) for s in x.state]
                yield pd.DataFrame({"key": x["__key"], "probs": pd.Series([p for p, _ in got], dtype=object), "shortened": [s for _, s in got]})

        for w in range(waves):
            part = misses.where(F.col("__wave") == w) if waves > 1 else misses
            asked = part.select("__key", "state").repartition(self.workers).mapInPandas(score, "key string, probs array<double>, shortened boolean")
            seen = Observation()
            asked = asked.select("key", "probs", "shortened", F.lit(run).alias("run"), F.current_timestamp().alias("at"))
            self.store.append(asked.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("probs").isNull(), 1)).alias("failed")), "answers")
            self.check(seen.get["n"], seen.get["failed"])

    def check(self, n: int, failed: int) -> None:
        """Over 5 failures and over 2 % in this run mean that the model is down. What was answered stays. n, failed: of the last wave."""
        self.calls, self.failed = self.calls + n, self.failed + failed
        if self.failed > max(5, 0.02 * self.calls):
            raise RuntimeError(f"the model fails: {self.failed} of {self.calls} calls")

    def answered(self, rows: DataFrame, questions: list[str]) -> DataFrame:
        """rows (state, ...) with probs, after asking what isn't known; null: failed."""
        self.ask(rows, questions)
        return self.keyed(rows, questions).join(self.table().withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


@dataclass
class Outcome:
    """posts: every post with judged, verdict, included, facets, facet_score, n_kept and n_kept_real; threads: post_id, root, set, verdict
    of the threads that were judged; skipped: id, sub, flair of the posts that the gate spared."""

    posts: DataFrame
    threads: DataFrame
    skipped: DataFrame


class FilterRun:
    """posts: id, sub, link_flair, state, ...; parts: post_id, root, part (from 1 without gaps), state, chars and has_hit of the thread."""

    def __init__(self, posts: DataFrame, parts: DataFrame, questions: verdicts.Questions, answers: Answers, post_threshold: float = 0.2):
        self.posts, self.qs, self.answers, self.post_threshold = posts, questions, answers, post_threshold
        self.work = Stored(posts.sparkSession, "filter")
        self.parts = self.work.save(parts.join(parts.groupBy("post_id", "root").agg(F.max("part").alias("n_parts")), ["post_id", "root"]))
        self.judged: list[DataFrame] = []
        self.threads: list[DataFrame] = []

    def union(self, tables: list[DataFrame], schema) -> DataFrame:
        out = tables[0] if tables else self.posts.sparkSession.createDataFrame([], schema)
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def stage(self, batch: DataFrame) -> None:
        """Judges posts (id), then their threads."""
        todo = self.posts.select("id", "state").join(batch.select("id").distinct(), "id", "left_semi")
        probs = self.answers.answered(todo, list(self.qs.all))
        posts = self.work.save(probs.select(F.col("id").alias("post_id"), verdicts.post_verdict(F.col("probs"), self.qs).alias("verdict")))
        self.judged.append(posts)
        threads = self.parts.where("part = 1").select("post_id", "root", "chars", "has_hit")
        self.threads.append(self.judge_threads(posts, verdicts.thread_sets(posts, threads, self.post_threshold)))

    def judge_threads(self, posts: DataFrame, jobs: DataFrame) -> DataFrame:
        """post_id, root, set, verdict. Part after part is asked about; a thread ends with the part that fails or says yes."""
        open_ = self.work.save(jobs.select("post_id", "root", "set", F.lit(None).cast("array<double>").alias("best")))
        part, ended = 1, []
        while not open_.isEmpty():
            rows = open_.join(self.parts.where(F.col("part") == part).select("post_id", "root", "state", "n_parts"), ["post_id", "root"])
            got = self.answers.answered(rows, list(self.qs.q))
            best = F.when(F.col("best").isNull() | F.col("probs").isNull(), F.col("probs")).otherwise(F.zip_with("best", "probs", lambda a, b: F.greatest(a, b)))
            goes_on = F.coalesce(F.array_max(best) < self.qs.keep_at, F.lit(False)) & (F.col("n_parts") > part)
            got = self.work.save(got.select("post_id", "root", "set", best.alias("best"), goes_on.alias("open")))
            ended.append(got.where("not open").drop("open"))
            open_, part = got.where("open").drop("open"), part + 1
        done = self.union(ended, open_.schema)
        post = posts.select("post_id", F.col("verdict").alias("post_verdict"))
        return self.work.save(done.join(post, "post_id").select("post_id", "root", "set", verdicts.thread_verdict(F.col("best"), F.col("post_verdict"), self.qs).alias("verdict")))

    def decided(self) -> DataFrame:
        """All posts that were judged so far, with what they come to."""
        posts = self.union(self.judged, "post_id string")
        return verdicts.decided(posts.withColumn("judged", F.lit(True)), self.union(self.threads, "post_id string").select("post_id", "verdict"))

    def gate(self, min_posts: int, samples: tuple[int, ...]) -> DataFrame:
        """Samples the flairs with over min_posts posts, in stable order and one sample after another, until a post of them is included.
        id, sub, flair of the posts beyond all samples of the flairs of which none is."""
        rows = self.posts.select("id", "sub", text.flair_name(F.col("link_flair")).alias("flair")).where("flair <> ''")
        rank = F.row_number().over(Window.partitionBy("sub", "flair").orderBy(F.sha1("id"), "id"))
        big = rows.groupBy("sub", "flair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_posts).select("sub", "flair")
        # a limit of ranks is applied within each task before rows of a flair meet
        first = self.work.save(rows.withColumn("rank", rank).where(F.col("rank") <= sum(samples)).join(big, ["sub", "flair"], "left_semi"))
        pending, n = self.work.save(first.select("sub", "flair").distinct()), 0
        for size in samples:
            if pending.isEmpty():
                break
            sample = first.where((F.col("rank") > n) & (F.col("rank") <= n + size)).join(pending, ["sub", "flair"], "left_semi")
            self.stage(sample)
            n += size
            kept = self.decided().where("included is not null").select(F.col("post_id").alias("id"))
            pending = self.work.save(pending.join(first.join(kept, "id", "left_semi"), ["sub", "flair"], "left_anti"))
        beyond = rows.join(pending, ["sub", "flair"], "left_semi").join(first.select("id"), "id", "left_anti")
        return self.work.save(beyond.select("id", "sub", "flair"))

    def run(self, min_posts: int = 300, samples: tuple[int, ...] = (40, 60), all_flairs: bool = False) -> Outcome:
        skipped = self.posts.select("id", "sub", F.lit("").alias("flair")).limit(0) if all_flairs else self.gate(min_posts, samples)
        rest = self.posts.select("id").join(skipped.select("id"), "id", "left_anti")
        if self.judged:
            rest = rest.join(self.union(self.judged, "").select(F.col("post_id").alias("id")), "id", "left_anti")
        self.stage(rest)
        found = self.decided().withColumnRenamed("post_id", "id")
        posts = self.posts.join(found, "id", "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
        return Outcome(posts, self.union(self.threads, ""), skipped)
