"""Verdicts of a yes/no probability model on posts and threads, and what follows from them. A null verdict is a failure of the model: such
posts and threads are kept and listed, never dropped, so every condition here says what null means."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text
from quarry.operators import ordered

MAX_QUESTIONS, STRONG, MIN_LONE_CHARS, MIN_THREAD_CHARS = 7, 0.7, 300, 25


@dataclass(frozen=True)
class Questions:
    """One gate (must), content questions (q) and exclusions (nots), asked in this order."""

    q: tuple[str, ...]
    must: str | None = None
    nots: tuple[str, ...] = ()
    keep_at: float = 0.5
    must_at: float = 0.35
    not_at: float = 0.7

    def __post_init__(self):
        if not self.q or len(self.all) > MAX_QUESTIONS:
            raise ValueError(f"1 to {MAX_QUESTIONS} questions, one of content at least")

    @property
    def all(self) -> tuple[str, ...]:
        return ((self.must,) if self.must else ()) + self.q + self.nots


def post_verdict(probs: Column, qs: Questions) -> Column:
    """struct(must, q, not, score, excluded, keep) of an array of probabilities; null for null."""
    m = 1 if qs.must else 0
    must = F.element_at(probs, 1) if m else F.lit(None).cast("double")
    q = F.slice(probs, m + 1, len(qs.q))
    nots = F.slice(probs, m + len(qs.q) + 1, len(qs.nots)) if qs.nots else F.expr("cast(array() as array<double>)")
    excluded = F.when(F.coalesce(F.array_max(nots) >= qs.not_at, F.lit(False)), "not").when(F.coalesce(must < qs.must_at, F.lit(False)), "must")
    score = F.array_max(q)
    return F.when(probs.isNotNull(), F.struct(must.alias("must"), q.alias("q"), nots.alias("not"), score.alias("score"), excluded.alias("excluded"), (excluded.isNull() & (score >= qs.keep_at)).alias("keep")))


def thread_verdict(q: Column, post: Column, qs: Questions) -> Column:
    """A thread is asked the content questions only; the rest is its post's, and it can't be excluded."""
    return F.when(q.isNotNull(), F.struct(post["must"].alias("must"), q.alias("q"), F.coalesce(post["not"], F.expr("cast(array() as array<double>)")).alias("not"), F.array_max(q).alias("score"), F.lit(None).cast("string").alias("excluded"), (F.array_max(q) >= qs.keep_at).alias("keep")))


def combine_parts(parts: DataFrame, keys: list[str], keep_at: float) -> DataFrame:
    """keys, q: the greatest probability for each question over the parts (part, probs) of a thread, up to the first that reaches keep_at;
    null if a part up to there failed."""
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.array_max("probs")).over(w)
    seen = parts.withColumn("__before", before).where(F.coalesce(F.col("__before") < keep_at, F.lit(True)))
    failed = seen.groupBy(*keys).agg(F.bool_or(F.col("probs").isNull()).alias("__failed"))
    most = seen.select(*keys, F.posexplode("probs").alias("k", "x")).groupBy(*keys, "k").agg(F.max("x").alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("__q"))
    return failed.join(most, keys, "left").select(*keys, F.when(~F.col("__failed"), F.col("__q")).alias("q"))


def thread_sets(posts: DataFrame, threads: DataFrame, post_threshold: float = 0.2) -> DataFrame:
    """post_id, root, set of the threads to judge. posts: post_id, verdict (null: failed). threads: post_id, root, chars, has_hit. a: of posts
    kept or failed; b: of posts that score enough; c: with a comment that matched. None of excluded posts, none that is tiny."""
    rows = threads.where(F.col("chars") >= MIN_THREAD_CHARS).join(posts.select("post_id", "verdict"), "post_id")
    rows = rows.where(F.col("verdict.excluded").isNull())
    kind = F.when(F.col("verdict").isNull() | F.col("verdict.keep"), "a").when(F.col("verdict.score") >= post_threshold, "b").when(F.col("has_hit"), "c")
    return rows.select("post_id", "root", kind.alias("set")).where("set is not null")


def thread_order(jobs: DataFrame, posts: DataFrame) -> DataFrame:
    """jobs (post_id, root, set) with place: a before b before c, and in c the threads of the posts that score most first; else by post and root."""
    score = posts.select("post_id", F.coalesce("verdict.score", F.lit(0.0)).alias("__score"))
    rows = jobs.join(score, "post_id").withColumn("__score", F.when(F.col("set") == "c", F.col("__score")).otherwise(0.0))
    return ordered.running(rows, [F.col("set"), F.desc("__score"), F.col("post_id"), F.col("root")], {}).drop("__score")


def thread_summary(threads: DataFrame) -> DataFrame:
    """post_id, n_kept (keep or failed), n_kept_real (keep), q (greatest of kept threads for each question). threads: post_id, verdict."""
    kept = threads.where(F.col("verdict").isNull() | F.col("verdict.keep"))
    counts = kept.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count("verdict").alias("n_kept_real"))
    best = kept.where("verdict is not null").select("post_id", F.posexplode("verdict.q").alias("k", "x")).groupBy("post_id", "k").agg(F.max("x").alias("x"))
    best = best.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("thread_q"))
    return counts.join(best, "post_id", "left")


def included(judged: Column, verdict: Column, n_kept: Column, n_kept_real: Column) -> Column:
    """post, thread, unjudged or null."""
    some, real = F.coalesce(n_kept, F.lit(0)) > 0, F.coalesce(n_kept_real, F.lit(0)) > 0
    return (
        F.when(~judged, F.lit(None).cast("string")).when(verdict.isNull(), "unjudged").when(verdict["excluded"].isNotNull(), F.lit(None).cast("string"))
        .when(verdict["keep"], "post").when(real, "thread").when(some, "unjudged")
    )


def decided(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """posts (post_id, judged, verdict, ...) with included, facets (the best of post and kept threads for each question), facet_score (-1
    without any), n_kept and n_kept_real."""
    rows = posts.join(thread_summary(threads), "post_id", "left")
    both = F.when(F.col("verdict").isNull(), F.col("thread_q")).when(F.col("thread_q").isNull(), F.col("verdict.q")).otherwise(F.zip_with("verdict.q", "thread_q", lambda a, b: F.greatest(a, b)))
    rows = rows.withColumn("facets", both).withColumn("facet_score", F.coalesce(F.array_max("facets"), F.lit(-1.0)))
    rows = rows.withColumn("included", included(F.col("judged"), F.col("verdict"), F.col("n_kept"), F.col("n_kept_real")))
    return rows.withColumn("n_kept", F.coalesce("n_kept", F.lit(0))).withColumn("n_kept_real", F.coalesce("n_kept_real", F.lit(0))).drop("thread_q")


def kept_posts(rows: DataFrame) -> DataFrame:
    """Of decided(): those kept, with strong, but not lone ones: no kept thread and little text (selftext)."""
    kept = rows.where(F.col("included").isin("post", "thread"))
    return kept.where(~is_lone()).withColumn("strong", is_strong())


def is_lone() -> Column:
    return (F.col("n_kept") == 0) & (F.length("selftext") < MIN_LONE_CHARS)


def is_strong() -> Column:
    return (F.col("n_kept_real") > 0) | (F.col("facet_score") >= STRONG)


def borderline(verdicts: DataFrame) -> DataFrame:
    """id of the posts with a content probability of 0.3 to 0.7. verdicts: id, verdict."""
    return verdicts.where(F.exists("verdict.q", lambda x: (x >= 0.3) & (x <= 0.7))).select("id")


def flair_gate_skips(scored: DataFrame, min_posts: int = 300, samples: tuple[int, ...] = (40, 60)) -> DataFrame:
    """id, sub, flair of the posts that the gate skips, given which posts would be kept. scored: id, sub, link_flair, kept. Flairs with over
    min_posts are sampled in stable order; one without a keep in all samples is skipped beyond them."""
    rows = scored.withColumn("flair", text.flair_name(F.col("link_flair"))).where("flair <> ''")
    big = rows.groupBy("sub", "flair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_posts)
    rank = F.row_number().over(Window.partitionBy("sub", "flair").orderBy(F.sha1("id"), "id"))
    ranked = rows.join(big, ["sub", "flair"]).withColumn("rank", rank)
    failed = ranked.where(F.col("rank") <= sum(samples)).groupBy("sub", "flair").agg(F.bool_or("kept").alias("any")).where("not any")
    return ranked.where(F.col("rank") > sum(samples)).join(failed, ["sub", "flair"], "left_semi").select("id", "sub", "flair")


def question_counts(kept: DataFrame, qs: Questions) -> DataFrame:
    """question (from 1), n_pass, n_only: kept posts whose facet passes, and that pass by this one only."""
    rows = kept.select(F.posexplode("facets").alias("k", "x"), F.size(F.filter("facets", lambda x: x >= qs.keep_at)).alias("n")).where(F.col("x") >= qs.keep_at)
    return rows.groupBy((F.col("k") + 1).alias("question")).agg(F.count(F.lit(1)).alias("n_pass"), F.count(F.when(F.col("n") == 1, 1)).alias("n_only"))


def exclusion_counts(judged: DataFrame, qs: Questions) -> DataFrame:
    """n_must, n_not by reason and not_1, ... for each exclusion by itself."""
    each = [F.count(F.when(F.element_at("verdict.not", k + 1) >= qs.not_at, 1)).alias(f"not_{k + 1}") for k in range(len(qs.nots))]
    return judged.agg(F.count(F.when(F.col("verdict.excluded") == "must", 1)).alias("n_must"), F.count(F.when(F.col("verdict.excluded") == "not", 1)).alias("n_not"), *each)


def set_counts(threads: DataFrame) -> DataFrame:
    """set, judged, kept. threads: set, verdict."""
    return threads.groupBy("set").agg(F.count(F.lit(1)).alias("judged"), F.count(F.when(F.col("verdict").isNull() | F.col("verdict.keep"), 1)).alias("kept"))


def query_table(hits: DataFrame, judged: DataFrame, kept: DataFrame, new_strong: DataFrame) -> DataFrame:
    """query, hits, judged, kept, only, new_strong. hits: id, query."""
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    rows = hits.join(n, "id").join(flag(judged, "__j"), "id", "left").join(flag(kept, "__k"), "id", "left").join(flag(new_strong, "__s"), "id", "left")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.count("__j").alias("judged"), F.count("__k").alias("kept"), F.count(F.when(F.col("__k") & (F.col("__n") == 1), 1)).alias("only"), F.count(F.when(F.col("__k") & F.col("__s"), 1)).alias("new_strong"))


def kept_by_flair(judged: DataFrame, kept: DataFrame, top: int = 15) -> DataFrame:
    """flair, n_judged, n_kept of the flairs with most judged posts."""
    name = text.flair_name(F.col("link_flair"))
    rows = judged.join(kept.select("id").distinct().withColumn("__k", F.lit(1)), "id", "left").groupBy(F.when(name == "", "(no flair)").otherwise(name).alias("flair"))
    return rows.agg(F.count(F.lit(1)).alias("n_judged"), F.count("__k").alias("n_kept")).orderBy(F.desc("n_judged"), "flair").limit(top)


def histogram(rows: DataFrame, score: str) -> DataFrame:
    """bin (0 to 9), n: tenths, 1.0 in the last; all bins are there."""
    spark = rows.sparkSession
    counted = rows.where(F.col(score).isNotNull()).groupBy(F.least((F.col(score) * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_drops(rows: DataFrame, n: int = 20) -> DataFrame:
    """Judged posts that aren't included, best first."""
    return rows.where("judged and verdict is not null and included is null").orderBy(F.desc("verdict.score"), "id").limit(n)


def same_author(kept: DataFrame, n: int = 3) -> DataFrame:
    """id, others: the first n other kept posts (rank) of the same author; gone authors have none. An author with very many kept posts needs
    only the first n + 1 in the list."""
    first = Window.partitionBy("author").orderBy("rank")
    named = kept.where(~text.is_gone(F.col("author")))
    firsts = named.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= n + 1).groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s.id).alias("__ids"))
    rows = kept.join(firsts, "author", "left")
    return rows.select("id", F.slice(F.filter(F.coalesce("__ids", F.expr("cast(array() as array<string>)")), lambda x: x != F.col("id")), 1, n).alias("others"))


def recall_estimate(judged: DataFrame, n_missed: int) -> DataFrame:
    """rate, expected: the kept share of the judged sample of missed posts, and what that makes of all."""
    return judged.agg((F.count(F.when(F.col("kept"), 1)) / F.count(F.lit(1))).alias("rate")).select("rate", (F.col("rate") * n_missed).alias("expected"))


def zero_kept_bound(n: Column, skipped: Column) -> tuple[Column, Column]:
    """The rule of three for n samples without a keep: percent at most, and how many of the skipped that may be."""
    return F.lit(300) / n, F.ceil(skipped * 3 / n)
