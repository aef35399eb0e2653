"""Trying the questions of a filter before the whole run: a sample is judged, and every probability is shown."""

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import dates, text
from quarry.operators import forest, hits, verdicts
from quarry.plans.filtering import Answers, FilterRun, Outcome
from quarry.stored import Stored

#: Threads shown of each post, and seconds an item takes from a busy and from a quiet server.
THREADS_SHOWN, BUSY, QUIET = 4, 1 / 15, 1 / 300


def probabilities(verdict: Column, qs: verdicts.Questions, thread: bool = False) -> Column:
    """[Must 0.40 | Q1 0.50 Q2 0.60 | Not1 0.10]; a thread has the content questions only."""
    number = lambda x: F.format_string("%.2f", x)
    each = lambda label, c: F.array_join(F.transform(c, lambda x, k: F.concat(F.lit(label), (k + 1).cast("string"), F.lit(" "), number(x))), " ")
    parts = [each("Q", verdict["q"])]
    if not thread:
        parts = ([F.concat(F.lit("Must "), number(verdict["must"]))] if qs.must else []) + parts + ([each("Not", verdict["not"])] if qs.nots else [])
    return F.when(verdict.isNull(), "[failed]").otherwise(F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]")))


def decision(included: Column, verdict: Column) -> Column:
    said = F.when(included == "post", "KEEP").when(included == "thread", "KEEP via thread").when(included == "unjudged", "UNJUDGED").otherwise("drop")
    return F.when(verdict["excluded"].isNotNull(), F.concat(F.lit("EXCLUDED by "), verdict["excluded"])).otherwise(said)


def dry_run(picked: DataFrame, posts: DataFrame, parts: DataFrame, qs: verdicts.Questions, answers: Answers, post_threshold: float = 0.2) -> tuple[DataFrame, Outcome]:
    """Judges the picked posts (id, label) and their threads. posts, parts: as for a FilterRun. Returns label, id, decision, probs, threads (the
    best four, failed ones first: root, set, probs, kept), n_threads and n_kept; and the outcome.

    A run reads its posts and parts in each of its steps. Those of the picked posts are written first, so no step reads the others again or
    picks anew."""
    work = Stored(posts.sparkSession, "dry-run")
    picked = work.save(picked.select("id", "label"))
    mine = work.save(posts.join(picked.select("id"), "id", "left_semi"))
    threads = work.save(parts.join(mine.select(F.col("id").alias("post_id")), "post_id", "left_semi"))
    outcome = FilterRun(mine, threads, qs, answers, post_threshold).run(all_flairs=True)
    kept = F.col("verdict").isNull() | F.col("verdict.keep")
    order = F.struct((-F.coalesce("verdict.score", F.lit(2.0))).alias("by"), "root", "set", probabilities(F.col("verdict"), qs, True).alias("probs"), kept.alias("kept"))
    first = F.row_number().over(verdicts.Window.partitionBy("post_id").orderBy(F.desc(F.coalesce("verdict.score", F.lit(2.0))), "root"))
    best = outcome.threads.withColumn("__n", first).groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("__n") <= THREADS_SHOWN, order))).alias("threads"), F.count(F.lit(1)).alias("n_threads"), F.count(F.when(kept, 1)).alias("n_threads_kept"))
    rows = picked.select("id", "label").join(outcome.posts, "id").join(best, "id", "left")
    shown = F.transform("threads", lambda t: F.struct(t.root.alias("root"), t.set.alias("set"), t.probs.alias("probs"), t.kept.alias("kept")))
    return rows.select("label", "id", decision(F.col("included"), F.col("verdict")).alias("decision"), probabilities(F.col("verdict"), qs).alias("probs"), shown.alias("threads"), F.coalesce("n_threads", F.lit(0)).alias("n_threads"), F.coalesce("n_threads_kept", F.lit(0)).alias("n_kept")), outcome


def dry_run_totals(outcome: Outcome, qs: verdicts.Questions) -> DataFrame:
    """n, kept, via, must_only (would pass but for the gate question), excluded (by an exclusion) and only_1, ... (kept by one question alone)."""
    kept = F.col("included").isNotNull()
    passing = F.filter("facets", lambda x: x >= qs.keep_at)
    only = [F.count(F.when(kept & (F.size(passing) == 1) & (F.element_at("facets", k) >= qs.keep_at), 1)).alias(f"only_{k}") for k in range(1, len(qs.q) + 1)]
    count = lambda c: F.count(F.when(c, 1))
    return outcome.posts.where("judged").agg(F.count(F.lit(1)).alias("n"), count(kept).alias("kept"), count(F.col("included") == "thread").alias("via"), count((F.col("verdict.excluded") == "must") & (F.col("verdict.score") >= qs.keep_at)).alias("must_only"), count(F.col("verdict.excluded") == "not").alias("excluded"), *only)


def show(posts: DataFrame, comments: DataFrame, refs: list[str]) -> DataFrame:
    """n, ref, id, text of the posts that refs name (P-numbers or ids), in that order: each with all of its comments as threads. A ref that
    names nothing has a null id. Only the comments of those posts are read in order."""
    found = None
    for n, ref in enumerate(refs, 1):
        one = hits.find_post(posts, ref).select(F.lit(n).alias("n"), F.lit(ref).alias("ref"), *posts.columns)
        found = one if found is None else found.unionByName(one)
    asked = posts.sparkSession.createDataFrame(list(enumerate(refs, 1)), "n int, ref string")
    if found is None:
        return asked.select("n", "ref", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    mine = comments.join(F.broadcast(found.select(F.col("id").alias("post_id")).distinct()), "post_id", "left_semi")
    threads = forest.render_threads(forest.reading_order(mine)).join(mine.select("post_id", F.col("id").alias("root"), "created"), ["post_id", "root"])
    texts = threads.groupBy(F.col("post_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created", "root", "text"))), lambda t: t.text), "\n").alias("threads"))
    head = F.concat(F.lit("# P"), F.col("pid").cast("string"), F.lit(" "), "title", F.lit("\nr/"), "sub", F.lit(" | u/"), "author", F.lit(" | "), dates.day(F.col("created")), F.lit(" | score "), F.col("score").cast("string"), F.lit(" | "), text.permalink(F.col("sub"), F.col("id")))
    whole = F.concat_ws("\n", head, F.when(F.col("url") != "", F.concat(F.lit("Link: "), "url")), F.concat(F.lit("\n"), "selftext", F.lit("\n")), "threads", F.lit("\n---\n"))
    shown = found.join(texts, "id", "left").select("n", "id", whole.alias("text"))
    return asked.join(shown, "n", "left").select("n", "ref", "id", "text")
