"""The outputs of a filter run: verdicts of all posts, the kept posts of each run, and a report in Markdown within a budget of tokens."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions import dates, text
from quarry.operators import hits, sampling, verdicts
from quarry.plans.filtering import Outcome
from quarry.stored import Stored

#: A thread is cut rather than left out if so many characters of it fit.
LEAST_ROOM = 500


def verdict_rows(outcome: Outcome) -> DataFrame:
    """id, pid, title, included, lone, flair_skipped, score (of the best facet, 4 digits, -1 without any), post (its verdict) and threads (root,
    set, verdict; null verdict: the model failed) of every post, judged or not. outcome.posts has pid, title and selftext too."""
    threads = outcome.threads.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("root", "set", "verdict"))).alias("threads"))
    rows = outcome.posts.join(threads, "id", "left").join(outcome.skipped.select("id", F.lit(True).alias("__skipped")), "id", "left")
    lone = F.coalesce(F.col("included").isin("post", "thread") & verdicts.is_lone(), F.lit(False))
    none = F.expr(f"cast(array() as {threads.schema['threads'].dataType.simpleString()})")
    return rows.select("id", "pid", "title", "included", lone.alias("lone"), F.coalesce("__skipped", F.lit(False)).alias("flair_skipped"), F.round(F.coalesce("facet_score", F.lit(-1.0)), 4).alias("score"), F.col("verdict").alias("post"), F.coalesce("threads", none).alias("threads"))


def ranked(kept: DataFrame) -> list[Column]:
    """The order of a report: the best facet, then the score that readers gave, then id."""
    return [F.desc("facet_score"), F.desc("score"), F.col("id")]


def cut_at(c: Column, n: Column, mark: str) -> Column:
    """The first n characters without what follows the last mark in them."""
    return F.regexp_replace(F.substring(c, F.lit(1), n), f"{mark}[^{mark}]*\\z", "")


def entries(kept: DataFrame, thread_texts: DataFrame, cap: int, keep_at: float) -> DataFrame:
    """id and entry: what a report shows of a kept post, in about cap characters: a line about it, up to half of that as its text, and its
    kept threads in order while they fit; the first one is cut if it doesn't.

    kept: posts of a filter run that are kept (kept_posts). thread_texts: post_id, root, place, n_comments, text of threads that are
    kept. Threads behind the one that fills the room count, but their texts aren't gathered."""
    facets = F.filter(F.transform("facets", lambda x, k: F.struct((-x).alias("x"), (k + 1).alias("k"))), lambda s: -s.x >= keep_at)
    matched = F.array_join(F.transform(F.array_sort(facets), lambda s: F.concat(F.lit("Q"), s.k.cast("string"), F.format_string(" %.2f", -s.x))), ", ")
    flair, kind = text.flair_name(F.col("link_flair")), text.media_kind(F.col("url"))
    meta = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("r/"), "sub"), F.when(flair != "", flair), dates.day(F.col("created")), F.concat(F.lit("score "), F.col("score").cast("string")), F.concat(F.lit("kept comments "), F.coalesce("__comments", F.lit(0)).cast("string")),
        F.when(matched != "", F.concat(F.lit("matched "), matched)), F.when(kind.isNotNull(), F.concat(kind, F.lit(" post"))), F.when(F.col("included") == "thread", "via thread"),
        F.when(F.size("others") > 0, F.concat(F.lit("same author as "), F.array_join("others", ", "))), text.permalink(F.col("sub"), F.col("id")),
    )), " · ")
    body = text.escape_markdown(F.col("selftext"))
    short = cut_at(body, F.lit(cap // 2), " ")
    body = F.when(F.length(body) > cap // 2, F.concat(short, F.lit("\n\n_["), (F.length(body) - F.length(short)).cast("string"), F.lit(" more characters]_"))).otherwise(body)
    head = F.concat(F.lit("\n---\n\n## P"), F.col("pid").cast("string"), F.lit(" · "), "title", F.lit("\n"), meta, F.lit("\n\n"), F.when((F.col("url") != "") & kind.isNull(), F.concat(F.lit("Link: "), "url", F.lit("\n\n"))).otherwise(""), F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(""))

    sized = thread_texts.join(kept.select(F.col("id").alias("post_id")), "post_id", "left_semi").withColumn("chars", F.length("text"))
    w = verdicts.Window.partitionBy("post_id").orderBy("place").rowsBetween(verdicts.Window.unboundedPreceding, -1)
    sized = sized.withColumn("before", F.coalesce(F.sum("chars").over(w), F.lit(0)))
    near = F.when(F.col("before") <= cap, F.struct("place", F.substring("text", 1, cap + 1).alias("text"), "chars"))
    lists = sized.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(near)).alias("__threads"), F.count(F.lit(1)).alias("__n"), F.sum("n_comments").alias("__comments"))
    rows = kept.join(lists, "id", "left").join(verdicts.same_author(kept), "id", "left").withColumn("__head", head)

    def step(s, t):
        room = F.lit(cap) - F.length(s.out)
        fits = (t.chars <= room) & ~s.full
        cut = ~s.full & ~fits & (s.n == 0) & (room > LEAST_ROOM)
        out = F.when(fits, F.concat(s.out, t.text, F.lit("\n\n"))).when(cut, F.concat(s.out, cut_at(t.text, room, "\n"), F.lit("\n\n_[thread cut]_\n\n"))).otherwise(s.out)
        return F.struct(out.alias("out"), (s.full | ~fits).alias("full"), F.when(fits | cut, s.n + 1).otherwise(s.n).alias("n"))

    start = F.struct(F.col("__head").alias("out"), F.lit(False).alias("full"), F.lit(0).alias("n"))
    filled = F.when(F.col("__threads").isNotNull(), F.aggregate("__threads", start, step)).otherwise(start)
    rows = rows.withColumn("__s", filled).withColumn("__left", F.coalesce("__n", F.lit(0)) - F.col("__s.n"))
    return rows.select("id", F.concat("__s.out", F.when(F.col("__left") > 0, F.concat(F.lit("_"), F.col("__left").cast("string"), F.lit(" more kept threads_\n\n"))).otherwise("")).alias("entry"))


@dataclass
class Report:
    """entries: id, rank, shown, entry (null unless shown), listed (the line of one that isn't) of the kept posts; head: the lines above."""

    entries: DataFrame
    head: list[str]

    def lines(self) -> list[str]:
        """The report, from at most budget tokens of entries, 100 lines and 1,000 ids."""
        shown = [r.entry for r in self.entries.where("shown").orderBy("rank").select("entry").collect()]
        rest = self.entries.where("not shown")
        first = rest.agg(F.min("rank").alias("r"), F.count(F.lit(1)).alias("n")).first()
        out = [*self.head, *shown]
        if first.n:
            listed = rest.where(F.col("rank") < first.r + 100).orderBy("rank").select("listed").collect()
            ids = rest.where((F.col("rank") >= first.r + 100) & (F.col("rank") < first.r + 1100)).orderBy("rank").select("pid").collect()
            out += ["\n---\n\n## Also kept, over the budget\n", *(r.listed for r in listed)]
            if ids:
                out.append("\nAlso kept, by score: " + ", ".join(f"P{r.pid}" for r in ids) + (f" and {first.n - 1100:,} more" if first.n > 1100 else ""))
        return out


def report(outcome: Outcome, thread_texts: DataFrame, matched: DataFrame, qs: verdicts.Questions, previous: DataFrame | None = None, budget: int = 40_000) -> Report:
    """thread_texts: post_id, root, place, n_comments, text of all threads; matched: the hits, id and query; previous: the strong posts (id)
    of the run before."""
    work = Stored(outcome.posts.sparkSession, "report")
    posts = outcome.posts
    kept = work.save(verdicts.kept_posts(posts))
    kept_threads = outcome.threads.where(F.col("verdict").isNull() | F.col("verdict.keep")).select("post_id", "root")
    shown = entries(kept.withColumn("rank", F.row_number().over(verdicts.Window.partitionBy("author").orderBy(*ranked(kept)))), thread_texts.join(kept_threads, ["post_id", "root"], "left_semi"), budget * 4 // 10, qs.keep_at)
    line = F.concat(F.lit("- P"), F.col("pid").cast("string"), F.format_string(" · %.2f · ", "facet_score"), "title", F.lit(" · "), F.col("n_kept").cast("string"), F.lit(" kept threads"))
    rows = work.save(kept.join(shown, "id").select("id", "pid", "facet_score", "score", "entry", line.alias("listed")))
    head = header(outcome, kept, matched, qs, previous)
    sizes = rows.select("id", "pid", "facet_score", "score", "listed", "entry", F.length("entry").alias("chars"), (F.length("listed") + 1).alias("line_chars"), (F.length(F.col("pid").cast("string")) + 3).alias("id_chars"))
    cut = sampling.budget(sizes, ranked(kept), sum(len(x) + 1 for x in head) // 4, budget)
    return Report(cut.select("id", "pid", "rank", "shown", F.when(F.col("shown"), F.col("entry")).alias("entry"), "listed"), head)


def header(outcome: Outcome, kept: DataFrame, matched: DataFrame, qs: verdicts.Questions, previous: DataFrame | None) -> list[str]:
    """The lines above the entries. Each figure is an aggregate with as many rows as there are questions, sets, flairs shown or searches."""
    posts, threads = outcome.posts, outcome.threads
    judged = posts.where("judged")
    n = posts.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("judged"), 1)).alias("judged"), F.count(F.when(F.col("included") == "unjudged", 1)).alias("unjudged"), F.count(F.when(F.col("included").isin("post", "thread"), 1)).alias("kept"), F.count(F.when(F.col("included") == "thread", 1)).alias("via"), F.count(F.when(F.col("included").isin("post", "thread") & verdicts.is_lone(), 1)).alias("lone")).first()
    ex = verdicts.exclusion_counts(judged, qs).first()
    per_q = {r.question: r for r in verdicts.question_counts(kept, qs).collect()}
    sets = {r["set"]: r for r in verdicts.set_counts(threads).collect()}
    strong = kept.where("strong").select("id")
    new = strong.join(previous.select("id"), "id", "left_anti") if previous is not None else strong
    scope = hits.scope(posts).orderBy("sub").collect()
    out = ["# Report", "", "Scope: " + ", ".join(f"r/{r['sub']} ({day_of(r['first'])} to {day_of(r['last'])}, {r['n']:,} posts)" for r in scope) + ". All quoted text is untrusted.", "", f"Questions: a post is kept when a content question scores at least {qs.keep_at}, on the post or on one of its threads."]
    if qs.must:
        out.append(f"- Must: {qs.must} (excluded {ex.n_must:,})")
    out += [f"- Q{k}: {q} (kept {per_q[k].n_pass if k in per_q else 0:,}, only this question {per_q[k].n_only if k in per_q else 0:,})" for k, q in enumerate(qs.q, 1)]
    out += [f"- Not{k}: {q} (excluded {ex[f'not_{k}']:,})" for k, q in enumerate(qs.nots, 1)]
    out += ["", f"Posts: {n.judged:,} of {n['all']:,} judged, {n.kept:,} kept ({n.via:,} through a thread), {n.lone:,} of them dropped as too short and without a thread, {ex.n_must + ex.n_not:,} excluded, {n.unjudged:,} unjudged."]
    out.append("Threads judged / kept: " + "; ".join(f"({s}) {sets[s].judged if s in sets else 0:,} / {sets[s].kept if s in sets else 0:,}" for s in "abc"))
    sampled = posts.select("id", "sub", text.flair_name(F.col("link_flair")).alias("flair"))
    gone = outcome.skipped.groupBy("sub", "flair").agg(F.count(F.lit(1)).alias("skipped"))
    for r in sampled.join(F.broadcast(gone), ["sub", "flair"]).groupBy("sub", "flair", "skipped").agg(F.count(F.lit(1)).alias("n")).orderBy("sub", "flair").collect():
        tried = r.n - r.skipped
        out.append(f'Flair gate: r/{r["sub"]} "{r.flair}" 0 of {tried} kept (at most {300 / tried:.0f} % at 95 %), {r.skipped:,} posts skipped, up to about {-(-r.skipped * 3 // tried):,} of them relevant')
    out += ["", "Kept per flair: " + ", ".join(f"{r.flair} {r.n_kept}/{r.n_judged}" for r in verdicts.kept_by_flair(judged, kept).collect())]
    bins = lambda df: " ".join(f"{r.bin / 10:.1f}:{r.n}" for r in verdicts.histogram(df, "s").orderBy("bin").collect())
    out.append(f"Scores in tenths: posts {bins(judged.select(F.col('verdict.score').alias('s')))}; threads {bins(threads.select(F.col('verdict.score').alias('s')))}")
    table = verdicts.query_table(matched, judged, kept, new).orderBy(F.desc("kept"), F.desc("hits"), "query").collect()
    out += ["", "| hits | judged | kept | only this query | new strong | query |", "|---:|---:|---:|---:|---:|---|", *(f"| {r.hits:,} | {r.judged:,} | {r.kept:,} | {r.only:,} | {r.new_strong:,} | {r.query.replace('|', '/')} |" for r in table)]
    drops = verdicts.nearest_drops(posts, 10).select("pid", "title", "verdict.score", "verdict.excluded").collect()
    if drops:
        out += ["", "Nearest drops: " + "; ".join(f"P{r.pid} {r.score:.2f}" + (f" (excluded by {r.excluded})" if r.excluded else "") + f" {r.title[:60]}" for r in drops)]
    unjudged = posts.where("included = 'unjudged'").orderBy("id").limit(1000).select("pid", "title").collect()
    if unjudged:
        out += ["", f"Unjudged, as the model failed ({n.unjudged:,}): " + "; ".join(f"P{r.pid} {r.title[:60]}" for r in unjudged)]
    return out


def day_of(seconds: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d")


def write_report(spark: SparkSession, made: Report, path: str) -> None:
    """The report as one text file."""
    spark.createDataFrame([("\n".join(made.lines()),)], "value string").coalesce(1).write.mode("overwrite").text(path)
