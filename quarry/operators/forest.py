"""Comment forests: pruning, order of reading, rendering. comments: id, post_id, parent, author, score, created, body."""

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quarry.functions import text
from quarry.operators import ordered
from quarry.stored import Stored

SHORT_CHARS, SHORT_MAX_SCORE, MIN_SCORE = 40, 2, 0
LEVELS, MARKED_FROM = 6, 6


def tour(comments: DataFrame, weights: dict[str, Column] | None = None) -> DataFrame:
    """post_id, id, root, depth (0 for roots), place (in the reading order of the post, from 1) of each comment and, for each of weights, its
    sum over the comment and all below it.

    A walk around the forest of a post enters each comment, walks around its children by created and id, and leaves it. Each step
    knows the next one; by pointer jumping each learns what lies from it to the end of the walk, in as many rounds as the length
    of the longest walk has binary digits, however deep or wide the threads are. A step follows one other step only, so no join has
    a hot key. A comment without its parent in the post is a root. Comments whose ancestors form a circle are in no thread and left
    out; of rows with the same id the first by created and parent counts."""
    work, weights = Stored(comments.sparkSession, "forest"), weights or {}
    nodes = comments.select("post_id", "id", F.struct("created", "parent", *(c.cast("long").alias(w) for w, c in weights.items())).alias("__v"))
    nodes = nodes.groupBy("post_id", "id").agg(F.min("__v").alias("__v")).select("post_id", "id", "__v.*")
    known = nodes.select("post_id", F.col("id").alias("parent"), F.lit(True).alias("__known"))
    nodes = nodes.join(known, ["post_id", "parent"], "left").withColumn("up", F.when(F.col("__known"), F.col("parent"))).drop("__known", "parent")
    order = [F.col("post_id"), F.asc_nulls_first("up"), F.col("created"), F.col("id")]
    nodes = work.save(ordered.with_next(nodes, order, ["post_id", "up", "id"], work))
    first = nodes.where("up is not null").groupBy("post_id", F.col("up").alias("id")).agg(F.min(F.struct("created", F.col("id").alias("child"))).alias("__c")).select("post_id", "id", "__c.child")
    sibling = F.when((F.col("next.post_id") == F.col("post_id")) & F.col("next.up").eqNullSafe(F.col("up")), F.col("next.id"))
    own = {"__n": F.lit(1), "__roots": F.col("up").isNull().cast("long"), **{w: F.col(w) for w in weights}}
    enter = F.struct(F.lit(False).alias("out"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).alias("__depth"), *(c.cast("long").alias(n) for n, c in own.items()))
    leave = F.struct(F.lit(True).alias("out"), F.coalesce("__sibling", "up").alias("to"), F.col("__sibling").isNull().alias("to_out"), F.lit(-1).alias("__depth"), *(F.lit(0).cast("long").alias(n) for n in own))
    steps = nodes.withColumn("__sibling", sibling).join(first, ["post_id", "id"], "left").select("post_id", "id", "up", F.explode(F.array(enter, leave)).alias("__s")).select("post_id", "id", "up", "__s.*")
    counted, open_, k = ["__depth", *own], -1, 0
    while True:
        seen = Observation()
        steps = work.save(steps.observe(seen, F.count("to").alias("open")), f"steps{k}")
        if k:
            work.drop(f"steps{k - 1}")
        k += 1
        if seen.get["open"] in (0, open_):  # none is left, or only circles are
            break
        open_ = seen.get["open"]
        ahead = steps.select("post_id", F.col("id").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("__to"), F.col("to_out").alias("__to_out"), *(F.col(c).alias(f"__a{c}") for c in counted))
        steps = steps.join(ahead, ["post_id", "to", "to_out"], "left").select("post_id", "id", "up", "out", F.col("__to").alias("to"), F.col("__to_out").alias("to_out"), *((F.col(c) + F.coalesce(f"__a{c}", F.lit(0))).alias(c) for c in counted))
    done = steps.where("to is null")
    totals = done.groupBy("post_id").agg(F.max("__n").alias("__all"), F.max("__roots").alias("__all_roots"))
    at_enter = lambda c: F.max(F.when(~F.col("out"), F.col(c)))
    both = done.groupBy("post_id", "id").agg(*(at_enter(c).alias(c) for c in ("__n", "__roots", "__depth")), F.max("up").alias("up"), *((at_enter(w) - F.max(F.when(F.col("out"), F.col(w)))).alias(w) for w in weights))
    thread = F.col("__all_roots") - F.col("__roots") - F.when(F.col("up").isNull(), 0).otherwise(1)
    placed = work.save(both.join(totals, "post_id").select("post_id", "id", "up", (-F.col("__depth")).cast("int").alias("depth"), (F.col("__all") - F.col("__n") + 1).cast("int").alias("place"), thread.alias("__thread"), *weights))
    roots = placed.where("up is null").select("post_id", "__thread", F.col("id").alias("root"))
    return placed.join(roots, ["post_id", "__thread"]).select("post_id", "id", "root", "depth", "place", *weights)


def with_prunable(comments: DataFrame, post_asks: DataFrame, short_chars: int = SHORT_CHARS) -> DataFrame:
    """comments with prunable. post_asks: post_id, asks. A short comment that answers a question (its parent's, or its post's if it has
    none) is no noise; a counter-question is no answer; with a parent that is missing from the post it answers nothing."""
    parents = comments.select("post_id", F.col("id").alias("parent"), text.is_question(F.col("body")).alias("__asked"))
    rows = comments.join(parents, ["post_id", "parent"], "left").join(post_asks.select("post_id", F.col("asks").alias("__post_asks")), "post_id", "left")
    asked = F.coalesce(F.when(F.col("parent").isNull(), F.col("__post_asks")).otherwise(F.col("__asked")), F.lit(False))
    answers = asked & ~F.contains("body", F.lit("?"))
    noise = text.is_gone(F.col("body")) | text.is_bot(F.col("author")) | (F.col("score") < MIN_SCORE) | text.is_reaction(F.col("body"))
    short = (F.length("body") < short_chars) & ~answers & (F.col("score") <= SHORT_MAX_SCORE)
    return rows.withColumn("prunable", noise | short).select(*comments.columns, "prunable")


def prune(comments: DataFrame, post_asks: DataFrame, short_chars: int = SHORT_CHARS) -> DataFrame:
    """What is left when prunable leaves go again and again: every comment that isn't prunable and all above it, which are those with such
    a comment at or below them. Comments whose ancestors form a circle go."""
    marked = with_prunable(comments, post_asks, short_chars)
    kept = tour(marked, {"n_lasting": (~F.col("prunable")).cast("long")}).where("n_lasting > 0").select("post_id", "id")
    return comments.join(kept, ["post_id", "id"], "left_semi")


def surviving_posts(posts: DataFrame, kept_comments: DataFrame) -> DataFrame:
    """The posts with a text or a comment that is left. posts: id, selftext, ..."""
    some = kept_comments.select(F.col("post_id").alias("id")).distinct().withColumn("__some", F.lit(True))
    return posts.join(some, "id", "left").where((F.col("selftext") != "") | F.col("__some")).drop("__some")


def reading_order(comments: DataFrame) -> DataFrame:
    """comments with root (of its thread), depth (0 for roots), place (in the reading order of the post, from 1): depth first, children by
    created and id. A comment without its parent in the post is a root."""
    return comments.join(tour(comments), ["post_id", "id"]).select(*comments.columns, "root", "depth", "place")


def rendered(author: Column, score: Column, comment_id: Column, depth: Column, body: Column) -> Column:
    """The lines of one comment, quoted by its depth."""
    quote = F.repeat(F.lit("> "), F.least(depth + 1, F.lit(LEVELS)))
    head = F.concat(quote, F.lit("**u/"), author, F.lit("** ("), score.cast("string"), F.lit(") · c/"), comment_id, F.when(depth >= MARKED_FROM, F.concat(F.lit(" · [d"), (depth + 1).cast("string"), F.lit("]"))).otherwise(""))
    lines = F.transform(F.split(text.escape_markdown(body), "\n", -1), lambda x: F.concat(quote, x))
    return F.array_join(F.concat(F.array(head), lines, F.array(F.rtrim(quote))), "\n")


def render_threads(ordered: DataFrame, hide_images: bool = False) -> DataFrame:
    """post_id, root, text of each thread of reading_order()."""
    rows = ordered.where(~text.is_image_only(F.col("body"))) if hide_images else ordered
    one = rows.select("post_id", "root", "place", rendered(F.col("author"), F.col("score"), F.col("id"), F.col("depth"), F.col("body")).alias("text"))
    return one.groupBy("post_id", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n").alias("text"))


def thread_chars(ordered: DataFrame) -> DataFrame:
    """post_id, root, chars: the length of a thread without comments that are only images."""
    return ordered.groupBy("post_id", "root").agg(F.sum(F.when(text.is_image_only(F.col("body")), 0).otherwise(F.length("body"))).alias("chars"))
