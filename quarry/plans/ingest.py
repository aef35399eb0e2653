"""From raw records to the tables of posts and comments."""

from pyspark.sql import DataFrame, Observation, Window, functions as F

from quarry.functions import text
from quarry.operators import forest


def clean_posts(raw: DataFrame, sub: str | None = None) -> DataFrame:
    """Raw posts with defaults for what is missing and cleaned text. Posts marked for adults go, before comments are attached."""
    body = text.clean(F.col("selftext"))
    url, own = F.coalesce("url", F.lit("")), F.concat(F.lit("/comments/"), F.col("id"), F.lit("/"))
    return raw.where(~F.coalesce("over_18", F.lit(False))).select(
        "id", (F.lit(sub) if sub else F.col("sub")).alias("sub"), F.coalesce("title", F.lit("")).alias("title"), F.when(text.is_gone(body), "").otherwise(body).alias("selftext"),
        F.when(F.coalesce("author", F.lit("")) == "", "[deleted]").otherwise(F.col("author")).alias("author"), F.col("author_flair_text").alias("flair"), F.col("link_flair_text").alias("link_flair"),
        *(F.coalesce(c, F.lit(0)).alias(a) for c, a in (("score", "score"), ("created_utc", "created"), ("num_comments", "num_comments"))),
        F.when(F.contains(url, own), "").otherwise(url).alias("url"),
    )


def clean_comments(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Raw comments of the posts, with their post's id and their parent's id, which is null at the top."""
    rows = raw.select(
        "id", F.expr("substring(coalesce(link_id, ''), 4)").alias("post_id"), F.when(F.startswith("parent_id", F.lit("t1_")), F.expr("substring(parent_id, 4)")).alias("parent"),
        F.when(F.coalesce("author", F.lit("")) == "", "[deleted]").otherwise(F.col("author")).alias("author"), F.col("author_flair_text").alias("flair"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("created_utc", F.lit(0)).alias("created"), text.clean(F.col("body")).alias("body"),
    )
    return rows.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")


def build(raw_posts: DataFrame, raw_comments: DataFrame, sub: str | None = None) -> tuple[DataFrame, DataFrame]:
    """posts and comments of a sub, from records of which the newest version was taken: cleaned, pruned, and only posts with something left.
    pid and cid number them by time for display; everything joins on id."""
    posts = clean_posts(raw_posts, sub)
    comments = clean_comments(raw_comments, posts)
    asks = posts.select(F.col("id").alias("post_id"), (text.is_question(F.col("title")) | text.is_question(F.col("selftext"))).alias("asks"))
    kept = forest.prune(comments, asks)
    return forest.surviving_posts(posts, kept), kept


def build_counted(raw_posts: DataFrame, raw_comments: DataFrame, path: str, sub: str | None = None) -> dict[str, int]:
    """build() and write_tables(), with the rows that came in and that were written: posts_in, posts, comments_in (of posts that are there),
    comments. What is written is counted by the passes that write it."""
    seen = {name: Observation() for name in ("posts", "comments")}
    posts, comments = build(raw_posts, raw_comments, sub)
    keyed = lambda df, name: df.observe(seen[name], F.count(F.lit(1)).alias("n"))
    known = posts.select(F.col("id").alias("post_id"), F.lower("sub").alias("sub_key"))
    write_tables(keyed(posts.withColumn("sub_key", F.lower("sub")), "posts"), keyed(comments.join(known, "post_id"), "comments"), path)
    came = {"posts_in": raw_posts.count(), "comments_in": clean_comments(raw_comments, clean_posts(raw_posts, sub)).count()}
    return came | {name: o.get["n"] for name, o in seen.items()}


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Display numbers from 1 by created and id (null ones first), without one task for all rows: the rows of the hours before, then the
    place within the hour. Neither depends on how Spark deals the rows, so both passes over them agree."""
    timed = rows.withColumn("__hour", F.coalesce(F.floor(F.col("created") / 3600).cast("long"), F.lit(-(2**62))))
    earlier = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)  # one row an hour
    before = timed.groupBy("__hour").agg(F.count(F.lit(1)).alias("__n")).select("__hour", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__hour").orderBy("created", "id"))
    return timed.withColumn("__place", place).join(before, "__hour").withColumn(name, F.col("__before") + F.col("__place")).drop("__hour", "__place", "__before")


def write_tables(posts: DataFrame, comments: DataFrame, path: str) -> None:
    """Replaces the partitions of the subs that are there and leaves the others. An empty build leaves what was there."""
    for name, rows in (("posts", posts), ("comments", comments)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sub_key").parquet(f"{path}/{name}")
