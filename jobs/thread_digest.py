"""Digests of threads: every post with its comments in reading order as Markdown, without noise and within a budget of tokens.

    python -m jobs.thread_digest --conversations PATH --output PATH [--config jobs/thread_digest.json]

Reads a table of conversations (the first turn is the post, later ones are its comments), cleans the texts, prunes comments that are gone,
by bots, disliked, reactions or short, drops posts without anything left, and writes one row for each post and each comment that is left:
its place in the reading order, its text as quoted Markdown, its tokens, those of its post before it, and whether it is within
the budget of the post. The output is Parquet, partitioned by the month of the post. A run replaces all of the output, so it can be
repeated after a failure at any point; the same input gives the same rows.

Config: short_chars, comments below it are short; budget_tokens for each post; hide_images, leave out comments that are only images.
Turns without a conv_id or a turn number are left out; a null text is empty, a null role is [deleted].
"""

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text
from quarry.operators import forest, ordered
from quarry.session import build_session
from quarry.sources import adapter

SCHEMA = "post_id string, place int, id string, root string, depth int, text string, tokens long, used long, shown boolean, month string"
log = logging.getLogger("jobs.thread_digest")


def digest(conversations: DataFrame, config: dict) -> DataFrame:
    known = conversations.where("conv_id is not null and turn is not null")
    turns = known.select("conv_id", "turn", F.coalesce("role", F.lit("[deleted]")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    posts = adapter.threads_posts_of(turns).withColumn("selftext", text.clean(F.col("selftext")))
    comments = adapter.comments_of(turns).withColumn("body", text.clean(F.col("body"))).join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    asks = posts.select(F.col("id").alias("post_id"), text.is_question(F.col("selftext")).alias("asks"))
    kept = forest.prune(comments, asks, short_chars=config["short_chars"])
    alive = forest.surviving_posts(posts, kept)
    read = forest.reading_order(kept)
    if config["hide_images"]:
        read = read.where(~text.is_image_only(F.col("body")))
    said = forest.rendered(F.col("author"), F.col("score"), F.col("id"), F.col("depth"), F.col("body"))
    lines = read.select("post_id", "place", "id", "root", "depth", said.alias("text"))
    heads = alive.select(F.col("id").alias("post_id"), F.lit(0).alias("place"), "id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.concat(F.lit("### "), "title", F.lit("\n"), "selftext").alias("text"))
    rows = heads.unionByName(lines).withColumn("tokens", F.floor(F.length("text") / 4))
    # Tokens before a row in one order over all posts, less those before its post: a post may hold very many rows.
    rows = ordered.running(rows, [F.col("post_id"), F.col("place")], {"so_far": F.col("tokens")}, place="n")
    months = alive.select(F.col("id").alias("post_id"), F.date_format(F.timestamp_seconds("created"), "yyyy-MM").alias("month"))
    begun = rows.where("place = 0").select("post_id", F.col("so_far").alias("begun")).join(months, "post_id")
    rows = rows.join(begun, "post_id").withColumn("used", F.col("so_far") - F.col("begun"))
    rows = rows.withColumn("shown", F.col("used") + F.col("tokens") <= config["budget_tokens"])
    return rows.select("post_id", "place", "id", "root", "depth", "text", "tokens", "used", "shown", "month")


def run(spark: SparkSession, conversations: str, output: str, config: dict) -> DataFrame:
    """Writes the digests of the conversations at a path to another, and returns them read back."""
    turns = spark.read.parquet(conversations)
    log.info("read %d turns from %s", turns.count(), conversations)
    # about equal files, months with many rows in several
    rows = digest(turns, config).hint("rebalance", "month")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(output)
    written = spark.read.schema(SCHEMA).parquet(output)
    n = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("post_id").alias("posts"), F.count_distinct("month").alias("months"), F.count(F.when(F.col("shown"), 1)).alias("shown")).first()
    log.info("wrote %d rows (%d within the budget) of %d posts in %d months to %s", n.rows, n.shown, n.posts, n.months, output)
    return written


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--conversations", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=__file__.removesuffix(".py") + ".json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = build_session("thread_digest")
    try:
        run(spark, a.conversations, a.output, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
