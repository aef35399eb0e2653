"""The provided tables in the shapes that the operators read, for queries and benchmarks."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(c: Column) -> Column:
    """The first 16 bits of a digest."""
    return F.conv(F.substring(F.sha1(c), 1, 4), 16, 10).cast("bigint")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: language as sub, source as flair."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("pid"), F.col("lang").alias("sub"), F.col("source").alias("link_flair"),
        F.substring("text", 1, 80).alias("title"), F.col("text").alias("selftext"), F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("author"), (F.col("n_chars") % 100).alias("score"),
        (F.lit(EPOCH) + F.col("doc_id") * 600).alias("created"), F.lit("").alias("url"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments_of(table(spark, sf_dir, "conversations"))


def comments_of(conversations: DataFrame) -> DataFrame:
    """Conversations as comments from turn 1 on, each turn a child of the one at half its number."""
    c = conversations.where("turn >= 1")
    post = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    cid = F.concat_ws("_", post, F.col("turn").cast("string"))
    return c.select(
        cid.alias("id"), post.alias("post_id"), F.when(F.col("turn") >= 2, F.concat_ws("_", post, F.floor(F.col("turn") / 2).cast("string"))).alias("parent"), F.col("role").alias("author"),
        F.lit(None).cast("string").alias("flair"), (hashed(cid) % 20 - 4).alias("score"), (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created"), F.col("text").alias("body"),
    )


def threads_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads_posts_of(table(spark, sf_dir, "conversations"))


def threads_posts_of(conversations: DataFrame) -> DataFrame:
    """The first turns, as the posts of those comments."""
    c = conversations.where("turn = 0")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.col("conv_id").alias("pid"), F.col("role").alias("author"), F.col("text").alias("selftext"), F.substring("text", 1, 40).alias("title"), F.col("role").alias("sub"), F.lit("").alias("link_flair"), F.lit("").alias("url"), (F.lit(EPOCH) + F.col("conv_id") * 3600).alias("created"), (hashed(F.col("text")) % 50).alias("score"))


def event_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks: a span from each event, finished some time after; every fifth isn't finished."""
    e = table(spark, sf_dir, "events")
    start = event_seconds()
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("sub"), F.col("event_type").alias("kind"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), start.alias("start"),
        (start + (F.col("value") * 600).cast("long")).alias("end"), (F.col("event_id") % 3000).alias("est"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 1700).alias("rows"),
        F.when(F.col("event_id") % 5 != 0, start + F.col("event_id") % 300000).alias("finished_at"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window a key of chunks(): from a day before the first second of all events to a day after the last."""
    c = chunks(spark, sf_dir)
    keys = c.select("sub", "kind").distinct()
    ends = c.agg((F.min("start") - 86400).alias("after"), (F.max("start") + 86400).alias("before"))
    return keys.withColumn("after", ends.select("after").scalar()).withColumn("before", ends.select("before").scalar())
