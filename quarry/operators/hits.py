"""Search hits as sets: accumulating, what is new, flairs, the nested results. Posts are known by their archive id throughout, so hits
survive a rebuild by a plain join."""

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions import text


def accumulate(hits: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two hit tables, each key once."""
    return hits.select(*keys).unionByName(more.select(*keys)).dropDuplicates(keys)


def new_by_query(found: DataFrame, earlier: DataFrame) -> DataFrame:
    """ord, query, n_new: posts that neither the earlier hits nor an earlier query of this run found. found: ord, query, id."""
    first = found.join(earlier.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("ord").alias("ord"))
    return found.select("ord", "query").distinct().join(first.groupBy("ord").agg(F.count(F.lit(1)).alias("n_new")), "ord", "left").select("ord", "query", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def query_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"))


def post_filters(posts: DataFrame, sub: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Values that are null, empty or 0 filter nothing."""
    if sub:
        posts = posts.where(F.lower("sub") == sub.lower())
    if after:
        posts = posts.where(F.col("created") >= after)
    if before:
        posts = posts.where(F.col("created") < before)
    return posts


def by_flair(posts: DataFrame, wanted: str) -> DataFrame:
    """id of the posts whose flair holds a text, without case and emoji codes."""
    return posts.where(F.contains(text.flair_key(F.col("link_flair")), text.flair_key(F.lit(wanted)))).select("id")


def exclude_flair(excluded: DataFrame, pattern: str, sub: str = "") -> DataFrame:
    new = excluded.sparkSession.createDataFrame([(pattern, sub)], "pattern string, sub string")
    key = [F.lower("pattern").alias("__p"), F.lower("sub").alias("__s")]
    return excluded.unionByName(new.join(excluded.select(*key), (F.lower("pattern") == F.col("__p")) & (F.lower(new["sub"]) == F.col("__s")), "left_anti"))


def include_flair(excluded: DataFrame, pattern: str, sub: str = "") -> DataFrame:
    return excluded.where((F.lower("pattern") != pattern.lower()) | (F.lower("sub") != sub.lower()))


def without_excluded(posts: DataFrame, excluded: DataFrame, how: str = "left_anti") -> DataFrame:
    """The posts whose flair isn't excluded, for their sub or for all (how: left_semi for those that are). The equal keys keep it a hash
    join; which sub is what is left of the condition."""
    p = posts.withColumn("__key", text.flair_key(F.col("link_flair")))
    e = excluded.select(text.flair_key(F.col("pattern")).alias("__e_key"), F.lower("sub").alias("__e_sub")).distinct()
    on = (F.col("__key") == F.col("__e_key")) & ((F.col("__e_sub") == "") | (F.col("__e_sub") == F.lower("sub")))
    return p.join(e, on, how).drop("__key")


def carry_over(hits: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of posts that a rebuild still has, and the posts (id) that it lost."""
    ids = rebuilt.select("id")
    return hits.join(ids, "id", "left_semi"), hits.select("id").distinct().join(ids, "id", "left_anti")


def matched_posts(hits: DataFrame, posts: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """posts with matched_by (sorted queries) and n: most queries first, then score, then id."""
    matched = hits.groupBy("id").agg(F.array_sort(F.collect_set("query")).alias("matched_by"))
    rows = posts.join(matched, "id").withColumn("n", F.size("matched_by"))
    rows = without_excluded(rows, excluded) if excluded is not None else rows
    return rows.orderBy(F.desc("n"), F.desc("score"), "id")


def nested_results(matched: DataFrame, comments: DataFrame, text_hits: DataFrame, comment_hits: DataFrame) -> DataFrame:
    """matched posts with link, text_match and comments: an array in order of creation, with hit. comments: post_id, id, ..."""
    flagged = comments.join(comment_hits.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    one = F.struct("created", "id", "parent", "author", "flair", "score", "body", "hit")
    lists = flagged.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("comments"))
    return (
        matched.join(text_hits.select("id").distinct().withColumn("text_match", F.lit(True)), "id", "left").join(lists, "id", "left")
        .withColumn("text_match", F.coalesce("text_match", F.lit(False))).withColumn("comments", F.coalesce("comments", F.expr(f"cast(array() as {lists.schema['comments'].dataType.simpleString()})")))
        .withColumn("link", text.permalink(F.col("sub"), F.col("id")))
    )


def flair_stats(posts: DataFrame, hits: DataFrame, kept: DataFrame) -> DataFrame:
    """sub, flair, n_posts, n_hits, n_kept."""
    name = text.flair_name(F.col("link_flair"))
    rows = posts.join(hits.select("id").distinct().withColumn("__hit", F.lit(1)), "id", "left").join(kept.select("id").distinct().withColumn("__kept", F.lit(1)), "id", "left")
    return rows.groupBy("sub", F.when(name == "", "(no flair)").otherwise(name).alias("flair")).agg(
        F.count(F.lit(1)).alias("n_posts"), F.count("__hit").alias("n_hits"), F.count("__kept").alias("n_kept"))


def flair_tail(stats: DataFrame, shown: int = 40) -> DataFrame:
    """sub, n_more, n_posts: the flairs of each sub beyond those shown."""
    rank = F.row_number().over(Window.partitionBy("sub").orderBy(F.desc("n_posts"), "flair"))
    rest = stats.withColumn("__rank", rank).where(F.col("__rank") > shown)
    return rest.groupBy("sub").agg(F.count(F.lit(1)).alias("n_more"), F.sum("n_posts").alias("n_posts"))


def newest_titles(posts: DataFrame, n: int) -> DataFrame:
    """sub, flair, rank, title of the newest posts of each flair."""
    name = text.flair_name(F.col("link_flair"))
    rows = posts.withColumn("flair", F.when(name == "", "(no flair)").otherwise(name))
    rank = F.row_number().over(Window.partitionBy("sub", "flair").orderBy(F.desc("created"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("sub", "flair", "rank", F.substring("title", 1, 90).alias("title"))


def scope(posts: DataFrame) -> DataFrame:
    return posts.groupBy("sub").agg(F.min("created").alias("first"), F.max("created").alias("last"), F.count(F.lit(1)).alias("n"))


def peek(posts: DataFrame, found: DataFrame, n: int) -> DataFrame:
    return posts.join(found.select("id").distinct(), "id", "left_semi").orderBy(F.desc("score"), "id").limit(n).select("id", "score", F.substring("title", 1, 90).alias("title"))


def find_post(posts: DataFrame, ref: str) -> DataFrame:
    """A post by P-number, else by archive id with or without t3_; one row or none."""
    import re

    ref = ref.strip()
    number = re.fullmatch(r"[Pp]?(\d{1,18})", ref)
    by_number = (F.col("pid") == int(number[1])) if number else F.lit(False)
    by_id = F.col("id") == ref.removeprefix("t3_")
    return posts.where(by_number | by_id).orderBy(F.when(by_number, 0).otherwise(1)).limit(1)


def missed(matching: DataFrame, hits: DataFrame) -> DataFrame:
    """The recall audit: id of the posts that match a query but that no search found, in the order of the hash of their id."""
    return matching.select("id").distinct().join(hits.select("id").distinct(), "id", "left_anti").orderBy(F.sha1("id"), "id")


def missed_on_both_sides(found_posts: DataFrame, found_comments: DataFrame, hits: DataFrame) -> DataFrame:
    """id, text_match, n_comments of the posts that a query matches, themselves or by a comment (two_sided()), but that no search found."""
    own = found_posts.select("id", F.lit(1).alias("own"), F.lit(0).alias("via"))
    via = found_comments.select(F.col("post_id").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("via"))
    both = own.unionByName(via).groupBy("id").agg((F.max("own") > 0).alias("text_match"), F.sum("via").alias("n_comments"))
    return both.join(hits.select("id").distinct(), "id", "left_anti")


def reset(*tables: DataFrame) -> list[DataFrame]:
    """Hits and exclusions for a new question: the same tables without rows."""
    return [t.limit(0) for t in tables]
