"""Deterministic selections: fair shares over queries, strata, and what fits a budget."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators import ordered
from quarry.stored import Stored


def stable_order():
    """The same pseudo-random order in every run."""
    return [F.sha1("id"), F.col("id")]


def stratified(pool: DataFrame, n: int, edge: DataFrame | None = None) -> DataFrame:
    """id, label of n posts of the pool (id, text_match): evenly from those that match themselves, those found through comments, and if
    given those of edge (id); a stratum that comes up short is made up from the pool.

    Every stratum reads the pool, and who uses the sample reads it again, so the pool is written once, in narrow rows, and the sample too."""
    work = Stored(pool.sparkSession, "strata")
    rows = work.save(pool.select("id", "text_match"))
    strata = 2 if edge is None else 3
    share = -(-n // strata)
    label = F.when(F.col("text_match"), "hit in the post").otherwise("found only through comments")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*stable_order()))
    picked = rows.withColumn("label", label).withColumn("rank", rank).where(F.col("rank") <= share)
    picked = work.save(picked.select("id", "label", F.when(F.col("text_match"), 0).otherwise(1).alias("part")))
    if edge is not None:
        near = rows.join(edge.select("id").distinct(), "id", "left_semi").join(picked, "id", "left_anti").orderBy(*stable_order()).limit(share)
        picked = picked.unionByName(near.select("id", F.lit("borderline last run").alias("label"), F.lit(2).alias("part")))
    rest = rows.join(picked, "id", "left_anti").orderBy(*stable_order()).limit(n)
    every = picked.unionByName(rest.select("id", F.lit("other").alias("label"), F.lit(3).alias("part")))
    return work.save(every.orderBy("part", *stable_order()).limit(n).select("id", "label"))


def round_robin(posts: DataFrame, n: int) -> DataFrame:
    """id, place of n posts, taken from each query in turn: queries by number of posts, then name; within one, posts that match themselves,
    then those that more queries found, then by score, then by id. posts: id, matched_by, text_match, score.

    A queue passes over what another has taken, so a turn depends on all before it and no window says it. Only narrow rows of the
    first n of each queue can be taken before any queue has given n, so each queue is cut there first."""
    import pandas as pd

    queue = F.explode(F.when(F.size("matched_by") > 0, F.col("matched_by")).otherwise(F.array(F.lit("")))).alias("query")
    rows = posts.select("id", F.coalesce("text_match", F.lit(False)).alias("text_match"), F.greatest(F.size("matched_by"), F.lit(0)).alias("n"), "score", queue)
    order = [F.desc("text_match"), F.desc("n"), F.desc("score"), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    short = rows.join(rows.groupBy("query").agg(F.count(F.lit(1)).alias("size")), "query").withColumn("rank", rank).where(F.col("rank") <= n)

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        queues = [list(g.sort_values("rank").id)[::-1] for _, g in sorted(frame.groupby("query"), key=lambda kv: (kv[1]["size"].iloc[0], kv[0]))]
        taken: dict[str, int] = {}
        while queues and len(taken) < n:
            for q in queues:
                while q and q[-1] in taken:
                    q.pop()
                if q and len(taken) < n:
                    taken[q.pop()] = len(taken) + 1
            queues = [q for q in queues if q]
        return pd.DataFrame({"id": list(taken), "place": list(taken.values())})

    return short.select("query", "size", "rank", "id", F.lit(1).alias("__all")).groupBy("__all").applyInPandas(deal, "id string, place long")


def budget(entries: DataFrame, order: list[Column], head: int, limit: int) -> DataFrame:
    """entries (chars, line_chars, id_chars, ...) with rank (from 1, in an order that tells all entries apart) and shown: entries in order, as
    long as what is used, the entry and the list of all that follow stay within limit tokens of 4 characters; the first always is. Of
    those that follow, 100 are listed by line and 1,000 more by id.

    Sums over all entries before come from ranges of the order; what is listed after an entry is the difference of two such sums, so that
    it is looked up at the places where the lines and the ids end."""
    work = Stored(entries.sparkSession, "budget")
    rows = ordered.running(entries, order, {"__used": F.floor(F.col("chars") / 4), "__lines": F.col("line_chars"), "__ids": F.col("id_chars")}, work)
    rows = work.save(rows.withColumnRenamed("place", "rank"))
    total = lambda c: rows.agg(F.coalesce(F.sum(c), F.lit(0)).alias(c)).scalar()
    at_line = rows.select((F.col("rank") - 101).alias("rank"), F.col("__lines").alias("__lines_to"), F.col("__ids").alias("__ids_from"))
    at_id = rows.select((F.col("rank") - 1101).alias("rank"), F.col("__ids").alias("__ids_to"))
    rows = rows.join(at_line, "rank", "left").join(at_id, "rank", "left").withColumn("__all_lines", total("line_chars")).withColumn("__all_ids", total("id_chars"))
    lines = F.coalesce("__lines_to", "__all_lines") - F.col("__lines") - F.col("line_chars")
    ids = F.coalesce("__ids_to", "__all_ids") - F.coalesce("__ids_from", "__all_ids")
    over = head + F.col("__used") + F.floor((F.col("chars") + lines + ids) / 4) > limit
    cut = rows.where(over & (F.col("rank") > 1)).agg(F.min("rank").alias("cut")).scalar()
    return rows.select(*entries.columns, "rank", F.coalesce(F.col("rank") < cut, F.lit(True)).alias("shown"))
