"""Half-open spans of seconds: union, gaps and what a cache lacks, as gaps-and-islands windows over (keys, start, end)."""

from pyspark.sql import DataFrame, Window, functions as F

DAY = 86400
#: How long scores take to settle: a finished chunk counts up to this long before it was downloaded.
SETTLE = 2 * DAY
CHUNK_ITEMS = 20_000


def islands(spans: DataFrame, keys: list[str], apart: int = 0) -> DataFrame:
    """keys, start, end of the unions of spans; spans no further apart are one (0: those that touch)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(F.col("start") > reach + apart, 1).when(reach.isNull(), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def gaps(spans: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of what no span covers of each window. windows: keys, after, before; one a key. A window without a span is one
    gap; empty parts are left out."""
    merged = islands(spans.where(F.col("end") > F.col("start")), keys).join(windows, keys)
    clipped = merged.where((F.col("end") > F.col("after")) & (F.col("start") < F.col("before")))
    clipped = clipped.select(*keys, F.greatest("start", "after").alias("start"), F.least("end", "before").alias("end"))
    edges = clipped.unionByName(windows.select(*keys, F.col("after").alias("start"), F.col("after").alias("end"))).unionByName(windows.select(*keys, F.col("before").alias("start"), F.col("before").alias("end")))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return edges.select(*keys, F.lag("end").over(w).alias("gap_start"), F.col("start").alias("gap_end")).where("gap_end > gap_start").select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def to_fetch(chunks: DataFrame, windows: DataFrame, keys: list[str], resume: bool = True) -> DataFrame:
    """keys, start, end to fetch. chunks: keys, start, end, finished_at (null: unfinished, which counts in full if it is resumed, else
    not). Gaps less than a day apart are one."""
    trusted = F.when(F.col("finished_at").isNull(), F.col("end")).otherwise(F.least("end", F.col("finished_at") - SETTLE))
    counted = chunks if resume else chunks.where("finished_at is not null")
    return islands(gaps(counted.select(*keys, "start", trusted.alias("end")), windows, keys), keys, apart=DAY - 1)


def holes(chunks: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """What is missing between the start of each window and the last second that a finished chunk reaches; a window without any finished
    chunk is a row of nulls."""
    done = chunks.where("finished_at is not null")
    reach = done.groupBy(*keys).agg(F.max("end").alias("before"))
    span = windows.select(*keys, "after").join(reach, keys)
    missing = gaps(done.select(*keys, "start", "end"), span.where("before > after"), keys)
    none = windows.join(reach, keys, "left_anti").select(*keys, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return missing.unionByName(none)


def plan_chunks(days: DataFrame, windows: DataFrame, keys: list[str], items: int = CHUNK_ITEMS) -> DataFrame:
    """keys, start, end, est: each window cut after the day on which the running sum since the last cut reaches items, unless that day
    reaches the end. days: keys, day, n. The sum starts again at each cut, which no window function does: the days of one key, at most
    a few thousand, are folded in order."""
    ordered = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"))
    rows = windows.join(ordered, keys, "left")
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, est: bigint>>)")
    state = F.struct(empty.alias("done"), F.col("after").cast("long").alias("start"), F.lit(0).cast("long").alias("est"))

    def step(s, d):
        total, end = s.est + d.n, d.day + DAY
        cut = (total >= items) & (end < F.col("before"))
        return F.struct(
            F.when(cut, F.concat(s.done, F.array(F.struct(s.start.alias("start"), end.cast("long").alias("end"), total.cast("long").alias("est"))))).otherwise(s.done).alias("done"),
            F.when(cut, end).otherwise(s.start).cast("long").alias("start"), F.when(cut, 0).otherwise(total).cast("long").alias("est"))

    days_or_none = F.coalesce("days", F.expr("cast(array() as array<struct<day: bigint, n: bigint>>)"))
    folded = rows.select(*keys, "before", F.aggregate(days_or_none, state, step).alias("s"))
    last = F.array(F.struct(F.col("s.start").alias("start"), F.col("before").cast("long").alias("end"), F.col("s.est").alias("est")))
    return folded.select(*keys, F.explode(F.concat("s.done", last)).alias("c")).select(*keys, "c.start", "c.end", "c.est")


def superseded(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The finished chunks (keys, file) that the finished ones left cover, tried from the oldest on. Whether one goes depends on those that
    went before it, so the catalogue of one key is swept in order: over the seconds at which chunks begin or end, it counts how many
    chunks are left, and one goes if others are left all along it."""
    import numpy as np
    import pandas as pd

    fields = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["finished_at", "start", "end", "file"])
        cuts = np.unique(np.r_[rows["start"].to_numpy(), rows["end"].to_numpy()])
        first, last = np.searchsorted(cuts, rows["start"].to_numpy()), np.searchsorted(cuts, rows["end"].to_numpy())
        change = np.zeros(len(cuts) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, np.maximum(first, last), -1)
        left, gone = np.cumsum(change), np.zeros(len(rows), bool)
        for k, (a, b) in enumerate(zip(first, last)):
            if b <= a or left[a:b].min() > 1:
                gone[k] = True
                left[a:b] -= 1
        return rows.loc[gone, [*keys, "file"]]

    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, "file"])
    return chunks.where("finished_at is not null").select(*keys, "file", "start", "end", "finished_at").groupBy(*keys).applyInPandas(walk, schema)


def day_counts(rows: DataFrame, keys: list[str], created: str = "created") -> DataFrame:
    """keys, day (its first second), n."""
    day = F.floor(F.col(created) / DAY) * DAY
    return rows.groupBy(*keys, day.cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def uncached_items(days: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the items of the days that overlap any span to fetch. The join is by key; the spans of a key are few."""
    hit = days.join(todo, keys).where((F.col("day") < F.col("end")) & (F.col("day") + DAY > F.col("start"))).select(*keys, "day", "n").distinct()
    return hit.groupBy(*keys).agg(F.sum("n").alias("n"))


def short_chunks(chunks: DataFrame) -> DataFrame:
    """Finished chunks with far fewer rows than were expected: under 70 % and at least 500 fewer."""
    return chunks.where((F.col("rows") < 0.7 * F.col("est")) & (F.col("est") - F.col("rows") >= 500))


def fetch_order(chunks: DataFrame) -> DataFrame:
    """The chunks that aren't finished, largest first."""
    return chunks.where("finished_at is null").orderBy(F.desc("est"), "start", "file")


def totals(chunks: DataFrame, after: int, before: int, keys: list[str]) -> DataFrame:
    """keys, cached (rows of the finished chunks that overlap the window), chunks (those that aren't finished) and est (items in them)."""
    here = chunks.where((F.col("start") < before) & (F.col("end") > after))
    done = F.col("finished_at").isNotNull()
    return here.groupBy(*keys).agg(F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("cached"), F.count(F.when(~done, 1)).alias("chunks"), F.coalesce(F.sum(F.when(~done, F.col("est"))), F.lit(0)).alias("est"))


def catalogue(subs: DataFrame, days: DataFrame, todo: DataFrame, prefix: str = "", names: list[str] | None = None, most: int = 15) -> DataFrame:
    """sub, found, posts, comments, missing, busy_s, quiet_s: of the subs whose name starts with the prefix (the first so many by name) and of
    those named, how many items there are, how many aren't cached, and the seconds that takes at 15 and at 300 items a second. A name
    that isn't there is a row with found false. subs: sub; days: sub, kind (posts, comments), day, n; todo: sub, kind, start, end."""
    spark = subs.sparkSession
    every = subs.select("sub", F.lower("sub").alias("__key"))
    asked = spark.createDataFrame([(n, n.lower()) for n in dict.fromkeys(names or [])], "__name string, __key string")
    by_prefix = every.where(F.startswith("__key", F.lit(prefix.lower()))).orderBy("__key").limit(most) if prefix else every.limit(0)
    named = F.broadcast(asked).join(every, "__key", "left").select(F.coalesce("sub", "__name").alias("sub"), F.col("sub").isNotNull().alias("found"))
    picked = F.broadcast(by_prefix.select("sub", F.lit(True).alias("found")).unionByName(named).distinct())
    sizes = days.join(picked, "sub", "left_semi").groupBy("sub").agg(F.sum(F.when(F.col("kind") == "posts", F.col("n"))).alias("posts"), F.sum(F.when(F.col("kind") == "comments", F.col("n"))).alias("comments"))
    missing = uncached_items(days.join(picked, "sub", "left_semi"), todo, ["sub", "kind"]).groupBy("sub").agg(F.sum("n").alias("missing"))
    rows = picked.join(sizes, "sub", "left").join(missing, "sub", "left")
    number = lambda c: F.when(F.col("found"), F.coalesce(c, F.lit(0)))
    return rows.select("sub", "found", number("posts").alias("posts"), number("comments").alias("comments"), number("missing").alias("missing"), F.floor(number("missing") / 15).alias("busy_s"), F.floor(number("missing") / 300).alias("quiet_s"))
