"""JSON Lines chunks and their catalogue."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import spans
from quarry.sources.schemas import CHUNKS, FIELDS, RAW


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def write_catalogue(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def parse_marker(marker) -> tuple[int, int] | None:
    """rows and finished_at of a completion marker; None for an empty or broken one, whose chunk then is unfinished."""
    parts = (marker or "").split()
    return (int(parts[0]), int(parts[1])) if len(parts) > 1 and parts[0].isdigit() and parts[1].isdigit() else None


def wanted(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """The finished chunks that overlap the window of their sub (sub, after, before; a null before is open)."""
    w = windows.select(F.lower("sub").alias("__sub"), "after", "before")
    on = (F.lower("sub") == F.col("__sub")) & F.col("finished_at").isNotNull() & (F.col("end") > F.col("after")) & (F.col("before").isNull() | (F.col("start") < F.col("before")))
    return chunks.join(w, on).drop("__sub")


def read_chunks(spark: SparkSession, root: str, chunks: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    """The raw records of a kind in their window, with sub, finished_at, file and __line: only files that the catalogue says overlap are
    opened; lines that aren't JSON objects are skipped. The catalogue is small; the list of its files goes to the reader."""
    picked = wanted(chunks, windows).where(F.col("kind") == kind)
    files = [f"{root}/{r.sub.lower()}/{r.file}" for r in picked.select("sub", "file").distinct().collect()]
    schema = RAW[kind] + ", _corrupt string"
    if not files:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(files)
    # A chunk is a file or a folder of part files; names come as URLs.
    parts = F.split(F.url_decode(F.replace(F.input_file_name() if files else F.lit(""), F.lit("+"), F.lit("%2B"))), "/")
    parts = F.when(F.startswith(F.element_at(parts, -1), F.lit("part-")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = rows.withColumn("__path", parts).withColumn("__line", F.monotonically_increasing_id()).where("_corrupt is null and id is not null").drop("_corrupt")
    rows = rows.withColumn("__file", F.element_at("__path", -1)).withColumn("__sub", F.get("__path", F.size("__path") - 2) if files else F.lit(""))
    info = F.broadcast(picked.select(F.lower("sub").alias("__sub"), "sub", F.col("file").alias("__file"), "after", "before", "finished_at"))  # the catalogue's rows
    inside = (F.coalesce("created_utc", F.lit(0)) >= F.col("after")) & (F.col("before").isNull() | (F.coalesce("created_utc", F.lit(0)) < F.col("before")))
    return rows.join(info, ["__sub", "__file"]).where(inside).drop("__sub", "__path", "after", "before").withColumnRenamed("__file", "file")


def newest_wins(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: that with the greatest version. max_by aggregates before the shuffle, so a key with very many copies is no burden."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("__row")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best).select("__row.*")


def resume_point(rows: DataFrame) -> DataFrame:
    """n, last, ids of an unfinished chunk: how many rows it has, its last second and the ids written in that second."""
    last = rows.agg(F.count(F.lit(1)).alias("n"), F.max("created_utc").alias("last"))
    ids = rows.join(last.select("last"), F.col("created_utc") == F.col("last"), "left_semi").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return last.withColumn("ids", ids.scalar())


def import_file(spark: SparkSession, path: str, sub: str, kind: str, after: int, before: int) -> DataFrame:
    """The records of a saved file as a finished chunk holds them: of this sub, in range, the known fields, by time. A file that holds only
    other subs is an error; stray rows of others are passed over."""
    schema = RAW[kind] + (", subreddit string" if "subreddit" not in FIELDS[kind] else "") + ", _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and created_utc is not null")
    ours = F.lower(F.coalesce("subreddit", F.lit(""))) == sub.lower()
    counts = rows.agg(F.count(F.when(ours, 1)).alias("ours"), F.count(F.when(~ours, 1)).alias("others")).first()
    if counts.others and not counts.ours:
        raise ValueError(f"{path} holds another sub, not {sub}")
    return rows.where(ours & (F.col("created_utc") >= after) & (F.col("created_utc") < before)).select(*FIELDS[kind]).sort("created_utc", "id")


def newest_file(files: DataFrame, sub: str, kind: str) -> DataFrame:
    """path of the newest file of a sub and kind, also a numbered second copy. files: path, modified (as of a binaryFile listing)."""
    name = F.element_at(F.split("path", "/"), -1)
    mine = files.where(name.rlike(rf"(?i)^r_{sub}_{kind}( \(\d+\))?\.jsonl$"))
    return mine.agg(F.max_by("path", F.struct("modified", "path")).alias("path")).where("path is not null")


def cache_listing(chunks: DataFrame) -> DataFrame:
    """sub, kind, start, end, rows: the merged spans of the finished chunks, and the rows of all of them."""
    done = chunks.where("finished_at is not null")
    merged = spans.islands(done.select("sub", "kind", "start", "end"), ["sub", "kind"])
    return merged.join(done.groupBy("sub", "kind").agg(F.sum("rows").alias("rows")), ["sub", "kind"])


def import_chunk(spark: SparkSession, folder: str, root: str, sub: str, kind: str, after: int, before: int | None, catalogue: DataFrame, now: int, remove: bool = False) -> DataFrame:
    """Takes the newest saved file of a sub and kind in a folder into the chunks below root, as a finished chunk, and gives the catalogue with it.
    The end of an open span is when the file was saved. A file that is missing, still being written or of another sub is an error
    before anything is written; remove: the saved file goes once its chunk is there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    files = files.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), F.unix_seconds("modificationTime").alias("modified"))
    picked = newest_file(files, sub, kind).join(files, "path").first()
    if picked is None:
        raise ValueError(f"no saved file of {kind} of {sub} in {folder}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(picked.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path(f"{picked.path}.crswap")):
        raise ValueError(f"{picked.path} is still being written")
    end = before if before is not None else picked.modified
    mine = catalogue.where((F.lower("sub") == sub.lower()) & (F.col("kind") == kind))
    last = mine.agg(F.max(F.try_element_at(F.split("file", r"\."), F.lit(2)).try_cast("int")).alias("n")).first().n or 0
    name = f"{kind}.{last + 1:04d}.jsonl"
    import_file(spark, picked.path, sub, kind, after, end).write.mode("overwrite").json(f"{root}/{sub.lower()}/{name}")
    n = spark.read.schema(RAW[kind]).json(f"{root}/{sub.lower()}/{name}").count()
    if remove:
        store.delete(path(picked.path), False)
    return catalogue.unionByName(spark.createDataFrame([(sub, kind, name, after, end, 0, n, now)], CHUNKS))
