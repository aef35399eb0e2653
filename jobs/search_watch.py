"""Watches a folder of documents for saved searches: a stream that takes what is new and ends.

    python -m jobs.search_watch --documents PATH --output PATH --checkpoint PATH [--config jobs/search_watch.json]

Reads the files of a table of documents that no earlier run with this checkpoint has read, in batches, and runs the saved full-text searches
over them. A hit is a search and a version of a document, a doc_id with a digest of its text. Hits are written once, with the text around the
first match and the length in tokens, as Parquet partitioned by search and batch. The checkpoint is that of Spark's stream.

A batch writes its own partitions and replaces what stands there, so a batch that runs again after a failure gives the same rows; versions
that an earlier batch has seen are left out, so a document that is delivered again gives no second hit. Started again without
new files, a run writes nothing. Documents without a doc_id or a text are left out.

Config: searches, by name, in the language of the full-text index; max_files_per_trigger, the files of a batch.
"""

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text
from quarry.operators import fulltext
from quarry.session import build_session

SCHEMA = "pid long, id string, version string, tokens long, shown string, search string, batch long"
log = logging.getLogger("jobs.search_watch")


def hits_of(documents: DataFrame, searches: dict[str, str]) -> DataFrame:
    """The hits in documents (doc_id, text), without batch."""
    known = documents.where("doc_id is not null and text is not null")
    versions = known.select(F.col("doc_id").alias("pid"), "text", F.sha2("text", 256).alias("version"))
    versions = versions.withColumn("doc", F.concat_ws(":", F.col("pid").cast("string"), F.col("version")))
    postings = fulltext.build_postings(versions.dropDuplicates(["doc"]), "post", "doc", ["text"])
    found = fulltext.search_all(postings, "post", ["text"], searches).withColumnRenamed("query", "search")
    rows = versions.dropDuplicates(["doc"]).join(found, "doc")
    shown = F.lit(None).cast("string")
    for name, query in searches.items():
        shown = F.when(F.col("search") == name, text.hit_window(F.col("text"), text.query_stems([query]))).otherwise(shown)
    return rows.select("pid", F.concat(F.lit("d"), F.col("pid").cast("string")).alias("id"), "version", F.floor(F.length("text") / 4).alias("tokens"), shown.alias("shown"), "search")


def taking(output: str, searches: dict[str, str], seen: list[int]):
    """What is done with each batch; seen gets the number of its documents."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(SCHEMA).parquet(output).where(F.col("batch") < number).select("pid", "version", "search")
        new = hits_of(batch, searches).join(earlier, ["pid", "version", "search"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("search", "batch").parquet(output)
        written = spark.read.schema(SCHEMA).parquet(output).where(F.col("batch") == number).groupBy("search").count().collect()
        seen.append(batch.count())
        log.info("batch %d: read %d documents, wrote %s", number, seen[-1], {r.search: r["count"] for r in written} or "no hits")

    return take


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes the new files at a path, waits until that is done, and returns all hits so far."""
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("search", "batch").parquet(output)  # so that the first batch can read it
    # A stream over a plain path wants a folder; as a pattern that matches that path alone it may be one file too.
    path = documents.rstrip("/")
    pattern = path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"
    files = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", config["max_files_per_trigger"]).option("maxFileAge", "36500d").parquet(pattern)
    seen: list[int] = []
    stream = files.writeStream.foreachBatch(taking(output, config["searches"], seen)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    log.info("read %d documents in %d batches from %s", sum(seen), len(seen), documents)
    every = spark.read.schema(SCHEMA).parquet(output)
    log.info("%d hits so far in %s", every.count(), output)
    return every


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--documents", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", default=__file__.removesuffix(".py") + ".json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = build_session("search_watch")
    try:
        run(spark, a.documents, a.output, a.checkpoint, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
