"""A stream over a folder into which chunks are put. Newest-wins needs all versions of a row, so each batch is merged into the table of
current rows: rows of the batch replace older ones of the same id in the buckets that they touch."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.sources.chunks import newest_wins
from quarry.sources.schemas import RAW


def read_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    rows = spark.readStream.schema(RAW[kind] + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.where("_corrupt is null and id is not null").drop("_corrupt").withColumn("arrived", F.col("_metadata.file_modification_time"))


def generations(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The batches that each bucket of the table has, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for s in store.globStatus(hadoop(f"{table}/bucket=*/batch=*")) or []:
        bucket, batch = (int(x.split("=")[1]) for x in s.getPath().toString().split("/")[-2:])
        found.setdefault(bucket, []).append(batch)
    return {b: sorted(n) for b, n in found.items()}


def read_generations(spark: SparkSession, table: str, wanted: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/bucket={b}/batch={n}" for b, n in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(table: str, version: list[str], buckets: int = 64):
    """A function for foreachBatch. Ids are dealt over buckets; a batch writes a new generation of those that it touches, from their last one
    and its own rows, and leaves the others as they are. A batch that is run again gives the same generations; the last but one of
    each bucket stays for readers that have begun."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        have = generations(spark, table)
        older = {b: max(n for n in have[b] if n < number) for b in touched if any(n < number for n in have.get(b, []))}
        before = read_generations(spark, table, older, batch.schema).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        merged = newest_wins(rows.unionByName(before), ["id"], version).withColumn("batch", F.lit(number))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = hadoop(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for b, n in older.items():
            for old in (x for x in have[b] if x < n):
                store.delete(hadoop(f"{table}/bucket={b}/batch={old}"), True)

    return run


def current(spark: SparkSession, table: str, kind: str) -> DataFrame:
    """The current rows: the last generation of each bucket."""
    return read_generations(spark, table, {b: n[-1] for b, n in generations(spark, table).items()}, RAW[kind] + ", arrived timestamp")
