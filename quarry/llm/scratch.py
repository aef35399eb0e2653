"""Tables written to the folder that driver and executors share, to cut lineage and to give joins a plain exchange."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.stored import shared_root


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows with texts that an Arrow batch holds at most while a table is written here, and that a Python worker takes at a time from any
#: batch. A batch stands in the executor and again in the worker, several times while it grows; Spark's 10,000 rows are tens of MB.
BATCH_ROWS = 1000


class Scratch:
    """A folder of its own below the shared root. Writers commit a table as a whole, so a lost executor only repeats tasks."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/quarry-{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, form: str = "parquet", **options: str) -> DataFrame:
        """Writes a table and reads it back. The shuffle files behind it go as soon as it is written: nothing runs df again. Arrow batches
        are of BATCH_ROWS at most; a session's smaller number stays."""
        conf, cleanup, rows = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = {cleanup: conf.get(cleanup, "false"), rows: conf.get(rows)}
        held = int(before[rows])
        conf.set(cleanup, "true")
        conf.set(rows, BATCH_ROWS if held <= 0 else min(held, BATCH_ROWS))
        try:
            df.write.mode("overwrite").format(form).options(**options).save(f"{self.path}/{name}")
        finally:
            for key, value in before.items():
                conf.set(key, value)
        return self.spark.read.schema(df.schema).format(form).load(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.path}/{name}")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that docs has."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for x in ("_" * k + name for k in range(len(taken) + 1)) if x not in taken) for name in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
