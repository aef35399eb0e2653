"""Tables written to the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local master takes the warehouse (tests, single machines); a cluster has no
    folder that all of it sees then, which is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Stored:
    """A folder of its own below a path, or below the shared root. A table that is written there cuts lineage: after the loss of an executor
    only tasks that read it run again."""

    def __init__(self, spark: SparkSession, what: str, path: str | None = None):
        self.spark, self.path, self.n, self.there = spark, path or f"{shared_root(spark)}/quarry-{what}-{uuid.uuid4().hex}", 0, set()

    def save(self, df: DataFrame, name: str | None = None, by: str | None = None) -> DataFrame:
        """The table read back; by: a column that it is partitioned by."""
        self.n += 1
        where = f"{self.path}/{name or f't{self.n}'}"
        df.write.mode("overwrite").partitionBy(*([by] if by else [])).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        """An appended table; empty before the first append."""
        if name not in self.there:
            self.append(self.spark.createDataFrame([], schema), name)
            self.there.add(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
