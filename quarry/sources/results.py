"""Nested results and the outputs of a filter run."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

KEPT = "id string, pid long, score double, strong boolean, queries array<string>"


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON object a post, in order; the committer makes the folder appear as a whole."""
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_run(rows: DataFrame, path: str, run: int) -> None:
    """The verdicts or the kept posts of one run, in a folder of that run. Other runs stay as they are, so a run that fails while it writes
    takes nothing away; one that is done again replaces its own rows."""
    rows.write.mode("overwrite").json(f"{path}/run={run}")


def read_run(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The rows of the latest run (before one, if that is given); none where there was no run."""
    try:
        rows = spark.read.schema(schema).json(path).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"/run=(\d+)/", 1).cast("int"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = rows if before is None else rows.where(F.col("run") < before)
    return rows.where(F.col("run") == rows.agg(F.max("run")).scalar()).drop("run")
