"""The session that the library is meant to run in."""

from pyspark.sql import SparkSession


def build_session(app: str = "quarry", **conf: str) -> SparkSession:
    """UTC, adaptive execution and no broadcast that isn't sized at run time. On a cluster the master, the memory and
    spark.checkpoint.dir come from spark-submit; here only what the semantics need is set."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
