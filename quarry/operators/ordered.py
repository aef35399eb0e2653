"""One order over all rows, without one task for all rows: running sums, places and the next row's values.

The rows are written in ranges of the order. What a range needs of the others is one row for each of them: its sums and its first row.
The order has to tell all rows apart that shall not count as equal; any cut into ranges gives the same result."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.stored import Stored


def ranged(rows: DataFrame, order: list[Column], work: Stored) -> DataFrame:
    """rows with __part: the rows of a part stand before those of the next."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.save(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def in_parts(order: list[Column]):
    return Window.partitionBy("__part").orderBy(*order)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], work: Stored | None = None, place: str = "place") -> DataFrame:
    """rows with place (from 1) and, for each of sums, the sum over all rows before."""
    stored = ranged(rows, order, work or Stored(rows.sparkSession, "ordered"))
    every = {place: F.lit(1), **sums}
    totals = stored.groupBy("__part").agg(*(F.sum(c).alias(f"__{name}") for name, c in every.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = totals.select("__part", *(F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in every))
    above = in_parts(order).rowsBetween(Window.unboundedPreceding, -1)
    here = stored.select("*", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(name) for name, c in every.items()))
    out = here.join(F.broadcast(before), "__part")
    add = {name: F.col(name) + F.col(f"__{name}") + (1 if name == place else 0) for name in every}
    return out.select(*rows.columns, *(c.alias(name) for name, c in add.items()))


def with_next(rows: DataFrame, order: list[Column], values: list[str], work: Stored | None = None) -> DataFrame:
    """rows with next: a struct of values of the row that follows, null for the last."""
    stored = ranged(rows, order, work or Stored(rows.sparkSession, "ordered"))
    w = in_parts(order)
    firsts = stored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__part", F.struct(*values).alias("__first"))
    behind = firsts.select(F.lag("__part").over(Window.orderBy("__part")).alias("__part"), "__first").where("__part is not null")  # one row a part
    here = stored.withColumn("next", F.lead(F.struct(*values)).over(w)).join(F.broadcast(behind), "__part", "left")
    return here.select(*rows.columns, F.coalesce("next", "__first").alias("next"))
