"""Read-only SQL over the tables, with full-text searches in it."""

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import fulltext


class NotReadOnly(ValueError):
    """The text isn't one SELECT."""


@dataclass(frozen=True)
class Index:
    """Postings that SQL may search: for each table its kind of document and its columns."""

    postings: DataFrame
    tables: dict[str, tuple[str, tuple[str, ...]]]
    analyser: str = "plain"

    def search(self, table: str, query: str) -> DataFrame:
        kind, cols = self.tables[table]
        return fulltext.search(self.postings, kind, list(cols), query, self.analyser).select(F.col("doc").alias("id"))


#: What is no code in a statement, or a call fts_<table>('a full-text query').
CALL = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\bfts_(?P<table>\w+)\s*\(\s*'(?P<query>(?:[^']|'')*)'\s*\)""", re.S | re.I)


def with_matches(sql: str, index: Index, found: dict[str, DataFrame]) -> str:
    """The statement with each call of a search as the name of a view; found gets what the view has to show."""

    def view(m: re.Match) -> str:
        if not m["table"]:
            return m[0]
        if m["table"].lower() not in index.tables:
            raise NotReadOnly(f"no such full-text table: fts_{m['table']}")
        name = f"fts_{uuid.uuid4().hex}"
        found[name] = index.search(m["table"].lower(), m["query"].replace("''", "'"))
        return name

    return CALL.sub(view, sql)


def select(spark: SparkSession, sql: str, index: Index | None = None) -> DataFrame:
    """One SELECT. It stands in parentheses, where commands don't parse, and its plan is looked through for any.

    With an index, fts_<table>('query') stands for a table of the ids that match: each call is planned as a scan of the postings of its terms,
    which reach the stored index as filters, and joined as the statement says. A query that can't be parsed is a BadQuery."""
    found: dict[str, DataFrame] = {}
    sql = with_matches(sql, index, found) if index else sql
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    try:
        df = spark.sql(f"SELECT * FROM (\n{sql}\n)")
    except Exception as e:
        raise NotReadOnly(str(e).splitlines()[0]) from e
    finally:
        for name in found:  # the plan holds what they stood for
            spark.catalog.dropTempView(name)
    plan = df._jdf.queryExecution().analyzed()
    if "Command" in plan.nodeName() or plan.collectLeaves().toString().find("Command") >= 0:
        raise NotReadOnly("commands are not allowed")
    return df


def select_posts(spark: SparkSession, sql: str, posts: DataFrame, key: str = "pid", index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """The posts whose key the first column of a SELECT gives, and ignored (one number): its rows that are no such key, repeats included."""
    rows = select(spark, sql, index)
    first = rows.select(F.col(f"`{rows.columns[0]}`").alias("__first"))
    kind = dict(posts.dtypes)[key]
    value = F.col("__first").cast(kind) if dict(first.dtypes)["__first"] in ("tinyint", "smallint", "int", "bigint", kind) else F.lit(None).cast(kind)
    keys = first.select(value.alias(key))
    found = posts.join(keys.where(F.col(key).isNotNull()).distinct(), key, "left_semi")
    ignored = keys.join(found.select(F.col(key).alias("__found")), F.col(key) == F.col("__found"), "left").agg(F.count(F.when(F.col("__found").isNull(), 1)).alias("ignored"))
    return found, ignored
