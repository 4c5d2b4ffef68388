"""Where queries and their SQL twins are registered, and what they share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Put a query in the catalog under `name`, with its SQL twin where there is one."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `v`, their value with every seventh one missing."""
    return table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


#: The same in SQL.
EVENTS = "e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that sums in any order compare. What rounds to zero keeps its sign, as it does in SQL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: beside the checkpoints of the session, or on this machine where it has none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="files-") + "/t"
