"""Streams: the same bins and groups over tables that grow, with watermarks that bound what must be remembered."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None, only: str | None = None) -> DataFrame:
    """A folder whose new files come in; `only` is a glob for their names."""
    r = spark.readStream.schema(schema)
    r = r.option("pathGlobFilter", only) if only else r
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).format(fmt).load(path)


def _late(df: DataFrame, on: str, late: str | None) -> DataFrame:
    """A watermark, which wants an instant: times without zone are taken as UTC."""
    return df.withColumn(on, F.col(on).cast("timestamp")).withWatermark(on, late) if late else df


def tumbling(df: DataFrame, on: str, size: str, aggs: dict[str, Column], by: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window start, window end, by..., aggregates) of each window of `size`, every `slide`; rows later than `late` are not waited for."""
    df = _late(df, on, late)
    out = df.groupBy(F.window(on, size, slide) if slide else F.window(on, size), *by).agg(*[v.alias(k) for k, v in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggs)


def sessions(df: DataFrame, on: str, gap: str, aggs: dict[str, Column], by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """Windows that end when nothing came for `gap`."""
    df = _late(df, on, late)
    out = df.groupBy(F.session_window(on, gap).alias("session"), *by).agg(*[v.alias(k) for k, v in aggs.items()])
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *by, *aggs)


def distinct(df: DataFrame, on: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key; keys are remembered as long as the watermark asks."""
    return _late(df, on, late).dropDuplicatesWithinWatermark(list(keys))


def running(df: DataFrame, key: str, value: str, key_type: str = "bigint") -> DataFrame:
    """(key, n, total): count and sum of each key so far, kept as state between batches."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            n, total = n + len(pdf), total + float(pdf[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all there is now, into an in-memory table of that name."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", every: str | None = None) -> StreamingQuery:
    w = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
