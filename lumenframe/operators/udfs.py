"""Python functions over tables, batches of stages, splits and hand-offs. Batches travel by Arrow; nothing runs row by row but what asks for it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def apply_rows(df: DataFrame, func: Callable[[pd.Series], object], schema: Schema) -> DataFrame:
    """func(row) for each row, giving a dict, a tuple or one value for the columns of the schema."""
    width = len(StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names)
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [func(r) for _, r in pdf.iterrows()]
            yield pd.DataFrame([[x[n] for n in names] if isinstance(x, dict) else list(x) if width > 1 else [x] for x in rows], columns=names)

    return df.mapInPandas(run, schema)


def apply_batches(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: Schema) -> DataFrame:
    """func of each Arrow batch as a pandas frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield func(pdf)

    return df.mapInPandas(run, schema)


def map_elements(c: Column, func: Callable[[object], object], kind: str) -> Column:
    """func of each value that is not missing."""

    @F.pandas_udf(kind)  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x != x else func(x))

    return run(c)


def map_series(c: Column, func: Callable[[pd.Series], pd.Series], kind: str) -> Column:
    """func of whole batches of values."""

    @F.pandas_udf(kind)  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        return func(s)

    return run(c)


def applymap(df: DataFrame, func: Callable[[object], object], columns: Sequence[str], kind: str) -> DataFrame:
    return df.withColumns({c: map_elements(F.col(f"`{c}`"), func, kind) for c in columns})


def user_aggregate(func: Callable[[pd.Series], float], kind: str = "double") -> Callable[[Column], Column]:
    """A Python aggregate of a group's values; a group must fit a task. `decomposed` has a form for groups of any size."""

    @F.pandas_udf(kind)  # type: ignore[call-overload]
    def run(s: pd.Series) -> float:
        return func(s)

    return run


def decomposed(df: DataFrame, by: Sequence[str], mapped: dict[str, Column], reduced: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """A user's map and reduce aggregate out of expressions: row values, their partial-and-final combination, and a last projection."""
    return df.withColumns(mapped).groupBy(*by).agg(*[v.alias(k) for k, v in reduced.items()]).select(*by, *[v.alias(k) for k, v in final.items()])


class Pipeline:
    """Stages of batch functions chained over a table, planned as one pass; some may fan out and be reduced, or be outputs.

    A stage is func(pandas frame) -> pandas frame with its schema. fan_out stages run once for each of so many copies of the
    input, tagged by a column; reduce_by then combines the copies by an aggregate.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.outputs: dict[str, DataFrame] = {}

    def stage(self, func: Callable[[pd.DataFrame], pd.DataFrame], schema: Schema, output: str | None = None) -> Pipeline:
        self.df = apply_batches(self.df, func, schema)
        if output:
            self.outputs[output] = self.df
        return self

    def fan_out(self, func: Callable[[pd.DataFrame, int], pd.DataFrame], copies: int, schema: Schema, tag: str = "copy") -> Pipeline:
        tagged = self.df.withColumn(tag, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([func(part, int(k)) for k, part in pdf.groupby(tag)] or [pdf])

        self.df = apply_batches(tagged, run, schema)
        return self

    def reduce_by(self, by: Sequence[str], **aggregates: Column) -> Pipeline:
        self.df = self.df.groupBy(*by).agg(*[v.alias(k) for k, v in aggregates.items()])
        return self

    def compute(self) -> dict[str, DataFrame]:
        return {**self.outputs, "result": self.df}


def train_test_split(df: DataFrame, test_size: float = 0.25, seed: int = 0, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key (or of all columns), so that both parts are the same in every run and nothing shuffles."""
    draw = F.pmod(F.xxhash64(*([key] if key else df.columns), F.lit(seed)), F.lit(1_000_000))
    edge = int(test_size * 1_000_000)
    return df.filter(draw >= edge), df.filter(draw < edge)


def batches(df: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Rows to a local consumer, `size` at a time; one partition is held at once."""
    rows: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def from_map(spark: SparkSession, func: Callable[[object], pd.DataFrame], items: Iterable, schema: Schema) -> DataFrame:
    """func of each item makes rows, on the executors."""
    import pickle

    given = spark.createDataFrame([(i, pickle.dumps(x)) for i, x in enumerate(items)], "i int, item binary").repartition("i")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for x in pdf["item"]:
                yield func(pickle.loads(bytes(x)))

    return given.mapInPandas(run, schema)


def partitions(df: DataFrame) -> DataFrame:
    """(partition, rows): how the table is dealt."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


_EXTENSIONS: dict[str, Callable] = {}


def register_extension(name: str) -> Callable[[Callable], Callable]:
    """Put a user's function of a frame under a name; `extension(name)(df, ...)` calls it."""

    def add(f: Callable) -> Callable:
        _EXTENSIONS[name] = f
        return f

    return add


def extension(name: str) -> Callable:
    return _EXTENSIONS[name]
