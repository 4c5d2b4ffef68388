"""Readers. Formats that Spark splits are read by Spark; whole-file formats are decoded file by file on the executors.

`local_*` readers (stata, sas, spss, pickle, excel, hdf) decode one file on the driver with pandas; they are for files that fit it.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe.functions.elementwise import null_if_nan

Schema = StructType | str


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes missing, as everywhere in the engine."""
    return df.withColumns({c: null_if_nan(F.col(f"`{c}`")) for c, k in df.dtypes if k in ("float", "double")})


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Row groups in parallel; columns and filters reach the scan. Globs and hive partitions are understood."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df if where is None else df.filter(where)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", header: bool | None = True, names: Sequence[str] | None = None, schema: Schema | None = None, usecols: Sequence[str] | None = None, dtype: dict[str, str] | None = None,
    na_values: str | None = None, quotechar: str = '"', escapechar: str = '"', comment: str | None = None, skipinitialspace: bool = False, multiline: bool = False, parse_dates: dict[str, str] | None = None, compression: str | None = None,
    encoding: str = "utf-8", on_bad_lines: str = "error", nrows: int | None = None, samplingRatio: float = 1.0,
) -> DataFrame:
    """Splits of lines in parallel. `on_bad_lines`: error, or skip (a bare count parses no line, so it finds none bad). `parse_dates`: {column: strftime pattern, or "" to guess}."""
    r = spark.read.option("sep", sep).option("header", bool(header)).option("quote", quotechar).option("escape", escapechar).option("multiLine", multiline).option("encoding", encoding).option("mode", "FAILFAST" if on_bad_lines == "error" else "DROPMALFORMED")
    r = r.option("ignoreLeadingWhiteSpace", skipinitialspace)
    if on_bad_lines != "error":
        r = r.option("columnPruning", False)  # else a line is only bad if a column that is asked for is
    if na_values is not None:
        r = r.option("nullValue", na_values)
    if comment:
        r = r.option("comment", comment)
    if compression:
        r = r.option("compression", compression)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True).option("samplingRatio", samplingRatio)
    df = r.csv(path if isinstance(path, str) else list(path))
    if names:
        df = df.toDF(*names)
    for c, kind in (dtype or {}).items():
        df = df.withColumn(c, F.col(f"`{c}`").cast(kind))
    for c, fmt in (parse_dates or {}).items():
        from lumenframe.functions.elementwise import to_datetime

        df = df.withColumn(c, to_datetime(F.col(f"`{c}`"), fmt or None))
    if usecols:
        df = df.select(*[f"`{c}`" for c in usecols])
    return without_nan(df if nrows is None else df.limit(nrows))


def read_table(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return read_csv(spark, path, **{"sep": "\t", **options})


def read_fwf(spark: SparkSession, path: str, colspecs: Sequence[tuple[int, int]] | None = None, widths: Sequence[int] | None = None, names: Sequence[str] | None = None, schema: Schema | None = None) -> DataFrame:
    """Lines cut at fixed places, stripped and cast."""
    if colspecs is None:
        at, colspecs = 0, []
        for w in widths or ():
            colspecs.append((at, at + w))
            at += w
    kinds = [f.dataType.simpleString() for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema)] if schema is not None else ["string"] * len(colspecs)
    names = list(names) if names else [f.name for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema)] if schema is not None else [f"c{k}" for k in range(len(colspecs))]
    cells = [F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")).cast(k).alias(n) for (a, b), k, n in zip(colspecs, kinds, names, strict=True)]
    return spark.read.text(path).select(*cells)


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: Schema | None = None) -> DataFrame:
    """A record a line in parallel; with lines off, whole files."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_orc(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.orc(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: Schema | None = None) -> DataFrame:
    r = spark.read.option("rowTag", row_tag)
    return (r.schema(schema) if schema is not None else r).xml(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_files(spark: SparkSession, path: str, decode: Callable[[bytes], pa.Table], schema: Schema) -> DataFrame:
    """Each whole file decoded on an executor; a file must fit a task, the number of files is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from decode(content).to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _arrow_ddl(kind: pa.Schema) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(kind)


def read_feather(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: Schema | None = None) -> DataFrame:
    """Arrow IPC files, one task each; the schema comes from the first file's footer unless given."""
    import pyarrow.feather as feather

    if schema is None:
        head = spark.read.format("binaryFile").load(path).select("content").first()
        if head is None:
            raise FileNotFoundError(path)
        schema = _arrow_ddl(feather.read_table(io.BytesIO(head[0]), columns=list(columns) if columns else None).schema)
    return read_files(spark, path, lambda b: feather.read_table(io.BytesIO(b), columns=list(columns) if columns else None), schema)


def read_custom_text(spark: SparkSession, path: str, parser: Callable[[str], dict], schema: Schema) -> DataFrame:
    """func(line) -> dict for each line, in Arrow batches; None leaves the line out."""
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for r in map(parser, pdf["value"]) if r is not None]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path).mapInPandas(run, schema)


def read_sql(spark: SparkSession, query: str, url: str, column: str | None = None, lower: object = None, upper: object = None, partitions: int = 1, properties: dict[str, str] | None = None) -> DataFrame:
    """A query in a database over JDBC; with a numeric, date or time column and bounds, so many range queries run side by side."""
    r = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if column is None:
        return r.option("query", query).load()
    r = r.option("dbtable", f"({query}) t").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return r.load()


def read_sql_table(spark: SparkSession, table: str, url: str, **options: object) -> DataFrame:
    return read_sql(spark, f"SELECT * FROM {table}", url, **options)


def read_sql_connection(spark: SparkSession, query: str, connect: Callable[[], object], column: str, lower: int, upper: int, partitions: int, schema: Schema) -> DataFrame:
    """The same over any Python database connection: each task opens its own and reads the rows of one range of `column`."""
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names
    width = -(-(upper - lower + 1) // partitions)
    ranges = spark.createDataFrame([(lower + k * width, min(upper, lower + (k + 1) * width - 1)) for k in range(partitions) if lower + k * width <= upper], "low bigint, high bigint").repartition(partitions, "low")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for low, high in zip(pdf["low"], pdf["high"], strict=True):
                link = connect()
                try:
                    cursor = link.cursor()
                    cursor.execute(f"SELECT {', '.join(names)} FROM ({query}) t WHERE {column} >= {int(low)} AND {column} <= {int(high)}")
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)
                finally:
                    link.close()

    return ranges.mapInPandas(run, schema)


def read_html(df: DataFrame, html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., table, row, cells) for every row of every table in a column of pages; nested tables belong to the outer one."""
    schema = StructType([*[df.schema[c] for c in keep], *StructType.fromDDL("table int, row int, cells array<string>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for t, rows in enumerate(_tables(r[-1] or "")):
                    out += [(*r[:-1], t, k, cells) for k, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=schema.names)

    return df.select(*keep, html).mapInPandas(run, schema)


def _tables(page: str) -> list[list[list[str]]]:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.tables: list[list[list[str]]] = []
            self.depth, self.cell = 0, None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "table":
                self.depth += 1
                if self.depth == 1:
                    self.tables.append([])
            elif self.depth == 1 and tag == "tr":
                self.tables[-1].append([])
            elif self.depth == 1 and tag in ("td", "th"):
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append("")
                self.cell = True

        def handle_endtag(self, tag: str) -> None:
            if tag == "table" and self.depth:
                self.depth -= 1
            elif self.depth == 1 and tag in ("td", "th"):
                self.tables[-1][-1][-1] = " ".join(self.tables[-1][-1][-1].split()) if self.tables[-1] and self.tables[-1][-1] else ""
                self.cell = None

        def handle_data(self, data: str) -> None:
            if self.cell and self.tables and self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += data

    reader = Reader()
    reader.feed(page)
    return reader.tables


def json_normalize(df: DataFrame, column: str | None = None, record_path: str | None = None, meta: Sequence[str] = (), sep: str = ".", max_level: int | None = None) -> DataFrame:
    """Structs to columns named by their path; with record_path, a row for each element of that list."""
    if record_path:
        path = record_path if column is None else f"{column}.{record_path}"
        df = df.select(*[F.col(m if column is None else f"{column}.{m}").alias(m.replace(".", sep)) for m in meta], F.explode(path).alias("__r"))
        if isinstance(df.schema["__r"].dataType, StructType):
            return json_normalize(df.select(*[c for c in df.columns if c != "__r"], "__r.*"), sep=sep, max_level=max_level)
        return df.withColumnRenamed("__r", record_path)
    if column is not None:
        df = df.select(*[f"`{c}`" for c in df.columns if c != column], f"{column}.*")
    level = 0
    while any(isinstance(f.dataType, StructType) for f in df.schema.fields) and (max_level is None or level < max_level):
        df = df.select(*[x for f in df.schema.fields for x in ([F.col(f"`{f.name}`")[g].alias(f"{f.name}{sep}{g}") for g in f.dataType.names] if isinstance(f.dataType, StructType) else [F.col(f"`{f.name}`")])])
        level += 1
    return df


def read_pickle_parts(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """What writers.to_pickle_parts wrote. Unpickling runs code: only for files of one's own."""
    import pickle

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf["pickle"]:
                yield pickle.loads(bytes(x))

    return spark.read.parquet(path).mapInPandas(run, schema)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    return without_nan(spark.createDataFrame(pdf))


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return without_nan(spark.createDataFrame(table))


def from_dataframe(spark: SparkSession, other: object) -> DataFrame:
    """Any frame with the interchange protocol."""
    from pyarrow.interchange import from_dataframe as convert

    return from_arrow(spark, convert(other))


def from_dict(spark: SparkSession, data: dict, schema: Schema | None = None) -> DataFrame:
    pdf = pd.DataFrame(data)
    return without_nan(spark.createDataFrame(pdf, schema) if schema is not None else spark.createDataFrame(pdf))


def local(kind: str) -> Callable[..., DataFrame]:
    """A reader of one file on the driver: stata, sas, spss, pickle, excel, hdf, clipboard."""

    def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
        return from_pandas(spark, getattr(pd, f"read_{kind}")(path, **options))

    return read


read_stata, read_sas, read_spss, read_pickle, read_excel, read_hdf = map(local, ("stata", "sas", "spss", "pickle", "excel", "hdf"))


def read_clipboard(spark: SparkSession, **options: object) -> DataFrame:
    return from_pandas(spark, pd.read_clipboard(**options))
