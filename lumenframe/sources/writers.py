"""Writers. Folders of part files are written by all executors; single-file formats go through the driver and say so."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_parquet(df: DataFrame, path: str, partition_cols: Sequence[str] = (), compression: str = "snappy", mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(path)


def to_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, na_rep: str = "", single: bool = False, mode: str = "overwrite", **options: object) -> None:
    """A folder of files; `single` makes it one file, which one task writes."""
    (df.coalesce(1) if single else df).write.mode(mode).option("sep", sep).option("header", header).option("nullValue", na_rep).option("escape", '"').options(**options).csv(path)


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def to_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def to_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "data", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("rowTag", row_tag).option("rootTag", root_tag).xml(path)


def to_text(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    df.select(column).write.mode(mode).text(path)


def to_sql(df: DataFrame, table: str, url: str, if_exists: str = "fail", properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, table, {"fail": "errorifexists", "append": "append", "replace": "overwrite"}[if_exists], properties or {})


def to_noop(df: DataFrame) -> None:
    """Compute every row and keep none: for timing."""
    df.write.format("noop").mode("overwrite").save()


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_numpy(df: DataFrame) -> object:
    return df.toPandas().to_numpy()


def to_dict(df: DataFrame, orient: str = "dict") -> dict | list:
    return df.toPandas().to_dict(orient)


def to_records(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def to_list(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(F.col(f"`{column}`")).collect()]


#: Rows that a rendering shows at most unless told otherwise.
SHOWN = 1000


def _rendered(df: DataFrame, how: str, n: int, **options: object) -> str:
    return getattr(df.limit(n).toPandas(), how)(**options)


def to_html(df: DataFrame, n: int = SHOWN, **options: object) -> str:
    return _rendered(df, "to_html", n, **options)


def to_string(df: DataFrame, n: int = SHOWN, **options: object) -> str:
    return _rendered(df, "to_string", n, **options)


def to_markdown(df: DataFrame, n: int = SHOWN) -> str:
    pdf = df.limit(n).toPandas()
    rows = [list(pdf.columns), ["---"] * len(pdf.columns), *pdf.astype(str).values.tolist()]
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in rows)


def to_latex(df: DataFrame, n: int = SHOWN) -> str:
    pdf = df.limit(n).toPandas()
    body = " \\\\\n".join(" & ".join(map(str, r)) for r in [list(pdf.columns), *pdf.values.tolist()])
    return "\\begin{tabular}{" + "l" * len(pdf.columns) + "}\n" + body + " \\\\\n\\end{tabular}"


def to_pickle(df: DataFrame, path: str) -> None:
    df.toPandas().to_pickle(path)


def to_excel(df: DataFrame, path: str, **options: object) -> None:
    """One workbook by the driver; needs a library that writes them."""
    df.toPandas().to_excel(path, index=False, **options)


def to_hdf(df: DataFrame, path: str, key: str = "table") -> None:
    df.toPandas().to_hdf(path, key=key)


def to_clipboard(df: DataFrame, n: int = SHOWN) -> None:
    df.limit(n).toPandas().to_clipboard(index=False)


def to_pickle_parts(df: DataFrame, path: str) -> None:
    """A pickled pandas frame for each batch of rows, held in a folder of parquet, written by all executors."""
    import pickle
    from collections.abc import Iterator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"pickle": [pickle.dumps(pdf)]})

    df.mapInPandas(run, "pickle binary").write.mode("overwrite").parquet(path)


def to_feather(df: DataFrame, path: str) -> None:
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), path)


def to_stata(df: DataFrame, path: str) -> None:
    df.toPandas().to_stata(path, write_index=False)
