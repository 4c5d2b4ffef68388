"""What the operators share of the session: checkpoints in the shared folder, and batch sizes for Arrow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Parts (slices, buckets) that one sender of packed rows knows, at most; more are reached in levels.
FAN = 512
#: Partitions of a stage at most; each has one group or more.
MOST_TASKS = 50_000
#: Rows and bytes of an Arrow batch handed to Python, at most; one row that is longer is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: batches of whole texts are kept small, for this session from now on, as plans are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def fresh(columns: list[str], wish: str) -> str:
    """A column name that clashes with none of `columns` (Spark compares without case)."""
    low = {c.lower() for c in columns}
    while wish.lower() in low:
        wish = "_" + wish
    return wish


def fanned(parts: int, most: int = FAN) -> tuple[int, int]:
    """Levels, and parts at each, so that all levels together give at least `parts`; none has many more than `most`."""
    levels = 1
    while most**levels < parts:
        levels += 1
    fan = max(1, round(parts ** (1 / levels)))
    return levels, fan if fan**levels >= parts else fan + 1
