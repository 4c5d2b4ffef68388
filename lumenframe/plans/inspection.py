"""What a plan will do before it runs: pushed filters, columns read, exchanges, Python stages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanReport:
    pushed: tuple[str, ...]
    read_columns: tuple[str, ...]
    exchanges: int
    broadcasts: int
    python: int
    cartesian: int
    single_partition: int


def report(df: DataFrame) -> PlanReport:
    """Counts over the physical plan as text; adaptive execution may still change join strategies."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    pushed = [p for m in re.findall(r"PushedFilters: \[([^\]]*)\]", text) for p in m.split(", ") if p]
    read = [c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in m.split(",") if c]
    return PlanReport(
        tuple(pushed), tuple(read), len(re.findall(r"\bExchange\b", text)), len(re.findall(r"BroadcastExchange", text)),
        len(re.findall(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|FlatMapGroupsInArrow|PythonMapIn", text)),
        len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", text)), len(re.findall(r"Exchange SinglePartition", text)),
    )
