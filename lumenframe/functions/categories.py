"""Categorical columns: a text column and the tuple of its categories; a code is a place in the tuple, -1 for missing."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Categorical:
    """Values outside the categories are missing. Ordered ones compare by their codes."""

    column: Column
    categories: tuple
    ordered: bool = False

    @staticmethod
    def of(df: DataFrame, name: str, ordered: bool = False) -> Categorical:
        """With the distinct values, sorted, as categories; their number must be small, as they come to the driver."""
        return Categorical(F.col(name), tuple(sorted(r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().collect())), ordered)

    def values(self) -> Column:
        return F.when(self.column.isin(list(self.categories)), self.column)

    def codes(self) -> Column:
        if not self.categories:
            return F.lit(-1)
        at = F.array_position(F.array(*map(F.lit, self.categories)), self.column)
        return F.coalesce(at - 1, F.lit(-1)).cast("int")

    def rename_categories(self, names: dict | list) -> Categorical:
        to = names if isinstance(names, dict) else dict(zip(self.categories, names, strict=True))
        column = reduce(lambda c, kv: c.when(self.column == kv[0], F.lit(kv[1])), to.items(), F.when(F.lit(False), self.column)).otherwise(self.column)
        return replace(self, column=column, categories=tuple(to.get(c, c) for c in self.categories))

    def reorder_categories(self, names: list, ordered: bool | None = None) -> Categorical:
        if set(names) != set(self.categories):
            raise ValueError("the new order must hold the same categories")
        return replace(self, categories=tuple(names), ordered=self.ordered if ordered is None else ordered)

    def add_categories(self, names: list) -> Categorical:
        return replace(self, categories=(*self.categories, *(n for n in names if n not in self.categories)))

    def remove_categories(self, names: list) -> Categorical:
        return self.set_categories([c for c in self.categories if c not in names])

    def remove_unused_categories(self, df: DataFrame) -> Categorical:
        used = {r[0] for r in df.select(self.values().alias("v")).distinct().collect()}
        return self.set_categories([c for c in self.categories if c in used])

    def set_categories(self, names: list) -> Categorical:
        kept = replace(self, categories=tuple(names))
        return replace(kept, column=kept.values())

    def as_ordered(self) -> Categorical:
        return replace(self, ordered=True)

    def as_unordered(self) -> Categorical:
        return replace(self, ordered=False)

    def less(self, value: object) -> Column:
        """Whether each value comes before `value` in the order of the categories."""
        if not self.ordered:
            raise TypeError("categories without order do not compare")
        return F.when(self.codes() >= 0, self.codes() < self.categories.index(value))
