"""Merge-on-read: versions of a row become one row, column by column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.errors import EngineError


class MergeOperator:
    """How the versions of one column become its value.

    ``combine`` gets the array of values, oldest first, nulls included, of the files that have the column.
    """

    def combine(self, values: Column) -> Column:
        raise NotImplementedError

    def aggregate(self, value: Column, present: Column, order: Column) -> Column:
        versions = F.collect_list(F.when(present, F.struct(order.alias("o"), F.struct(value.alias("v")).alias("s"))))
        return self.combine(F.transform(F.array_sort(versions, _by_order), lambda x: x["s"]["v"]))


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


class LastValue(MergeOperator):
    """The newest value; an explicit null counts."""

    def aggregate(self, value: Column, present: Column, order: Column) -> Column:
        return F.max_by(value, F.when(present, order))


class SumValues(MergeOperator):
    """The sum; nulls count as 0."""

    def aggregate(self, value: Column, present: Column, order: Column) -> Column:
        return F.sum(F.when(present, F.coalesce(value, F.lit(0))))


@dataclass(frozen=True)
class JoinStrings(MergeOperator):
    """The texts, oldest first; a null is written ``null``."""

    separator: str = ","

    def combine(self, values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("null"))), self.separator)


@dataclass(frozen=True)
class ColumnOperator(MergeOperator):
    """A function from the array column of versions to a column."""

    function: Callable[[Column], Column]

    def combine(self, values: Column) -> Column:
        return self.function(values)


@dataclass(frozen=True)
class PythonOperator(MergeOperator):
    """A Python function from the list of versions to a value, run in Arrow batches."""

    function: Callable[[list], object]
    returns: str

    def combine(self, values: Column) -> Column:
        function = self.function

        def run(lists: pd.Series) -> pd.Series:
            return lists.map(lambda v: function(list(v)), na_action="ignore")

        return F.pandas_udf(run, self.returns)(values)


#: Operators that are known by name; ``register`` adds to them.
OPERATORS: dict[str, MergeOperator] = {
    "last": LastValue(),
    "sum": SumValues(),
    "join": JoinStrings(),
}


def register(name: str, operator: MergeOperator | Callable) -> None:
    OPERATORS[name] = operator if isinstance(operator, MergeOperator) else ColumnOperator(operator)


def resolve(operator: str | MergeOperator | Callable) -> MergeOperator:
    if isinstance(operator, MergeOperator):
        return operator
    if callable(operator):
        return ColumnOperator(operator)
    if operator not in OPERATORS:
        raise EngineError(f"no merge operator {operator!r} is registered")
    return OPERATORS[operator]


@dataclass(frozen=True)
class Layer:
    """Rows of some files that share a set of columns; ``_order`` is the version of a row, missing columns are null."""

    rows: DataFrame
    columns: frozenset


def newest_rows(base: DataFrame, deltas: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Default merge of layers that have every column: untouched base rows and the newest delta row of each key.

    The base is not shuffled when the deltas are small enough for Spark to broadcast their keys, and never aggregated.
    ``_order`` marks the version in ``deltas``; keys are never null in keyed tables.
    """
    rest = [c for c in columns if c not in keys]
    whole = F.struct(*rest) if rest else F.lit(True)
    newest = deltas.groupBy(*keys).agg(F.max_by(whole, "_order").alias("_w"))
    newest = newest.select(*[F.col(c) if c in keys else F.col("_w").getField(c).alias(c) for c in columns])
    return base.select(*columns).join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def merge_layers(
    layers: Sequence[Layer], keys: Sequence[str], columns: Sequence[str], operators: dict[str, MergeOperator]
) -> DataFrame:
    """One row per key: each column by its operator over the versions that have it.

    Columns of every layer with the default operator are carried as one struct; a column that some layers lack is
    looked up among the layers that have it, so a partial update leaves the others as they were and an explicit null
    overwrites.  Columns that no layer has come out as null.
    """
    everywhere = frozenset.intersection(*[x.columns for x in layers])
    partial = [c for c in columns if c not in everywhere]
    marks = {c: f"_has_{i}" for i, c in enumerate(partial)}
    rows = None
    for layer in layers:
        own = layer.rows.select(
            *columns, "_order", *[F.lit(c in layer.columns).alias(m) for c, m in marks.items()]
        )
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select("*", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    plain = [c for c in columns if c in everywhere and c not in operators and c not in keys]
    order = F.col("_order")
    aggregates = [F.max_by(F.struct(*plain), order).alias("_plain")] if plain else []
    made = [c for c in columns if c in operators or (c in partial and c not in keys)]
    for i, c in enumerate(made):
        present = F.col(marks[c]) if c in marks else F.lit(True)
        aggregates.append(operators.get(c, LastValue()).aggregate(F.col(c), present, order).alias(f"_made_{i}"))
    groups = [f"_key_{i}" for i in range(len(keys))]
    merged = rows.groupBy(*groups).agg(*aggregates) if aggregates else rows.select(*groups).distinct()
    output = []
    for c in columns:
        if c in made:
            output.append(F.col(f"_made_{made.index(c)}").alias(c))
        elif c in keys:
            output.append(F.col(f"_key_{list(keys).index(c)}").alias(c))
        else:
            output.append(F.col("_plain").getField(c).alias(c))
    return merged.select(*output)
