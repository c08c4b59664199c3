"""Aggregates. Means and spreads count a null as 0, results return to the attribute's type where noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def back(value: Column, kind: T.DataType) -> Column:
    """The value in the attribute's type; whole-number types truncate."""
    return value.try_cast(kind) if isinstance(kind, T.NumericType) else value


def aggregate(name: str, x: Column, kind: T.DataType, arguments: tuple[str, ...] = (), distinct: bool = False) -> Column:
    """One aggregate over column x of the given type.

    sum: null if all are null; whole numbers sum as bigint. avg, std, variance: nulls count as 0, all null
    gives null; population formulas. count: all rows, or with distinct the different values, null being one.
    min: null if any is null, as null is lowest. max: ignores nulls. median, percentile (0 to 100, linear
    interpolation): ignore nulls.
    """
    number = x if isinstance(kind, T.NumericType) else x.try_cast("double")
    zeroed = F.coalesce(number, F.lit(0))
    some = F.count(number) > 0
    if name == "sum":
        return F.sum(number)
    if name == "avg":
        return F.when(some, back(F.avg(zeroed), kind))
    if name == "std":
        return F.when(some, F.stddev_pop(zeroed.cast("double")))
    if name == "variance":
        return F.when(some, F.var_pop(zeroed.cast("double")))
    if name == "count":
        return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0)) if distinct else F.count(F.lit(1))
    if name == "min":
        return F.when(~F.bool_or(x.isNull()), F.min(x))
    if name == "max":
        return F.max(x)
    if name == "median":
        return back(F.median(number), kind)
    if name == "percentile":
        return back(F.percentile(number, float(arguments[0]) / 100), kind)
    raise ValueError(f"unknown aggregate {name}")
