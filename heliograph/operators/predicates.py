"""Leaf conditions as two-valued columns: never null, so that they can be negated and combined freely.

A null is lower than any value: it is less than everything, greater than nothing, and equal to null alone.
Negative operators hold for null. Text operators with a null text: positive ones fail, negative ones hold.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.plans.ir import INVERSE


def sure(x: Column, c: Column) -> Column:
    """c where x has a value, else false; written so that it still reaches the scan as a pushed filter."""
    return x.isNotNull() & c


def as_literal(x: Column, kind: T.DataType, value: Any, strict: bool) -> tuple[Column, Any]:
    """Both sides in one type. strict: the column is cast to the literal's type, as 3.7 to 3 for a whole-number literal."""
    if value is None or isinstance(value, Column):
        return x, value
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and not strict:
            return x, F.lit(value).cast(kind)
        if isinstance(kind, T.NumericType) and not strict:
            return x.cast("double"), F.lit(value).try_cast("double")
        return x.cast("string"), value
    if strict:
        to = {bool: "boolean", int: "bigint", float: "double"}.get(type(value))
        return (x.try_cast(to) if to else x), value
    if isinstance(kind, T.StringType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return x.try_cast("double"), float(value)
    return x, value


def predicate(x: Column, kind: T.DataType, operator: str, value: Any = None, strict: bool = False) -> Column:
    """x operator value."""
    if operator in ("NOT_EQUAL", "NOT_BETWEEN", "NOT_IN", "NOT_NULL", "NOT_STARTS_WITH", "NOT_CONTAINS", "NOT_CONTAINS_IGNORE_CASE", "NOT_LIKE", "NOT_MATCHES"):
        if operator == "NOT_NULL":
            return x.isNotNull()
        if operator == "NOT_EQUAL" and value is None:
            return x.isNotNull()
        return x.isNull() | ~predicate(x, kind, INVERSE[operator], value, strict)
    if operator == "IS_NULL":
        return x.isNull()
    if operator == "BETWEEN":
        (a, low), (_, high) = as_literal(x, kind, value[0], strict), as_literal(x, kind, value[1], strict)
        return sure(a, (a >= low) & (a <= high))
    if operator == "IN":
        values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
        pairs = [as_literal(x, kind, v, strict) for v in values]
        return sure(pairs[0][0], pairs[0][0].isin(*[v for _, v in pairs])) if pairs else F.lit(False)
    if operator in ("STARTS_WITH", "CONTAINS", "CONTAINS_IGNORE_CASE", "LIKE", "MATCHES"):
        if value is None:
            return F.lit(False)
        if operator == "CONTAINS" and isinstance(kind, T.ArrayType):
            return sure(x, F.array_contains(x, value))
        text, value = x.cast("string"), str(value)
        if operator == "STARTS_WITH":
            return sure(text, text.startswith(value))
        if operator == "CONTAINS":
            return sure(text, text.contains(value))
        if operator == "CONTAINS_IGNORE_CASE":
            return sure(text, F.lower(text).contains(F.lower(F.lit(value))))
        if operator == "LIKE":
            return sure(text, F.lower(text) == F.lower(F.lit(value)))
        return sure(text, text.rlike(rf"\A(?:{value})\z"))
    x, value = as_literal(x, kind, value, strict)
    if operator == "EQUAL":
        return x.isNull() if value is None else x.eqNullSafe(value)
    if operator == "GREATER_THAN":
        return x.isNotNull() if value is None else sure(x, x > value)
    if operator == "GREATER_THAN_EQUAL":
        return F.lit(True) if value is None else sure(x, x >= value)
    if operator == "LESS_THAN":
        return F.lit(False) if value is None else x.isNull() | sure(x, x < value)
    if operator == "LESS_THAN_EQUAL":
        return x.isNull() if value is None else x.isNull() | sure(x, x <= value)
    raise ValueError(f"unknown operator {operator}")
