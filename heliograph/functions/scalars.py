"""Scalar functions of selections, groupings and orderings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of date patterns and of number patterns (fixed values).
DATE_PATTERN = re.compile(r"^(?:[yMdHhmsSaEDkKzZX]|'[^']*'|[^A-Za-z])+$")
NUMBER_PATTERN = re.compile(r"^[#0,]*(?:\.[#0]*)?$")
DATE_DEFAULT, NUMBER_DEFAULT = "yyyy-MM-dd", "#.##"


def number_format(x: Column, pattern: str | None) -> Column:
    """Decimal pattern; with decimals, every # counts as 0. An invalid pattern gives the plain text."""
    pattern = pattern or NUMBER_DEFAULT
    if not NUMBER_PATTERN.match(pattern):
        return x.cast("string")
    if "." in pattern:
        pattern = pattern.replace("#", "0")
    return F.call_function("format_number", x, F.lit(pattern))


def formatted(x: Column, kind: T.DataType, pattern: str | None = None) -> Column:
    """Dates by a date pattern, numbers by a decimal pattern, others as text; null: an empty text."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.date_format(x, pattern if pattern and DATE_PATTERN.match(pattern) else DATE_DEFAULT)
    elif isinstance(kind, T.NumericType):
        out = number_format(x, pattern)
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))


def scalar(name: str, x: Column, kind: T.DataType, arguments: tuple[str, ...]) -> Column:
    """upper, lower, replace (all matches of a regular expression), substring (start, end; from 0, end exclusive), format."""
    if name == "upper":
        return F.upper(x.cast("string"))
    if name == "lower":
        return F.lower(x.cast("string"))
    if name == "replace":
        return F.regexp_replace(x.cast("string"), arguments[0], arguments[1] if len(arguments) > 1 else "")
    if name == "substring":
        start, end = max(0, int(arguments[0])), int(arguments[1])
        return F.substring(x.cast("string"), start + 1, max(0, end - start))
    if name == "format":
        return formatted(x, kind, ",".join(arguments) or None)
    raise ValueError(f"unknown function {name}")


#: Text forms of dates that inputs may have, tried in order (fixed values).
DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yyyy hh:mm:ss a z", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm", "dd MMM yyyy HH:mm", "dd MMM yyyy")


def parsed_date(text: Column, forms: tuple[str, ...] = DATE_FORMS) -> Column:
    """Timestamp of a text in the first form that fits; none: null. Times without a zone are the session's."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def cast_or_zero(x: Column, kind: T.DataType, nullable: bool = True) -> Column:
    """x as the type; what can't be cast is the type's zero, and so is null where null is not allowed."""
    done = x.try_cast(kind)
    zero = {T.BooleanType: False, T.StringType: ""}.get(type(kind), 0 if isinstance(kind, T.NumericType) else None)
    if zero is None:
        return done
    zero = F.lit(zero).cast(kind)
    return F.when(x.isNull(), F.lit(None) if nullable else zero).otherwise(F.coalesce(done, zero))
