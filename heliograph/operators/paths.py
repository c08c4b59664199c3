"""Dotted paths inside a row: structs, maps, arrays (index, `any`, or all elements) and JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def step(x: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType]:
    """One path segment down from x."""
    if isinstance(kind, T.StructType):
        if name not in kind.names:
            raise KeyError(f"no field {name}")
        return x[name], kind[name].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(x, F.lit(name).cast(kind.keyType)), kind.valueType
    if isinstance(kind, T.ArrayType):
        if name.isdigit():
            return F.get(x, F.lit(int(name))), kind.elementType
        inner = step(F.lit(None).cast(kind.elementType), kind.elementType, name)[1]
        return F.transform(x, lambda e: step(e, kind.elementType, name)[0]), T.ArrayType(inner)
    if isinstance(kind, T.StringType):
        place = f"[{name}]" if name.isdigit() else f".{name}"
        return F.get_json_object(x, f"${place}"), T.StringType()
    raise KeyError(f"{kind.simpleString()} has no part {name}")


def value(x: Column, kind: T.DataType, path: list[str]) -> tuple[Column, T.DataType]:
    """The value at the path below x; `any` stands for all elements, as does a name after an array."""
    if not path:
        return x, kind
    if isinstance(kind, T.StringType) and all(p != "any" for p in path):  # one walk through the JSON text
        place = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path)
        return F.get_json_object(x, f"${place}"), T.StringType()
    head, *rest = path
    if isinstance(kind, T.ArrayType) and not head.isdigit():
        rest = rest if head == "any" else path
        if not rest:
            return x, kind
        inner = value(F.lit(None).cast(kind.elementType), kind.elementType, rest)[1]
        return F.transform(x, lambda e: value(e, kind.elementType, rest)[0]), T.ArrayType(inner)
    return value(*step(x, kind, head), rest)


def holds(x: Column, kind: T.DataType, path: list[str], test: Callable[[Column, T.DataType], Column]) -> Column:
    """Whether test holds at the path; over an array, for any element."""
    if path and isinstance(kind, T.ArrayType) and not path[0].isdigit():
        rest = path[1:] if path[0] == "any" else path
        return x.isNotNull() & F.coalesce(F.exists(x, lambda e: holds(e, kind.elementType, rest, test)), F.lit(False))
    if not path:
        return test(x, kind)
    if isinstance(kind, T.StringType):
        return test(*value(x, kind, path))
    return holds(*step(x, kind, path[0]), path[1:], test)
