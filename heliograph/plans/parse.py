"""Strings and JSON payloads to query data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote_plus

from heliograph.plans.ir import Compound, Criteria, Leaf, Not, Order, Query, Search

AGGREGATES = ("avg", "sum", "std", "variance", "median", "count", "min", "max", "percentile")
SCALARS = ("upper", "lower", "replace", "substring", "format")
CALL = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$", re.DOTALL)


@dataclass(frozen=True)
class Call:
    """function(attribute, arguments...)"""

    function: str
    attribute: str
    arguments: tuple[str, ...] = ()

    @property
    def aggregate(self) -> bool:
        return self.function in AGGREGATES


def call(text: str) -> Call | None:
    """A selection like sum(price) or replace(name, '[0-9]', '#'); None for a plain path.

    Three comma-separated parts at most, quotes around a part are dropped; calls don't nest.
    """
    m = CALL.match(text)
    if not m or m[1].lower() not in AGGREGATES + SCALARS:
        return None
    parts = [p.strip() for p in m[2].split(",", 2)]
    parts = [p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in "'\"" else p for p in parts]
    return Call(m[1].lower(), parts[0], tuple(parts[1:]))


def criteria_of(data: dict | None) -> Criteria | None:
    """Condition tree of a payload: SingleCondition {criteria: {field, operator, value}}, CompoundCondition {operator, conditions}."""
    if not data:
        return None
    if data.get("conditionType") == "CompoundCondition" or "conditions" in data:
        parts = tuple(p for p in (criteria_of(c) for c in data["conditions"]) if p)
        return parts[0] if len(parts) == 1 else Compound(data.get("operator", "AND").upper(), parts) if parts else None
    c = data["criteria"]
    value: Any = c.get("value")
    if isinstance(value, dict) and value.get("type") == "SelectQuery":
        value = query_of(value)
    operator = c["operator"].upper()
    if c["field"] == "__full_text__":
        text, score = (value.get("queryText"), value.get("minScore")) if isinstance(value, dict) else (value, None)
        found = Search(text, score)
        return Not(found) if operator.startswith("NOT_") else found
    if operator in ("BETWEEN", "NOT_BETWEEN") and isinstance(value, dict):
        value = (value.get("first"), value.get("second"))
    return Leaf(c["field"], operator, value)


def query_of(data: dict, table: str | None = None) -> Query:
    """Query of a SelectQuery or UpdateQuery payload."""
    order = tuple(Order(s["field"], s.get("order", "ASC").upper() != "DESC") for s in data.get("sort") or ())
    return Query(
        entity=table or data["table"],
        selections=tuple(data.get("fields") or ()),
        criteria=criteria_of(data.get("conditions")),
        group_by=tuple(data.get("groupBy") or ()),
        order_by=order,
        distinct=bool(data.get("distinct")),
        limit=data.get("limit"),
        partition=data.get("partition"),
        resolvers=tuple(data.get("resolvers") or ()),
        updates=dict(data.get("updates") or {}),
        page_size=data.get("pageSize"),
        next_page=data.get("nextPage"),
    )


@dataclass(frozen=True)
class Cascade:
    """attribute:Type(target, source): rows under `attribute` are rows of Type whose `target` is the parent's `source`."""

    attribute: str
    type: str
    target: str
    source: str


CASCADE = re.compile(r"\s*(?P<attribute>[^:,()\s][^:,()]*?)\s*:\s*(?P<type>[A-Za-z_]\w*)\s*\(\s*(?P<target>[A-Za-z_]\w*)\s*,\s*(?P<source>[A-Za-z_]\w*)\s*\)\s*(?:,|$)", re.ASCII)


def cascades(text: str) -> list[Cascade]:
    """Instructions of a comma-separated, URI-encoded cascade string; a blank one has none, a malformed one is an error."""
    text, at, out = unquote_plus(text).strip().rstrip(","), 0, []
    while at < len(text):
        m = CASCADE.match(text, at)
        if not m:
            raise ValueError(f"not a cascade instruction: {text[at:]}")
        out.append(Cascade(**m.groupdict()))
        at = m.end()
    return out
