"""Queries and criteria as plain data, before they become a plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

#: Each operator and its inverse (fixed values).
INVERSE = {
    "EQUAL": "NOT_EQUAL",
    "GREATER_THAN": "LESS_THAN_EQUAL",
    "LESS_THAN": "GREATER_THAN_EQUAL",
    "BETWEEN": "NOT_BETWEEN",
    "IN": "NOT_IN",
    "IS_NULL": "NOT_NULL",
    "STARTS_WITH": "NOT_STARTS_WITH",
    "CONTAINS": "NOT_CONTAINS",
    "CONTAINS_IGNORE_CASE": "NOT_CONTAINS_IGNORE_CASE",
    "LIKE": "NOT_LIKE",
    "MATCHES": "NOT_MATCHES",
}
INVERSE |= {v: k for k, v in INVERSE.items()}
OPERATORS = tuple(INVERSE)


class Criteria:
    """A condition; & and | combine, ~ negates."""

    def __and__(self, other: Criteria) -> Criteria:
        return joined("AND", self, other)

    def __or__(self, other: Criteria) -> Criteria:
        return joined("OR", self, other)

    def __invert__(self) -> Criteria:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Criteria):
    """path operator value; value may be a literal, a list, a pair (BETWEEN) or a Query of one column (IN, NOT_IN)."""

    path: str
    operator: str
    value: Any = None

    def __post_init__(self):
        if self.operator not in INVERSE:
            raise ValueError(f"unknown operator {self.operator}")


@dataclass(frozen=True)
class SqlLike(Criteria):
    """SQL's LIKE with wildcards, beside the operator of that name, which has none."""

    path: str
    pattern: str


@dataclass(frozen=True)
class Search(Criteria):
    """Full-text condition over the whole record, or over one attribute."""

    text: str
    minimum_score: float | None = None
    attribute: str | None = None


@dataclass(frozen=True)
class Compound(Criteria):
    operator: str
    parts: tuple[Criteria, ...]


@dataclass(frozen=True)
class Not(Criteria):
    part: Criteria


def joined(operator: str, a: Criteria, b: Criteria) -> Criteria:
    """a and b under one operator; a chain of one operator is kept flat, others nest to the left."""
    parts = a.parts if isinstance(a, Compound) and a.operator == operator else (a,)
    return Compound(operator, (*parts, b))


def negated(c: Criteria) -> Criteria:
    """The opposite: of a leaf, its inverse operator (which, over a to-many path, asks for another row, not for none)."""
    if isinstance(c, Not):
        return c.part
    if isinstance(c, Leaf):
        return Leaf(c.path, INVERSE[c.operator], c.value)
    return Not(c)


@dataclass(frozen=True)
class Order:
    expression: str
    ascending: bool = True


@dataclass(frozen=True)
class Query:
    entity: str
    selections: tuple[str, ...] = ()
    criteria: Criteria | None = None
    group_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    distinct: bool = False
    limit: int | None = None
    offset: int = 0
    partition: Any = None
    resolvers: tuple[str, ...] = ()
    updates: dict = field(default_factory=dict, hash=False)
    page_size: int | None = None
    next_page: str | None = None
    max_cardinality: int | None = None
    cached: bool = False

    def with_(self, **changes) -> Query:
        return replace(self, **changes)
