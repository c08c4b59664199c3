"""The fluent query builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from heliograph.plans.ir import Criteria, Leaf, Order, Query, Search, SqlLike, joined
from heliograph.plans.planner import Planner


class Path:
    """A path in a condition: col("child.name").eq("x")."""

    def __init__(self, path: str):
        self.path = path

    def is_null(self) -> Leaf:
        return Leaf(self.path, "IS_NULL")

    def not_null(self) -> Leaf:
        return Leaf(self.path, "NOT_NULL")

    def between(self, low: Any, high: Any) -> Leaf:
        return Leaf(self.path, "BETWEEN", (low, high))

    def not_between(self, low: Any, high: Any) -> Leaf:
        return Leaf(self.path, "NOT_BETWEEN", (low, high))

    def is_in(self, values: Any) -> Leaf:
        return Leaf(self.path, "IN", values.query if isinstance(values, Builder) else values)

    def not_in(self, values: Any) -> Leaf:
        return Leaf(self.path, "NOT_IN", values.query if isinstance(values, Builder) else values)

    def sql_like(self, pattern: str) -> SqlLike:
        return SqlLike(self.path, pattern)


def _binary(operator: str) -> Callable[[Path, Any], Leaf]:
    return lambda self, value: Leaf(self.path, operator, value)


for _method, _operator in {
    "eq": "EQUAL", "neq": "NOT_EQUAL", "gt": "GREATER_THAN", "gte": "GREATER_THAN_EQUAL", "lt": "LESS_THAN", "lte": "LESS_THAN_EQUAL", "starts_with": "STARTS_WITH", "not_starts_with": "NOT_STARTS_WITH",
    "contains": "CONTAINS", "not_contains": "NOT_CONTAINS", "contains_ignore_case": "CONTAINS_IGNORE_CASE", "not_contains_ignore_case": "NOT_CONTAINS_IGNORE_CASE", "like": "LIKE", "not_like": "NOT_LIKE", "matches": "MATCHES", "not_matches": "NOT_MATCHES",
}.items():
    setattr(Path, _method, _binary(_operator))


def col(path: str) -> Path:
    return Path(path)


def search(text: str, minimum_score: float | None = None, attribute: str | None = None) -> Search:
    return Search(text, minimum_score, attribute)


def asc(expression: str) -> Order:
    return Order(expression)


def desc(expression: str) -> Order:
    return Order(expression, False)


def _call(function: str) -> Callable[..., str]:
    return lambda attribute, *arguments: f"{function}({', '.join([attribute, *map(str, arguments)])})"


avg, sum_, std, variance, median, count_, min_, max_, percentile = map(_call, ("avg", "sum", "std", "variance", "median", "count", "min", "max", "percentile"))
upper, lower, substring = map(_call, ("upper", "lower", "substring"))


def replace(attribute: str, pattern: str, replacement: str) -> str:
    return f"replace({attribute}, '{pattern}', '{replacement}')"


def format_(attribute: str, pattern: str) -> str:
    return f"format({attribute}, '{pattern}')"


class Builder:
    """Each call gives a new builder; df() is the lazy result, on which any DataFrame operation can go on."""

    def __init__(self, planner: Planner, query: Query):
        self.planner, self.query = planner, query

    def _with(self, **changes) -> Builder:
        return Builder(self.planner, self.query.with_(**changes))

    def select(self, *selections: str) -> Builder:
        return self._with(selections=selections)

    def where(self, criteria: Criteria) -> Builder:
        return self.and_(criteria)

    def and_(self, criteria: Criteria) -> Builder:
        return self._with(criteria=joined("AND", self.query.criteria, criteria) if self.query.criteria else criteria)

    def or_(self, criteria: Criteria) -> Builder:
        """The condition so far, or this one: no operator binds tighter than another."""
        return self._with(criteria=joined("OR", self.query.criteria, criteria) if self.query.criteria else criteria)

    def search(self, text: str, minimum_score: float | None = None) -> Builder:
        return self.and_(Search(text, minimum_score))

    def group_by(self, *expressions: str) -> Builder:
        return self._with(group_by=expressions)

    def order_by(self, *orders: str | Order) -> Builder:
        return self._with(order_by=tuple(o if isinstance(o, Order) else Order(o) for o in orders))

    def distinct(self) -> Builder:
        return self._with(distinct=True)

    def limit(self, n: int) -> Builder:
        return self._with(limit=n)

    def offset(self, n: int) -> Builder:
        return self._with(offset=n)

    def in_partition(self, value: Any) -> Builder:
        return self._with(partition=value)

    def resolve(self, *relationships: str) -> Builder:
        return self._with(resolvers=relationships)

    def max_cardinality(self, n: int) -> Builder:
        return self._with(max_cardinality=n)

    def cache(self) -> Builder:
        return self._with(cached=True)

    def set(self, **values) -> Builder:
        return self._with(updates=values)

    # ---- results -----------------------------------------------------------------------------------------

    def df(self) -> DataFrame:
        """The result; of a cached query, the one that is kept until a write to its tables."""
        if self.query.cached and self.planner.results is not None:
            return self.planner.results.get(self.query)
        return self.planner.plan(self.query)

    def list(self) -> list[Row]:
        return self.df().collect()

    def first(self) -> Row:
        row = self.first_or_none()
        if row is None:
            raise LookupError("the query has no result")
        return row

    def first_or_none(self) -> Row | None:
        return self.limit(1).df().first()

    one = first_or_none

    def count(self) -> int:
        return self.planner.counted(self.query)

    def values(self, field: str) -> DataFrame:
        """The values of one result column, without nulls."""
        out = self.df()
        return out.select(f"`{field}`").filter(out[f"`{field}`"].isNotNull())

    def rows(self) -> Iterator[Row]:
        """Rows one by one; at most two partitions are held."""
        return self.df().toLocalIterator(prefetchPartitions=True)


class Database:
    """Entry point: from_("orders").where(col("o_totalprice").gt(1000)).df()."""

    #: What the guard against too many rows is set to where one is wanted.
    MAX_CARDINALITY = 1_000_000

    def __init__(self, catalog, strict: bool = False, max_cardinality: int | None = None):
        from heliograph.results import ResultCache

        self.catalog, self.planner = catalog, Planner(catalog, strict, max_cardinality)
        self.planner.results = ResultCache(self.planner)

    def from_(self, entity: str) -> Builder:
        return Builder(self.planner, Query(entity))

    def select(self, *selections: str):
        return _Selected(self, selections)

    def payload(self, data: dict, table: str | None = None) -> Builder:
        """A builder from a JSON payload."""
        from heliograph.plans.parse import query_of

        return Builder(self.planner, query_of(data, table))

    def find(self, entity: str, identifier: Any, partition: Any = None) -> Row | None:
        key = self.catalog.schema(entity).identifier
        return self.from_(entity).where(col(key).eq(identifier))._with(partition=partition).first_or_none()

    def exists(self, entity: str, identifier: Any, partition: Any = None) -> bool:
        return self.find(entity, identifier, partition) is not None

    def map_of(self, entity: str, identifier: Any) -> dict | None:
        row = self.find(entity, identifier)
        return row.asDict(recursive=True) if row else None


    def related(self, entity: str, identifier: Any, relationship: str) -> DataFrame:
        """The rows that one row is related to, looked up now: hydration of a relationship that a query left out."""
        schema = self.catalog.schema(entity)
        r = schema.relationship(relationship)
        if r is None:
            raise KeyError(f"{entity} has no {relationship}")
        own = self.catalog.table(entity)
        target = self.catalog.table(r.target)
        keys = own.filter(own[schema.identifier] == identifier).select(own[r.local].alias("_key"))
        if r.link:
            table, mine, other = r.link
            links = self.catalog.table(table)
            keys = links.join(keys, links[mine] == keys["_key"], "left_semi").select(links[other].alias("_key"))
        return target.join(keys, target[r.remote] == keys["_key"], "left_semi")

    def hydrated(self, entity: str, identifier: Any, *relationships: str) -> dict | None:
        """A row as a map, with the given relationships (all of them if none is given): one map or none of a to-one relationship, a list of a to-many one."""
        out = self.map_of(entity, identifier)
        if out is None:
            return None
        schema = self.catalog.schema(entity)
        for key in relationships or [r.name for r in schema.relationships]:
            rows = [row.asDict(recursive=True) for row in self.related(entity, identifier, key).toLocalIterator()]
            out[key] = rows if schema.relationship(key).many else rows[0] if rows else None
        return out


class _Selected:
    def __init__(self, database: Database, selections: tuple[str, ...]):
        self.database, self.selections = database, selections

    def from_(self, entity: str) -> Builder:
        return self.database.from_(entity).select(*self.selections)
