"""Consuming results: pages, streams, reductions, caching and cancelling."""

from __future__ import annotations

import base64
import itertools
import json
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heliograph.plans.ir import Order, Query
from heliograph.plans.planner import Planner


def token_of(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode()


def values_of(token: str) -> list:
    return json.loads(base64.urlsafe_b64decode(token))


def after(df: DataFrame, keys: list[tuple[str, bool]], values: list) -> DataFrame:
    """Rows after the given sort values; null is lowest, as in the order itself."""
    condition = F.lit(False)
    same = F.lit(True)
    for (name, up), value in zip(keys, values, strict=True):
        c, v = F.col(f"`{name}`"), F.lit(value).cast(df.schema[name].dataType)
        if value is None:
            beyond = c.isNotNull() if up else F.lit(False)
        else:
            beyond = F.coalesce(c > v, F.lit(False)) if up else (c.isNull() | F.coalesce(c < v, F.lit(False)))
        condition = condition | (same & beyond)
        same = same & c.eqNullSafe(v)
    return df.filter(condition)


def ordered(planner: Planner, query: Query) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """All rows of the query in the order of its pages, and that order: the query's, then the identifier.

    The query must select what it orders by. Rows up to its next_page are left out.
    """
    schema = planner.catalog.schema(query.entity)
    orders = query.order_by if any(o.expression == schema.identifier for o in query.order_by) else (*query.order_by, Order(schema.identifier))
    selections = query.selections or tuple(a.name for a in schema.attributes)
    wanted = tuple(dict.fromkeys([*selections, *[o.expression for o in orders]]))
    df = planner.plan(query.with_(selections=wanted, order_by=(), limit=None, offset=0))
    keys = [(o.expression, o.ascending) for o in orders]
    if query.next_page:
        df = after(df, keys, values_of(query.next_page))
    return df.orderBy(*[F.col(f"`{n}`").asc_nulls_first() if up else F.col(f"`{n}`").desc_nulls_last() for n, up in keys]), keys


def page(planner: Planner, query: Query) -> tuple[list[Row], str | None]:
    """One page and the token of the next one. A page starts after a key, so late pages cost no more than early ones."""
    rows, keys = ordered(planner, query)
    size = query.page_size or 100
    rows = rows.limit(size + 1).collect()
    token = token_of([rows[size - 1][n] for n, _ in keys]) if len(rows) > size else None
    return rows[:size], token


def pages(planner: Planner, query: Query, prefetch: bool = True) -> Iterator[list[Row]]:
    """All pages in order, cut from one sort of the rows; prefetch: the next one is worked out while the caller has the last.

    The driver holds a partition of the sorted rows at a time, two with prefetch.
    """
    rows = ordered(planner, query)[0].toLocalIterator(prefetchPartitions=prefetch)
    taken = lambda: list(itertools.islice(rows, query.page_size or 100))
    with ThreadPoolExecutor(1) as ahead:
        waiting = ahead.submit(taken)
        while found := waiting.result():
            if prefetch:
                waiting = ahead.submit(taken)
            yield found
            if not prefetch:
                waiting = ahead.submit(taken)


def for_each_page(planner: Planner, query: Query, action: Callable[[list[Row]], Any], workers: int = 4) -> int:
    """Call action with each page, several pages at a time, until one returns False; how many pages were begun."""
    begun, running = 0, deque()
    with ThreadPoolExecutor(workers) as pool:
        for rows in pages(planner, query):
            running.append(pool.submit(action, rows))
            begun += 1
            if len(running) >= workers and running.popleft().result() is False:
                break
            if any(r.done() and r.result() is False for r in running):
                break
        for r in running:
            r.result()
    return begun


def for_each(df: DataFrame, action: Callable[[Row], Any]) -> int:
    """Call action with each row on the driver until it returns False; how many rows it saw."""
    seen = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        seen += 1
        if action(row) is False:
            break
    return seen


def for_each_map(df: DataFrame, action: Callable[[dict], Any]) -> int:
    return for_each(df, lambda row: action(row.asDict(recursive=True)))


def for_each_parallel(df: DataFrame, action: Callable[[Row], Any]) -> None:
    """Call action with each row on the executors, partitions side by side."""

    def part(rows):
        for row in rows:
            action(row)

    df.foreachPartition(part)


def processed(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's function over batches of the results as pandas frames, on the executors."""
    return df.mapInPandas(function, schema)


def reduction(df: DataFrame, field: str) -> Row:
    """(max, min, sum, n) of a column over all results, in one pass."""
    c = F.col(f"`{field}`")
    return df.agg(F.max(c).alias("max"), F.min(c).alias("min"), F.sum(c).alias("sum"), F.count(c).alias("n")).first()


class ResultCache:
    """Persisted results by query, the least recently used dropped first; a write to an entity drops its results."""

    def __init__(self, planner: Planner, size: int = 100):
        self.planner, self.size = planner, size
        self._kept: OrderedDict[str, tuple[str, DataFrame]] = OrderedDict()

    def get(self, query: Query) -> DataFrame:
        key = repr(query)
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key][1]
        df = self.planner.plan(query).persist()
        self._kept[key] = (query.entity, df)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)[1][1].unpersist()
        return df

    def written(self, entity: str) -> None:
        for key in [k for k, (e, _) in self._kept.items() if e == entity or entity in k]:
            self._kept.pop(key)[1].unpersist()


def cancellable(spark: SparkSession, group: str, action: Callable[[], Any]) -> Any:
    """Run an action under a name by which cancel() stops its jobs."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)
