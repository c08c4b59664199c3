"""Changes as rewrites: each function gives the table's new content, and never touches the old one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.plans.ir import Query
from heliograph.plans.planner import Planner
from heliograph.schema import EntitySchema


def upsert(table: DataFrame, rows: DataFrame, schema: EntitySchema) -> DataFrame:
    """table with rows inserted, or put in the place of those with the same identifier; of rows that repeat one, the last one stays."""
    return replaced(table, last_of(rows.withColumn("_order", F.monotonically_increasing_id()), schema.identifier, "_order"), schema)


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that repeat a key the last by order, as an aggregate; the order itself is left out."""
    rest = [c for c in rows.columns if c not in (key, order)]
    whole = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in rest])
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def replaced(table: DataFrame, rows: DataFrame, schema: EntitySchema) -> DataFrame:
    """table with rows, each of an identifier of its own, put in or in the place of those with theirs."""
    return table.join(rows.select(schema.identifier), schema.identifier, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows whose identifier is among the keys."""
    return table.join(keys.select(key), key, "left_anti").select(table.columns)


def targets(planner: Planner, query: Query) -> tuple[DataFrame, Column]:
    """The whole table with a column that marks what the query would change.

    A limit marks the first rows in the query's order; ties go by identifier.
    """
    schema = planner.catalog.schema(query.entity)
    table = planner.catalog.table(query.entity)
    if query.limit is None and query.criteria is None and query.partition is None:
        return table, F.lit(True)
    if query.limit is not None or query.order_by:
        chosen, _ = planner.matching(query)
        orders = []
        for o in query.order_by:
            chosen, x, _, _ = planner.expression(chosen, schema, o.expression)
            orders.append(x.asc() if o.ascending else x.desc())
        chosen = chosen.orderBy(*orders, F.col(schema.identifier))
        chosen = chosen.limit(query.limit) if query.limit is not None else chosen
        return planner.flag(table, chosen.select(F.col(schema.identifier).alias("key")), schema.identifier)
    df, hit = planner.condition(table, schema, query.criteria) if query.criteria else (table, F.lit(True))
    if query.partition is not None:
        hit = hit & F.coalesce(F.col(schema.partition) == F.lit(query.partition), F.lit(False))
    return df, hit


def updated(planner: Planner, query: Query) -> tuple[DataFrame, DataFrame]:
    """The table after the query's updates, and (n) the number of rows that they change."""
    schema = planner.catalog.schema(query.entity)
    table = planner.catalog.table(query.entity)
    for name, value in query.updates.items():
        check(schema, name, value)
    df, hit = targets(planner, query)
    changed = [F.when(hit, F.lit(query.updates[c]).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in query.updates else F.col(c) for c in table.columns]
    return df.select(*changed), df.agg(F.count(F.when(hit, 1)).alias("n"))


def deleted(planner: Planner, query: Query) -> tuple[DataFrame, DataFrame]:
    """The table after the query's rows are gone, and (n) their number."""
    table = planner.catalog.table(query.entity)
    df, hit = targets(planner, query)
    return df.filter(~hit).select(table.columns), df.agg(F.count(F.when(hit, 1)).alias("n"))


def check(schema: EntitySchema, name: str, value: Any) -> None:
    """Whether a literal may be stored in the attribute."""
    attribute = schema.attribute(name)
    if attribute is None:
        raise KeyError(f"{schema.name} has no {name}")
    if name == schema.identifier:
        raise ValueError(f"{schema.name}.{name}: an identifier can't be updated")
    if value is None and not attribute.nullable:
        raise ValueError(f"{schema.name}.{name} can't be null")
    if attribute.size is not None and isinstance(value, str) and len(value) > attribute.size:
        raise ValueError(f"{schema.name}.{name} is longer than {attribute.size}")


def with_identifiers(table: DataFrame, rows: DataFrame, schema: EntitySchema) -> DataFrame:
    """rows with identifiers where they lack one.

    SEQUENCE: numbers after the largest in use, in the table or given among the rows, without gaps in the
    rows' order; counts for each partition give the places, so the rows are not brought into one task. UUID:
    random texts. NONE: as they are.
    """
    key = schema.identifier
    if schema.generator == "UUID":
        return rows.withColumn(key, F.coalesce(F.col(key), F.uuid()))
    if schema.generator == "NONE":
        return rows
    most = table.agg(F.max(key).alias("m")).unionByName(rows.agg(F.max(key).alias("m"))).agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    marked = rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    missing = marked.filter(F.col(key).isNull())
    counts = missing.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
    kind = table.schema[key].dataType
    numbered = missing.join(before, "_p").withColumn(key, (F.lit(most) + F.col("_before") + place).cast(kind))
    return marked.filter(F.col(key).isNotNull()).select(rows.columns).unionByName(numbered.select(rows.columns))


def linked(links: DataFrame, parent: str, child: str, parent_id: Any, ids: list) -> DataFrame:
    """A link table with the parent's rows replaced by ones to the ids."""
    kept = links.filter(~F.col(parent).eqNullSafe(F.lit(parent_id)))
    made = links.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{child} {links.schema[child].dataType.simpleString()}")
    made = made.select(*[F.col(c) if c == child else F.lit(parent_id).cast(links.schema[c].dataType).alias(c) if c == parent else F.lit(None).cast(links.schema[c].dataType).alias(c) for c in links.columns])
    return kept.unionByName(made)
