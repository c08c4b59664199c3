"""Queries to one lazy DataFrame: search, filter, joins, grouping or projection, distinct, order, paging."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.aggregates import aggregate
from heliograph.functions.scalars import scalar
from heliograph.operators import fulltext, paths, vector
from heliograph.operators.predicates import predicate
from heliograph.plans.ir import Compound, Criteria, Leaf, Not, Query, Search, SqlLike, negated
from heliograph.plans.parse import Call, call
from heliograph.schema import Catalog, EntitySchema, Relationship

#: Rows that a similarity condition keeps if the query has no limit.
NEAREST = 50
SCORE, FULL_TEXT = "__score__", "__full_text__"


class MaxCardinalityExceeded(Exception):
    """A query matched more rows than it allows."""


def name(column: str) -> Column:
    return F.col(f"`{column}`")


class Planner:
    """strict: literals decide the type of a comparison, see predicates.as_literal. max_cardinality: the most rows
    that a query may match if it says nothing itself; None: any number. results: where cached queries are kept."""

    def __init__(self, catalog: Catalog, strict: bool = False, max_cardinality: int | None = None):
        self.catalog, self.strict, self._fresh = catalog, strict, count()
        self.max_cardinality, self.results = max_cardinality, None

    def fresh(self, kind: str) -> str:
        return f"__{kind}{next(self._fresh)}"

    # ---- paths -------------------------------------------------------------------------------------------

    def resolve(self, df: DataFrame, schema: EntitySchema, path: str) -> tuple[DataFrame, Column, T.DataType]:
        """df (with joins that the path needs), the path's column and its type."""
        head, *rest = path.split(".")
        if path == SCORE and SCORE in df.columns:
            return df, name(SCORE), T.DoubleType()
        if attribute := schema.attribute(head):
            return df, *paths.value(name(head), attribute.type, rest)
        if head in schema.computed:
            made = schema.computed[head]()
            kind = df.select(made.alias("c")).schema["c"].dataType
            return df, *paths.value(made, kind, rest)
        if relationship := schema.relationship(head):
            return self.attach(df, relationship, rest)
        raise KeyError(f"{schema.name} has no {path}")

    def attach(self, df: DataFrame, r: Relationship, rest: list[str]) -> tuple[DataFrame, Column, T.DataType]:
        """A related value by a left join: one value of a to-one relationship, a list, never null, of a to-many one."""
        target, schema = self.catalog.table(r.target), self.catalog.schema(r.target)
        if rest and not (rest[0] == "any" or rest[0].isdigit()):
            target, value, kind = self.resolve(target, schema, ".".join(rest))
            below: list[str] = []
        else:
            value = F.struct(*[name(a.name) for a in schema.attributes])
            kind, below = schema.struct(), rest
        key, out = self.fresh("k"), self.fresh("v")
        side = target.select(name(r.remote).alias(key), name(schema.identifier).alias("__id"), value.alias(out)).filter(name(key).isNotNull())
        if r.link:
            table, own, other = r.link
            link = self.catalog.table(table).select(name(own).alias("__own"), name(other).alias("__other")).distinct()
            side = side.join(link, name(key) == F.col("__other")).select(F.col("__own").alias(key), "__id", out)
        if r.many:
            listed = F.array_sort(F.collect_list(F.struct(F.col("__id").alias("id"), name(out).alias("v"))), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
            values, kind = F.transform(listed, lambda x: x["v"]), T.ArrayType(kind)
            if isinstance(kind.elementType, T.ArrayType):
                values, kind = F.flatten(values), kind.elementType
            side = side.groupBy(key).agg(values.alias(out))
        elif r.remote != schema.identifier or r.link:
            side = side.groupBy(key).agg(F.min_by(out, "__id").alias(out))
        else:
            side = side.drop("__id")
        df = df.join(side, name(r.local) == name(key), "left").drop(key)
        column = F.coalesce(name(out), F.array().cast(kind)) if r.many else name(out)
        return df, *paths.value(column, kind, below)

    # ---- conditions --------------------------------------------------------------------------------------

    def related(self, df: DataFrame, schema: EntitySchema, r: Relationship, leaf: Leaf) -> tuple[DataFrame, Column]:
        """A condition over a relationship holds if it holds for any related row; IS_NULL also if there is none."""
        target, other = self.catalog.table(r.target), self.catalog.schema(r.target)
        rest = leaf.path.split(".")[1:]
        rest = rest[1:] if rest[:1] == ["any"] else rest
        if not rest and leaf.operator in ("IS_NULL", "NOT_NULL"):
            df, some = self.flag(df, self.keys(target, r), r.local)
            return df, ~some if leaf.operator == "IS_NULL" else some
        inner = Leaf(".".join(rest) or other.identifier, leaf.operator, leaf.value)
        df, hit = self.flag(df, self.keys(self.where(target, other, inner), r), r.local)
        if leaf.operator == "IS_NULL":
            df, some = self.flag(df, self.keys(target, r), r.local)
            hit = hit | ~some
        return df, hit

    def keys(self, target: DataFrame, r: Relationship) -> DataFrame:
        """(key) of this side's rows that have a related row in target."""
        found = target.select(name(r.remote).alias("key"))
        if r.link:
            table, own, other = r.link
            link = self.catalog.table(table).select(name(own).alias("own"), name(other).alias("other"))
            found = link.join(found, F.col("other") == F.col("key"), "left_semi").select(F.col("own").alias("key"))
        return found.filter(F.col("key").isNotNull())

    def flag(self, df: DataFrame, keys: DataFrame, column: str | Column) -> tuple[DataFrame, Column]:
        """df, not multiplied, with a flag whether the column is among the keys."""
        own, mark = self.fresh("k"), self.fresh("f")
        column = name(column) if isinstance(column, str) else column
        side = keys.select(F.col("key").alias(own)).distinct().withColumn(mark, F.lit(True))
        return df.join(side, column == name(own), "left").drop(own), F.coalesce(name(mark), F.lit(False))

    def listed(self, query: Query) -> DataFrame:
        """(key): the distinct values, without null, of a sub-query of one column."""
        schema = self.catalog.schema(query.entity)
        query = query if query.selections else query.with_(selections=(schema.identifier,))
        df = self.plan(query)
        return df.select(name(df.columns[0]).alias("key")).filter(F.col("key").isNotNull())

    def condition(self, df: DataFrame, schema: EntitySchema, c: Criteria) -> tuple[DataFrame, Column]:
        """df (with flags that the condition needs) and the condition, never null."""
        if isinstance(c, Compound):
            columns = []
            for part in c.parts:
                df, column = self.condition(df, schema, part)
                columns.append(column)
            return df, reduce((lambda a, b: a & b) if c.operator == "AND" else (lambda a, b: a | b), columns)
        if isinstance(c, Not):
            inner = negated(c.part)
            if not isinstance(inner, Not):
                return self.condition(df, schema, inner)
            df, column = self.condition(df, schema, c.part)
            return df, ~column
        if isinstance(c, Search):
            found = self.searched(df, schema, c).select(name(schema.identifier).alias("key"))
            return self.flag(df, found, schema.identifier)
        if isinstance(c, SqlLike):
            df, x, _ = self.resolve(df, schema, c.path)
            return df, F.coalesce(x.like(c.pattern), F.lit(False))
        head, *rest = c.path.split(".")
        if c.path == FULL_TEXT:
            return self.condition(df, schema, negated(Not(Search(str(c.value)))))
        if r := schema.relationship(head):
            return self.related(df, schema, r, c)
        attribute = schema.attribute(head)
        if isinstance(c.value, Query):
            df, x, _ = self.resolve(df, schema, c.path)
            df, hit = self.flag(df, self.listed(c.value), x)
            return df, hit if c.operator == "IN" else ~hit
        if attribute and isinstance(attribute.type, T.StructType) and not rest and c.operator in ("IN", "NOT_IN"):
            rest = ["id"] if "id" in attribute.type.names else rest  # an embedded row against identifiers
        x, kind = (name(head), attribute.type) if attribute else (None, None)
        if x is None:
            df, x, kind = self.resolve(df, schema, head)
        if not rest:
            return df, predicate(x, kind, c.operator, c.value, self.strict)
        return df, paths.holds(x, kind, rest, lambda y, k: predicate(y, k, c.operator, c.value, self.strict))

    def where(self, df: DataFrame, schema: EntitySchema, c: Criteria | None) -> DataFrame:
        """Rows for which c holds. Memberships that must hold alone become semi- or anti-joins."""
        if c is None:
            return df
        kept = df.columns
        for part in c.parts if isinstance(c, Compound) and c.operator == "AND" else (c,):
            if isinstance(part, Not):
                part = negated(part.part)
            r = schema.relationship(part.path.split(".")[0]) if isinstance(part, Leaf) else None
            if isinstance(part, Leaf) and isinstance(part.value, Query) and not r:
                df, x, _ = self.resolve(df, schema, part.path)
                keys, own = self.listed(part.value), self.fresh("k")
                df = df.join(keys.select(F.col("key").alias(own)), x == name(own), "left_semi" if part.operator == "IN" else "left_anti")
            elif r and part.operator != "IS_NULL" and not (len(part.path.split(".")) == 1 and part.operator in ("IS_NULL", "NOT_NULL")):
                rest = [p for p in part.path.split(".")[1:] if p != "any"]
                other = self.catalog.schema(r.target)
                inner = Leaf(".".join(rest) or other.identifier, part.operator, part.value)
                own = self.fresh("k")
                keys = self.keys(self.where(self.catalog.table(r.target), other, inner), r).select(F.col("key").alias(own))
                df = df.join(keys, name(r.local) == name(own), "left_semi")
            else:
                df, column = self.condition(df, schema, part)
                df = df.filter(column)
        return df.select(*[name(n) for n in kept]) if df.columns != kept else df

    # ---- search ------------------------------------------------------------------------------------------

    def searched(self, df: DataFrame, schema: EntitySchema, s: Search) -> DataFrame:
        text = name(s.attribute).cast("string") if s.attribute else fulltext.record_text(df, [a.name for a in schema.attributes])
        return fulltext.search(df, text, s.text, s.minimum_score)

    def search_first(self, df: DataFrame, query: Query, schema: EntitySchema) -> tuple[DataFrame, Criteria | None]:
        """Search conditions that every row must meet come first: the nearest k, then whatever else is asked."""
        rest, least = [], None
        parts = query.criteria.parts if isinstance(query.criteria, Compound) and query.criteria.operator == "AND" else (query.criteria,) if query.criteria else ()
        searches = [p for p in parts if isinstance(p, Search)]
        if searches:
            scores = [p.minimum_score for p in searches if p.minimum_score is not None]
            least = max(scores) if scores else None
        for part in parts:
            index = schema.index(part.path, "VECTOR") if isinstance(part, Leaf) else None
            textual = schema.index(part.path, "FULL_TEXT") if isinstance(part, Leaf) else None
            if index and part.operator in ("LIKE", "MATCHES", "EQUAL") and isinstance(part.value, (list, tuple)):
                k = NEAREST if part.operator == "EQUAL" else query.limit or NEAREST
                if index.dimensions and len(part.value) != index.dimensions:
                    df = df.withColumn(SCORE, F.lit(None).cast("double")).filter(F.lit(False))
                else:
                    df = vector.nearest(df, part.path, list(part.value), k, schema.identifier, index.minimum_score, index.quantization)
            elif textual and part.operator in ("LIKE", "MATCHES"):
                df = self.with_score(df, self.searched(df.drop(SCORE), schema, Search(str(part.value), None, part.path)), schema)
            elif isinstance(part, Search):
                df = self.with_score(df, self.searched(df.drop(SCORE), schema, Search(part.text, None, part.attribute)), schema)
            else:
                rest.append(part)
        if least is not None:
            df = df.filter(name(SCORE) >= least)
        return df, reduce(lambda a, b: Compound("AND", (*(a.parts if isinstance(a, Compound) and a.operator == "AND" and a is not rest[0] else (a,)), b)), rest) if rest else None

    def with_score(self, before: DataFrame, found: DataFrame, schema: EntitySchema) -> DataFrame:
        """Scores of several searches add up."""
        if SCORE not in before.columns:
            return found
        own = before.select(name(schema.identifier).alias("__id"), name(SCORE).alias("__before"))
        joined = found.join(own, name(schema.identifier) == F.col("__id"))
        return joined.withColumn(SCORE, name(SCORE) + F.col("__before")).drop("__id", "__before")

    # ---- expressions -------------------------------------------------------------------------------------

    def expression(self, df: DataFrame, schema: EntitySchema, text: str) -> tuple[DataFrame, Column, T.DataType, Call | None]:
        """A path or a scalar call as a column; of an aggregate, the column it is over."""
        c = call(text)
        if c is None:
            return *self.resolve(df, schema, text), None
        if c.aggregate and c.attribute in ("", "*"):
            return df, F.lit(1), T.IntegerType(), c
        df, x, kind = self.resolve(df, schema, c.attribute)
        if c.aggregate:
            return df, x, kind, c
        out = scalar(c.function, x, kind, c.arguments)
        return df, out, T.StringType(), None

    def selected(self, schema: EntitySchema, query: Query) -> list[str]:
        out: list[str] = []
        for s in query.selections:
            for item in [a.name for a in schema.attributes] if s == "*" else [s]:
                if item not in out:
                    out.append(item)
        if not out:
            out = [a.name for a in schema.attributes] + [r.name for r in schema.relationships if r.fetch == "EAGER"]
        return out + [r for r in query.resolvers if r not in out]

    # ---- whole queries -----------------------------------------------------------------------------------

    def source(self, query: Query) -> tuple[DataFrame, EntitySchema]:
        schema = self.catalog.schema(query.entity)
        df = self.catalog.table(query.entity)
        if query.partition is not None:
            if not schema.partition:
                raise ValueError(f"{schema.name} has no partition")
            df = df.filter(name(schema.partition) == F.lit(query.partition).cast(schema.attribute(schema.partition).type))
        return df, schema

    def matching(self, query: Query) -> tuple[DataFrame, EntitySchema]:
        """The rows that the query's conditions let through, before any projection."""
        df, schema = self.source(query)
        df, rest = self.search_first(df, query, schema)
        df = self.where(df, schema, rest)
        most = query.max_cardinality if query.max_cardinality is not None else self.max_cardinality
        if most is not None and df.limit(most + 1).count() > most:  # counted in place, no row comes to the driver
            raise MaxCardinalityExceeded(f"{query.entity}: more than {most} rows")
        return df, schema

    def plan(self, query: Query) -> DataFrame:
        df, schema = self.matching(query)
        selections = self.selected(schema, query)
        calls = [call(s) for s in selections] + [call(o.expression) for o in query.order_by]
        if any(c and c.aggregate for c in calls) or query.group_by:
            return self.paged(*self.grouped(df, schema, query, selections), query)
        columns = {}
        for s in selections:
            df, x, _, _ = self.expression(df, schema, s)
            columns[s] = x
        orders = []
        for o in query.order_by:
            df, x, _, _ = self.expression(df, schema, o.expression)
            orders.append((x, o.ascending))
        if query.distinct and query.selections:
            # of rows that are one after the projection, each order takes the value that comes first in it
            keys = [self.fresh("o") for _ in orders]
            df = df.select(*[x.alias(s) for s, x in columns.items()], *[F.struct(x.alias("v")).alias(k) for k, (x, _) in zip(keys, orders, strict=True)])
            if keys:
                df = df.groupBy(*[name(s) for s in columns]).agg(*[(F.min if up else F.max)(name(k))["v"].alias(k) for k, (_, up) in zip(keys, orders, strict=True)])
            else:
                df = df.distinct()
            return self.paged(df, [(name(k), up) for k, (_, up) in zip(keys, orders, strict=True)], list(columns), query)
        if not orders and SCORE in df.columns:
            orders = [(name(SCORE), False), (name(schema.identifier), True)]
        return self.paged(df, orders, [x.alias(s) for s, x in columns.items()], query)

    def grouped(self, df: DataFrame, schema: EntitySchema, query: Query, selections: list[str]):
        """One row a group, or one row at all; bare columns come from the row that a lone min or max took,
        else from the first row by identifier that has a value."""
        keys, aggregates = [], {}
        for g in query.group_by:
            df, x, _, _ = self.expression(df, schema, g)
            key = self.fresh("g")
            df = df.withColumn(key, x)
            keys.append(key)
        if not query.selections:
            selections = [a.name for a in schema.attributes]
        wanted, prepared = [*selections, *[o.expression for o in query.order_by]], {}
        for s in dict.fromkeys(wanted):
            if s in query.group_by:
                continue
            df, x, kind, c = self.expression(df, schema, s)
            value = self.fresh("x")
            df = df.withColumn(value, x)
            prepared[s] = (name(value), kind, c)
        extremes = [(x, c) for x, _, c in prepared.values() if c and c.function in ("min", "max")]
        plain = not any(c for _, _, c in prepared.values())
        identifier = name(schema.identifier)
        row = F.min_by(F.struct(*[x.alias(f"c{i}") for i, (x, _, c) in enumerate(prepared.values()) if not c]), identifier) if plain and prepared else None
        if row is not None:  # no aggregate: whole first rows
            aggregates["__first"] = row
        for i, (s, (x, kind, c)) in enumerate(prepared.items()):
            if c:
                aggregates[s] = aggregate(c.function, x, kind, c.arguments, query.distinct)
            elif not plain and not keys and len(extremes) == 1:
                over, best = extremes[0]
                aggregates[s] = (F.max_by if best.function == "max" else F.min_by)(x, F.struct(over.alias("v"), identifier.alias("k")))
            elif not plain:
                aggregates[s] = F.min_by(x, F.when(x.isNotNull(), identifier))
        out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*[a.alias(s) for s, a in aggregates.items()]) if aggregates else df.select(*keys).distinct()
        if row is not None:
            out = out.select(*keys, *[F.col("__first")[f"c{i}"].alias(s) for i, s in enumerate(prepared)])
        place = {g: name(k) for g, k in zip(query.group_by, keys, strict=True)}
        orders = [(place.get(o.expression, name(o.expression)), o.ascending) for o in query.order_by]
        return out, orders, [place[s].alias(s) if s in place else name(s) for s in selections]

    def paged(self, df: DataFrame, orders, columns, query: Query) -> DataFrame:
        """Null is lowest: first when ascending, last when descending. Offsets are exact."""
        if orders:
            df = df.orderBy(*[x.asc_nulls_first() if up else x.desc_nulls_last() for x, up in orders])
        if query.offset:
            df = df.offset(query.offset)
        if query.limit is not None:
            df = df.limit(query.limit)
        return df.select(*columns)

    def counted(self, query: Query) -> int:
        """Matching rows, whatever the query's limit; without a condition, from the files' footers where they allow it."""
        return self.matching(query.with_(order_by=(), limit=None, offset=0))[0].count()
