"""Entity schemas and the catalog that binds them to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TO_ONE, TO_MANY = ("ONE_TO_ONE", "MANY_TO_ONE"), ("ONE_TO_MANY", "MANY_TO_MANY")
GENERATORS = ("NONE", "SEQUENCE", "UUID")


@dataclass(frozen=True)
class Attribute:
    """A column: Spark type, whether null is allowed, greatest length of a string, values of an enumeration."""

    name: str
    type: T.DataType
    nullable: bool = True
    size: int | None = None
    values: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Relationship:
    """An edge to `target`: rows whose `remote` column equals this side's `local` column.

    With `link` (table, column of this side's key, column of the target's key), rows meet through that
    table. fetch: EAGER (nested into whole-entity results), LAZY or NONE. cascade: NONE, SAVE, DELETE, ALL or
    DEFER_SAVE.
    """

    name: str
    kind: str
    target: str
    local: str
    remote: str
    link: tuple[str, str, str] | None = None
    fetch: str = "LAZY"
    cascade: str = "NONE"

    @property
    def many(self) -> bool:
        return self.kind in TO_MANY


@dataclass(frozen=True)
class Index:
    """kind: ORDERED (a layout hint only), VECTOR or FULL_TEXT; minimum_score under 0 is off."""

    attribute: str
    kind: str = "ORDERED"
    dimensions: int | None = None
    minimum_score: float = -1.0
    quantization: str = "NONE"


@dataclass(frozen=True)
class EntitySchema:
    """A table's declaration. computed: name -> function from the row's columns to an expression."""

    name: str
    attributes: tuple[Attribute, ...]
    identifier: str
    generator: str = "NONE"
    partition: str | None = None
    relationships: tuple[Relationship, ...] = ()
    indexes: tuple[Index, ...] = ()
    computed: dict[str, Callable[[], Column]] = field(default_factory=dict, hash=False)
    searchable: bool = False
    #: Called with the rows of a change; those before it (but before_remove) give back the rows to go on with.
    before_save: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    after_save: tuple[Callable[[DataFrame], None], ...] = ()
    before_insert: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    after_insert: tuple[Callable[[DataFrame], None], ...] = ()
    before_update: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    after_update: tuple[Callable[[DataFrame], None], ...] = ()
    before_remove: tuple[Callable[[DataFrame], None], ...] = ()
    after_remove: tuple[Callable[[DataFrame], None], ...] = ()
    #: Of a table without a partition: into how many files' folders its identifiers are dealt, so that a change rewrites only some.
    buckets: int = 1

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: an attribute is declared twice")
        if self.identifier not in names:
            raise ValueError(f"{self.name}: the identifier {self.identifier} is no attribute")
        if self.partition and self.partition not in names:
            raise ValueError(f"{self.name}: the partition {self.partition} is no attribute")
        if self.buckets < 1 or self.buckets > 1 and self.partition:
            raise ValueError(f"{self.name}: buckets are one or more, of a table without a partition")
        if self.generator not in GENERATORS:
            raise ValueError(f"{self.name}: unknown generator {self.generator}")
        kind = self.attribute(self.identifier).type
        if self.generator == "SEQUENCE" and not isinstance(kind, T.IntegralType):
            raise ValueError(f"{self.name}: a sequence needs a whole-number identifier")
        for r in self.relationships:
            if r.kind not in TO_ONE + TO_MANY:
                raise ValueError(f"{self.name}.{r.name}: unknown relationship {r.kind}")

    @classmethod
    def of(cls, name: str, schema: T.StructType, identifier: str, **options) -> EntitySchema:
        """Declaration with the columns of a StructType."""
        return cls(name, tuple(Attribute(f.name, f.dataType, f.nullable) for f in schema.fields), identifier, **options)

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def relationship(self, name: str) -> Relationship | None:
        return next((r for r in self.relationships if r.name == name), None)

    def index(self, name: str, kind: str) -> Index | None:
        return next((i for i in self.indexes if i.attribute == name and i.kind == kind), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.type, a.nullable) for a in self.attributes])

    def with_(self, **changes) -> EntitySchema:
        return replace(self, **changes)


class Catalog:
    """Schemas by name, each with a function that gives its table as a DataFrame."""

    def __init__(self):
        self.schemas: dict[str, EntitySchema] = {}
        self._tables: dict[str, Callable[[], DataFrame]] = {}
        self._later: dict[str, Callable[[], tuple[EntitySchema, DataFrame]]] = {}

    def add(self, schema: EntitySchema, table: DataFrame | Callable[[], DataFrame]) -> Catalog:
        self.schemas[schema.name] = schema
        self._tables[schema.name] = table if callable(table) else lambda: table
        return self

    def later(self, name: str, load: Callable[[], tuple[EntitySchema, DataFrame]]) -> Catalog:
        """Add an entity whose files are not looked at before a query names it."""
        self._later[name] = load
        return self

    def _load(self, name: str) -> None:
        if name in self._later:
            self.add(*self._later.pop(name)())

    def schema(self, name: str) -> EntitySchema:
        self._load(name)
        if name not in self.schemas:
            raise KeyError(f"unknown entity {name}")
        return self.schemas[name]

    def table(self, name: str) -> DataFrame:
        self._load(name)
        if name not in self._tables:
            raise KeyError(f"unknown table {name}")
        return self._tables[name]()


def violations(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """(problem, rows) for each rule that rows of df break: nulls, string sizes, enumerations, identifiers."""
    rules: list[tuple[str, Column]] = []
    for a in schema.attributes:
        if a.name not in df.columns:
            continue
        c = F.col(a.name)
        if not a.nullable or (a.name == schema.identifier and schema.generator == "NONE"):
            rules.append((f"{a.name} is null", c.isNull()))
        if a.size is not None:
            rules.append((f"{a.name} is longer than {a.size}", F.length(c) > a.size))
        if a.values is not None:
            rules.append((f"{a.name} is none of its values", c.isNotNull() & ~c.isin(*a.values)))
    if not rules:
        return df.sparkSession.createDataFrame([], "problem string, rows long")
    counts = df.agg(*[F.count(F.when(rule, 1)).alias(str(i)) for i, (_, rule) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(text).alias("problem"), F.col(str(i)).alias("rows")) for i, (text, _) in enumerate(rules)])
    return counts.select(F.inline(entries)).filter(F.col("rows") > 0)


def difference(old: EntitySchema, new: EntitySchema) -> dict[str, list[str]]:
    """Names of attributes, relationships and indexes that were added, removed or changed."""
    out: dict[str, list[str]] = {"added": [], "removed": [], "changed": []}
    for part in ("attributes", "relationships"):
        a, b = ({x.name: x for x in getattr(s, part)} for s in (old, new))
        out["added"] += [n for n in b if n not in a]
        out["removed"] += [n for n in a if n not in b]
        out["changed"] += [n for n in b if n in a and a[n] != b[n]]
    a, b = ({(i.attribute, i.kind): i for i in s.indexes} for s in (old, new))
    out["added"] += [f"index {n} {k}" for n, k in b if (n, k) not in a]
    out["removed"] += [f"index {n} {k}" for n, k in a if (n, k) not in b]
    out["changed"] += [f"index {n} {k}" for n, k in b if (n, k) in a and a[n, k] != b[n, k]]
    for r in new.relationships:
        before = old.relationship(r.name)
        if before and before.many and not r.many:
            raise ValueError(f"{new.name}.{r.name}: a to-many relationship can't become to-one")
    return out


def to_json(schema: EntitySchema) -> dict:
    """A plain description that can be kept as a revision; computed members and hooks are code and stay out."""
    return {
        "name": schema.name, "identifier": schema.identifier, "generator": schema.generator, "partition": schema.partition, "buckets": schema.buckets, "searchable": schema.searchable,
        "attributes": [{"name": a.name, "type": a.type.simpleString(), "nullable": a.nullable, "size": a.size, "values": list(a.values) if a.values else None} for a in schema.attributes],
        "relationships": [{**r.__dict__, "link": list(r.link) if r.link else None} for r in schema.relationships],
        "indexes": [dict(i.__dict__) for i in schema.indexes],
    }


def from_json(data: dict) -> EntitySchema:
    attributes = tuple(Attribute(a["name"], T._parse_datatype_string(a["type"]), a["nullable"], a["size"], tuple(a["values"]) if a["values"] else None) for a in data["attributes"])
    relationships = tuple(Relationship(**{**r, "link": tuple(r["link"]) if r["link"] else None}) for r in data["relationships"])
    return EntitySchema(data["name"], attributes, data["identifier"], data["generator"], data["partition"], relationships, tuple(Index(**i) for i in data["indexes"]), searchable=data["searchable"], buckets=data.get("buckets", 1))


def evolved(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """df with the schema's columns in order: missing ones null, surplus ones dropped, types cast where they can be."""
    have = set(df.columns)
    return df.select(*[F.col(a.name).try_cast(a.type).alias(a.name) if a.name in have else F.lit(None).cast(a.type).alias(a.name) for a in schema.attributes])
