"""A warehouse of Parquet tables. Each write makes files beside the old ones and then a commit that names what counts.

A commit lists the folder of each partition value or bucket of identifiers (of a table without either, its one
folder), so a change rewrites the parts that it touches and takes the others over. Commits are numbered; of two writers that
begin with the same one, the first to finish wins and the other is told so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.builder import Database
from heliograph.operators import dml
from heliograph.plans.ir import Query
from heliograph.plans.parse import cascades
from heliograph.schema import Catalog, EntitySchema, difference, evolved, from_json, to_json, violations
from heliograph.sources.journal import Journal


class Files:
    """Small files and folders by Spark's own file systems, so any store will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside, then renamed: readers see the old file or the new one."""
        aside, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        p, _ = self._at(path)
        if not fs.rename(aside, p):
            fs.delete(p, False)
            fs.rename(aside, p)

    def create(self, path: str, text: str) -> bool:
        """Written aside, then renamed; False if the file is there already. As atomic as the store's own rename."""
        aside, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, self._at(path)[0], how)
        except Py4JJavaError as error:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


class Conflict(RuntimeError):
    """Another writer changed the table first; what this one wrote is gone."""


class Warehouse(Database):
    """Tables under a folder: saved, changed, deleted, journaled, cloned. Never the only reader's job to lock: a
    reader keeps the version it began with."""

    def __init__(self, spark: SparkSession, root: str, journal: bool = False, strict: bool = False):
        super().__init__(Catalog(), strict)
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.journal = Journal(spark, f"{self.root}/_journal") if journal else None
        for name in self.files.names(self.root):
            if text := self.files.read(f"{self.root}/{name}/_schema.json"):
                self._bind(from_json(json.loads(text)[-1]))

    def _bind(self, schema: EntitySchema) -> None:
        self.catalog.add(schema, lambda: self.read(schema.name))

    # ---- schemas -----------------------------------------------------------------------------------------

    def declare(self, schema: EntitySchema) -> EntitySchema:
        """Make the table, or bring it to the new declaration; every revision is kept."""
        path = f"{self.root}/{schema.name}/_schema.json"
        revisions = json.loads(self.files.read(path) or "[]")
        if revisions:
            last = from_json(revisions[-1])
            if not any(difference(last, schema).values()) and (last.partition, last.buckets) == (schema.partition, schema.buckets):
                self._bind(schema)
                return schema
        self.files.write(path, json.dumps([*revisions, to_json(schema)]))
        self._bind(schema)
        if not revisions:
            self._write(schema, self.spark.createDataFrame([], schema.struct()))
        return schema

    def validate(self, schema: EntitySchema) -> dict:
        """What declaring the schema would change; of a table that is not there, all of it is new. Nothing is written."""
        revisions = self.history(schema.name)
        return difference(revisions[-1] if revisions else schema.with_(attributes=(schema.attribute(schema.identifier),), partition=None, relationships=(), indexes=()), schema)

    def history(self, name: str) -> list[EntitySchema]:
        return [from_json(r) for r in json.loads(self.files.read(f"{self.root}/{name}/_schema.json") or "[]")]

    # ---- tables ------------------------------------------------------------------------------------------

    def _version(self, name: str) -> int:
        """The number of the table's last commit; 0 before the first."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/{name}/_commits") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _commit(self, name: str, version: int) -> dict:
        """What a commit holds: the revision it was written under, and the folder of each partition value."""
        text = self.files.read(f"{self.root}/{name}/_commits/{version}.json") if version else None
        return json.loads(text) if text else {"revision": 0, "folders": {}}

    def read(self, name: str, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The current version, or an earlier one, in the current declaration: columns it lacks are null, surplus ones are left out.

        only: the parts to read, by their names in the commit.
        """
        schema = self.catalog.schema(name)
        folders = self._commit(name, self._version(name) if version is None else version)["folders"]
        folders = {part: folder for part, folder in folders.items() if only is None or part in only}
        if not folders:
            return self.spark.createDataFrame([], schema.struct())
        paths = [f"{self.root}/{name}/{folder}/{part}".rstrip("/") for part, folder in folders.items()]
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        if schema.partition:  # its values are names of folders: 007 is to stay a text where it is declared as one
            stored, kind = reader.parquet(paths[0]).schema, schema.attribute(schema.partition).type
            reader = reader.schema(T.StructType([T.StructField(f.name, kind) if f.name == schema.partition else f for f in stored if f.name != "v" or schema.attribute("v")]))
        return evolved(reader.parquet(*paths), schema)

    def _part(self, schema: EntitySchema) -> tuple[str | None, Column | None]:
        """What a table is divided by: its partition, else buckets of its identifiers, else nothing."""
        if schema.partition:
            return schema.partition, F.col(schema.partition)
        if schema.buckets > 1:
            return "_bucket", F.pmod(F.xxhash64(schema.identifier), F.lit(schema.buckets)).cast("int")
        return None, None

    def _touched(self, schema: EntitySchema, since: int, *frames: DataFrame) -> list | None:
        """The parts that rows belong to, as many as the table has at most; None for a table that must be written whole."""
        part, place = self._part(schema)
        if part is None or self._commit(schema.name, since)["revision"] != len(self.history(schema.name)):
            return None
        return [r[0] for r in reduce(DataFrame.unionByName, [f.select(place.alias("v")) for f in frames]).distinct().collect()]

    def _names(self, schema: EntitySchema, values: list) -> set[str]:
        """The names of parts' folders."""
        part, _ = self._part(schema)
        kind = schema.attribute(part).type if schema.partition else T.IntegerType()
        texts = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)])).select(F.col("v").cast("string")).collect()
        path_of = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return {path_of(part, r[0]) for r in texts}

    def _write(self, schema: EntitySchema, df: DataFrame, since: int | None = None, values: list | None = None) -> None:
        """Make df the table's content. since: the version it was made from, which must still be the last one.

        values: the parts in which df differs from that version, by _touched(); only these are written.
        """
        name = schema.name
        part, place = self._part(schema)
        since = self._version(name) if since is None else since
        kept: dict[str, str] = {}
        if part and not schema.partition:
            df = df.withColumn(part, place)
        if values is not None:
            within = F.col(part).isin(*[v for v in values if v is not None])
            if None in values or "" in values:  # these share a folder
                within = F.coalesce(within, F.lit(False)) | F.col(part).isNull() | (F.col(part).cast("string") == "")
            df, gone = df.filter(within), self._names(schema, values)
            kept = {k: v for k, v in self._commit(name, since)["folders"].items() if k not in gone}
        layout = [i.attribute for i in schema.indexes if i.kind == "ORDERED"] or [schema.identifier]
        if part:
            df = df.hint("rebalance", part)  # files of even size, however large a value's share is
        writer = df.sortWithinPartitions(*layout).write  # min and max of the files' parts then tell ranges apart
        if part:
            writer = writer.partitionBy(part)
        folder = f"v={since + 1}-{uuid.uuid4().hex}"
        writer.parquet(f"{self.root}/{name}/{folder}")
        made = [n for n in self.files.names(f"{self.root}/{name}/{folder}") if n.startswith(f"{part}=")] if part else [""]
        commit = {"revision": len(self.history(name)), "folders": kept | dict.fromkeys(made, folder)}
        if not self.files.create(f"{self.root}/{name}/_commits/{since + 1}.json", json.dumps(commit)):
            self.files.delete(f"{self.root}/{name}/{folder}")
            raise Conflict(f"{name} has changed since version {since}")
        self.planner.results.written(name)

    def vacuum(self, name: str) -> None:
        """Drop all versions but the current one, and what unfinished writes left; no write may be under way."""
        at, version = f"{self.root}/{name}", self._version(name)
        folders = self._commit(name, version)["folders"]
        for folder in self.files.names(at):
            if folder.startswith("v=") and folder not in folders.values():
                self.files.delete(f"{at}/{folder}")
            elif folder.startswith("v="):
                for part in self.files.names(f"{at}/{folder}"):
                    if "=" in part and folders.get(part) != folder:
                        self.files.delete(f"{at}/{folder}/{part}")
        for commit in self.files.names(f"{at}/_commits"):
            if commit != f"{version}.json":
                self.files.delete(f"{at}/_commits/{commit}")

    # ---- rows --------------------------------------------------------------------------------------------

    def save(self, name: str, rows: DataFrame | Iterable[dict]) -> int:
        """Insert rows, or replace those with their identifiers; the number of rows. Broken rules are an error."""
        schema = self.catalog.schema(name)
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([tuple(r.get(a.name) for a in schema.attributes) for r in rows], _loose(schema))
        rows = evolved(rows, schema)
        for hook in schema.before_save:
            rows = hook(rows)
        since = self._version(name)
        table = self.read(name, since)
        rows = dml.with_identifiers(table, rows, schema)
        # written aside: what a hook, a generator of identifiers or a source gives is computed once, whatever is lost later
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        rows.withColumn("_order", F.monotonically_increasing_id()).write.parquet(aside)
        try:
            number = self.spark.read.parquet(aside).count()
            rows = dml.last_of(self.spark.read.parquet(aside), schema.identifier, "_order")
            if schema.before_insert or schema.after_insert or schema.before_update or schema.after_update:
                fresh = rows.join(table, schema.identifier, "left_anti").select(rows.columns)
                known = rows.join(table, schema.identifier, "left_semi").select(rows.columns)
                for hook in schema.before_insert:
                    fresh = hook(fresh)
                for hook in schema.before_update:
                    known = hook(known)
                if schema.before_insert or schema.before_update:
                    rows = fresh.unionByName(known)
            if problems := violations(rows, schema).collect():
                raise ValueError(f"{name}: " + "; ".join(f"{p['problem']} in {p['rows']} rows" for p in problems))
            if self.journal:
                self.journal.append(schema, "SAVE", rows)
            # a row may come from another partition, but never from another bucket
            old = [table.join(rows.select(schema.identifier), schema.identifier, "left_semi")] if schema.partition else []
            values = self._touched(schema, since, rows, *old)
            if values is not None:
                table = self.read(name, since, self._names(schema, values))
            self._write(schema, dml.replaced(table, rows, schema), since, values)
            for hook in schema.after_insert:
                hook(fresh)
            for hook in schema.after_update:
                hook(known)
            for hook in schema.after_save:
                hook(rows)
            return number
        finally:
            self.files.delete(aside)

    def save_in_batches(self, name: str, rows: DataFrame, size: int = 1000) -> int:
        """As save(), prepared in tasks of about `size` rows each."""
        number = rows.count()
        return self.save(name, rows.repartition(max(1, -(-number // size)))) if number else 0

    def remove(self, name: str, identifiers: Iterable[Any] | DataFrame) -> int:
        schema = self.catalog.schema(name)
        kind = schema.attribute(schema.identifier).type.simpleString()
        keys = identifiers if isinstance(identifiers, DataFrame) else self.spark.createDataFrame([(i,) for i in identifiers], f"{schema.identifier} {kind}")
        since = self._version(name)
        table = self.read(name, since)
        gone = table.join(keys.select(schema.identifier), schema.identifier, "left_semi")
        number = gone.count()
        for hook in schema.before_remove:
            hook(gone)
        if self.journal:
            self.journal.append(schema, "DELETE", gone)
        values = self._touched(schema, since, gone)
        if values is not None:
            table = self.read(name, since, self._names(schema, values))
        self._write(schema, dml.without(table, keys, schema.identifier), since, values)
        for hook in schema.after_remove:
            hook(gone)
        return number

    def update(self, query: Query) -> int:
        """Set the query's literals in the rows it matches; how many."""
        schema, since = self.catalog.schema(query.entity), self._version(query.entity)
        df, number = dml.updated(self.planner, query)
        changed = number.first()["n"]
        if changed:
            table, hit = dml.targets(self.planner, query)
            hits = table.filter(hit)
            rows = hits.select(*[F.lit(query.updates[c]).cast(t).alias(c) if c in query.updates else F.col(c) for c, t in ((a.name, a.type) for a in schema.attributes)])
            if self.journal:
                self.journal.append(schema, "SAVE", rows)
            self._write(schema, df, since, self._touched(schema, since, hits.select(rows.columns), rows))
        return changed

    def delete(self, query: Query) -> int:
        """Remove the rows that the query matches; how many. Without a condition, the table is truncated."""
        schema, since = self.catalog.schema(query.entity), self._version(query.entity)
        df, number = dml.deleted(self.planner, query)
        gone = number.first()["n"]
        if gone:
            table, hit = dml.targets(self.planner, query)
            hits = table.filter(hit)
            if self.journal:
                self.journal.append(schema, "DELETE", hits)
            self._write(schema, df, since, self._touched(schema, since, hits))
        return gone

    def truncate(self, name: str, partition: Any = None) -> int:
        return self.delete(Query(name, partition=partition))

    # ---- relationships -----------------------------------------------------------------------------------

    def relate(self, name: str, relationship: str, identifier: Any, ids: list) -> None:
        """Replace what a row is related to. By a link table its rows are rewritten, else the related rows' columns."""
        schema = self.catalog.schema(name)
        r = schema.relationship(relationship)
        if r.link:
            table, own, other = r.link
            link = self.catalog.schema(table)
            self._write(link, dml.linked(self.read(table), own, other, identifier, ids))
            return
        target = self.catalog.schema(r.target)
        rows = self.read(r.target)
        mine = F.col(target.identifier).isin(*ids) if ids else F.lit(False)
        column = F.when(mine, F.lit(identifier)).when(F.col(r.remote).eqNullSafe(F.lit(identifier)), F.lit(None)).otherwise(F.col(r.remote))
        self._write(target, rows.withColumn(r.remote, column.cast(target.attribute(r.remote).type)))

    def save_with(self, name: str, rows: DataFrame, related: dict[str, DataFrame]) -> dict[str, int]:
        """Save rows, and related rows where the relationship cascades saves: parents of a row before it, children after it."""
        schema = self.catalog.schema(name)
        done: dict[str, int] = {}
        late = []
        for key, frame in related.items():
            r = schema.relationship(key)
            if r.cascade not in ("SAVE", "ALL", "DEFER_SAVE"):
                continue
            if r.many or r.cascade == "DEFER_SAVE":
                late.append((key, r, frame))
            else:
                done[key] = self.save(r.target, frame)
        done[name] = self.save(name, rows)
        for key, r, frame in late:
            done[key] = self.save(r.target, frame)
        return done

    def save_cascading(self, name: str, rows: DataFrame, related: dict[str, DataFrame], instructions: str) -> dict[str, int]:
        """Save rows and, by instructions like `items:Item(order_id, id)`, rows below them.

        Rows under an attribute are saved to its type; those whose target field is null get the source field
        of the parent that the column `_parent` (the parent's identifier) names.
        """
        schema = self.catalog.schema(name)
        done = {name: self.save(name, rows)}
        for c in cascades(instructions):
            if c.attribute not in related:
                continue
            frame = related[c.attribute]
            if "_parent" in frame.columns:
                parents = rows.select(F.col(schema.identifier).alias("_parent"), F.col(c.source).alias("_source"))
                frame = frame.join(parents, "_parent", "left")
                have = F.col(c.target) if c.target in frame.columns else F.lit(None)
                frame = frame.withColumn(c.target, F.coalesce(have, F.col("_source"))).drop("_parent", "_source")
            done[c.attribute] = self.save(c.type, frame)
        return done

    def remove_cascading(self, name: str, identifiers: list, instructions: str) -> dict[str, int]:
        """Remove rows and, by instructions like `items:Item(order_id, id)`, the rows of that type whose target field holds the source field of one of them."""
        schema = self.catalog.schema(name)
        rows = self.read(name).filter(F.col(schema.identifier).isin(*identifiers))
        done: dict[str, int] = {}
        for c in cascades(instructions):
            below = self.catalog.schema(c.type)
            sources = rows.select(F.col(c.source).alias("_source")).distinct()
            ids = self.read(c.type).join(sources, F.col(c.target) == F.col("_source"), "left_semi").select(below.identifier)
            done[c.attribute] = self.remove(c.type, ids)
        done[name] = self.remove(name, identifiers)
        return done

    def remove_with(self, name: str, identifiers: list) -> dict[str, int]:
        """Remove rows, rows they are related to where the relationship cascades deletes, rows those are related to, and so on.

        Rows below go first. A table that a chain of relationships comes back to is not gone through again.
        """
        schema = self.catalog.schema(name)
        kind = schema.attribute(schema.identifier).type.simpleString()
        return self._remove_below(name, self.spark.createDataFrame([(i,) for i in identifiers], f"{schema.identifier} {kind}"), (name,))

    def _remove_below(self, name: str, ids: DataFrame, above: tuple[str, ...]) -> dict[str, int]:
        schema = self.catalog.schema(name)
        rows = self.read(name).join(ids, schema.identifier, "left_semi")
        done: dict[str, int] = {}
        for r in schema.relationships:
            if r.cascade not in ("DELETE", "ALL") or r.target in above:
                continue
            target = self.catalog.schema(r.target)
            keys = rows.select(F.col(r.local).alias("_local")).distinct()
            if r.link:
                table, own, other = r.link
                keys = self.read(table).join(keys, F.col(own) == F.col("_local"), "left_semi").select(F.col(other).alias("_local"))
            below = self.read(r.target).join(keys, F.col(r.remote) == F.col("_local"), "left_semi").select(target.identifier)
            for key, number in self._remove_below(r.target, below, (*above, r.target)).items():
                key = r.name if key == r.target else f"{r.name}.{key}"
                done[key] = done.get(key, 0) + number
        done[name] = self.remove(name, ids)
        return done

    # ---- whole warehouses --------------------------------------------------------------------------------

    def clone_to(self, other: Warehouse, names: Iterable[str] | None = None) -> None:
        for name in names or list(self.catalog.schemas):
            schema = other.declare(self.catalog.schema(name))
            other._write(schema, self.read(name))

    def verify(self) -> dict[str, int]:
        """Rows of each table, all of which are read; a file that can't be read is an error."""
        return {name: rows for name, (rows, _) in self.checksums().items()}

    def checksums(self) -> dict[str, tuple[int, int]]:
        """Rows of each table and a sum of their hashes: equal for equal contents, whatever the order and the files."""
        out = {}
        for name, schema in self.catalog.schemas.items():
            hashed = F.xxhash64(*[F.col(a.name) for a in schema.attributes if a.type.typeName() != "map"]).cast("decimal(38,0)")
            row = self.read(name).select(hashed.alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0))).first()
            out[name] = (row[0], int(row[1]))
        return out

    def recover(self, journal: Journal, until: int | None = None) -> None:
        """Bring every table to the journal's state after the given sequence number."""
        for name, schema in self.catalog.schemas.items():
            self._write(schema, journal.replayed(schema, self.read(name).limit(0), until))

    def all_tables(self) -> dict[str, tuple[DataFrame, str]]:
        return {n: (self.read(n), s.identifier) for n, s in self.catalog.schemas.items()}


def _loose(schema: EntitySchema):
    """The schema's columns, all of which may be null until the rules are checked."""
    return T.StructType([T.StructField(a.name, a.type, True) for a in schema.attributes])


def in_memory(spark: SparkSession, tables: dict[str, tuple[EntitySchema, DataFrame]]) -> Database:
    """A database of cached frames, for data that no file should hold."""
    catalog = reduce(lambda c, item: c.add(item[0], item[1].persist()), tables.values(), Catalog())
    return Database(catalog)
