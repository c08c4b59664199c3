"""An append-only change log and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.schema import EntitySchema

#: seq orders changes; op is SAVE or DELETE; pk and row are text and JSON, so one log holds all tables.
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("pk", T.StringType()), T.StructField("row", T.StringType())])


def latest(changes: DataFrame, key: str = "pk", seq: str = "seq") -> DataFrame:
    """The last change of each key, as an aggregate with partial results rather than a sort by key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


class Journal:
    """A folder of Parquet files by entity; a batch of changes gets the next numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], LOG)
            raise

    def last(self) -> int:
        return self.read().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def append(self, schema: EntitySchema, op: str, rows: DataFrame) -> None:
        """One record a row. Numbers rise from the last one; within a batch they need not be consecutive."""
        base = self.last() + 1
        names = [a.name for a in schema.attributes]
        record = rows.select(
            (F.lit(base) + F.monotonically_increasing_id()).alias("seq"), F.lit(op).alias("op"), F.lit(schema.name).alias("entity"),
            F.col(schema.identifier).cast("string").alias("pk"), F.to_json(F.struct(*names)).alias("row"),
        )
        record.write.mode("append").partitionBy("entity").parquet(self.path)

    def replayed(self, schema: EntitySchema, table: DataFrame, until: int | None = None) -> DataFrame:
        """table with the log's changes up to a number applied in order: the last change of each row decides."""
        changes = self.read().filter(F.col("entity") == schema.name)
        changes = changes.filter(F.col("seq") <= until) if until is not None else changes
        last = latest(changes.select("pk", "seq", "op", "row"))
        rows = last.filter(F.col("op") == "SAVE").select(F.from_json("row", schema.struct()).alias("r")).select("r.*")
        kept = table.join(last.select("pk"), F.col(schema.identifier).cast("string") == F.col("pk"), "left_anti")
        return kept.select([a.name for a in schema.attributes]).unionByName(rows)
