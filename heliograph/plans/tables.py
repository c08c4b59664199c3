"""The catalog of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.builder import Database
from heliograph.schema import Catalog, EntitySchema, Index, Relationship


def sparse(orders: DataFrame) -> DataFrame:
    """Orders with nulls: no price for every 7th key, no priority for every 5th."""
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey", "o_custkey", F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 3 != 0, key % 11).alias("bucket"), F.col("o_orderstatus").alias("status"),
    )


SPARSE = """sparse AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 END AS bucket, o_orderstatus AS status FROM orders)"""

#: Per table: identifier, then what else the declaration holds.
DECLARED = {
    "region": ("r_regionkey", {"relationships": (Relationship("nations", "ONE_TO_MANY", "nation", "r_regionkey", "n_regionkey"),)}),
    "nation": ("n_nationkey", {"relationships": (Relationship("region", "MANY_TO_ONE", "region", "n_regionkey", "r_regionkey"), Relationship("customers", "ONE_TO_MANY", "customer", "n_nationkey", "c_nationkey"), Relationship("suppliers", "ONE_TO_MANY", "supplier", "n_nationkey", "s_nationkey"))}),
    "customer": ("c_custkey", {"partition": "c_mktsegment", "relationships": (Relationship("nation", "MANY_TO_ONE", "nation", "c_nationkey", "n_nationkey"), Relationship("orders", "ONE_TO_MANY", "orders", "c_custkey", "o_custkey"))}),
    "supplier": ("s_suppkey", {"relationships": (Relationship("nation", "MANY_TO_ONE", "nation", "s_nationkey", "n_nationkey"), Relationship("parts", "MANY_TO_MANY", "part", "s_suppkey", "p_partkey", ("lineitem", "l_suppkey", "l_partkey")))}),
    "part": ("p_partkey", {"relationships": (Relationship("suppliers", "MANY_TO_MANY", "supplier", "p_partkey", "s_suppkey", ("lineitem", "l_partkey", "l_suppkey")),)}),
    "orders": ("o_orderkey", {"relationships": (Relationship("customer", "MANY_TO_ONE", "customer", "o_custkey", "c_custkey"), Relationship("items", "ONE_TO_MANY", "lineitem", "o_orderkey", "l_orderkey")), "indexes": (Index("o_totalprice"), Index("o_orderdate")), "computed": {"is_large": lambda: F.col("o_totalprice") > 250000}}),
    "lineitem": ("l_id", {"relationships": (Relationship("order", "MANY_TO_ONE", "orders", "l_orderkey", "o_orderkey"), Relationship("part", "MANY_TO_ONE", "part", "l_partkey", "p_partkey"), Relationship("supplier", "MANY_TO_ONE", "supplier", "l_suppkey", "s_suppkey"))}),
    "events": ("event_id", {"partition": "event_type"}),
    "documents": ("doc_id", {"partition": "lang", "searchable": True, "indexes": (Index("text", "FULL_TEXT"),), "relationships": (Relationship("label", "ONE_TO_ONE", "labels", "doc_id", "doc_id"),)}),
    "labels": ("doc_id", {}),
    "embeddings": ("vec_id", {"indexes": (Index("embedding", "VECTOR", 64),)}),
    "pages": ("page_id", {"searchable": True}),
    "benchmark": ("item_id", {"searchable": True}),
    "sparse": ("o_orderkey", {"relationships": (Relationship("customer", "MANY_TO_ONE", "customer", "o_custkey", "c_custkey"),)}),
    "conversations": ("turn_id", {}),
}


def database(spark: SparkSession, sf_dir: str, strict: bool = False) -> Database:
    """All test tables by their relationships. Schemas come from the files' footers, once a query names them."""
    catalog = Catalog()
    for name in DECLARED:
        catalog.later(name, lambda name=name: table(spark, sf_dir, name))
    return Database(catalog, strict)


def table(spark: SparkSession, sf_dir: str, name: str) -> tuple[EntitySchema, DataFrame]:
    identifier, options = DECLARED[name]
    df = spark.read.parquet(f"{sf_dir}/{'orders' if name == 'sparse' else name}.parquet")
    if name == "sparse":
        df = sparse(df)
    elif name == "lineitem":  # it has no key of its own
        df = df.withColumn("l_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    elif name == "conversations":
        df = df.withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    return EntitySchema.of(name, df.schema, identifier, **options), df
