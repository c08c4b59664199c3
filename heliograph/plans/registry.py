"""One query for each operator, with its SQL."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph import builder as b
from heliograph import results
from heliograph.builder import Database, asc, col, desc, search
from heliograph.functions.scalars import cast_or_zero, parsed_date
from heliograph.operators import dml, fulltext, vector
from heliograph.plans.ir import Order, Query
from heliograph.plans.planner import MaxCardinalityExceeded
from heliograph.plans.tables import DECLARED, SPARSE, database
from heliograph.schema import Attribute
from heliograph.sources.indexes import TextIndex, VectorIndex
from heliograph.sources.journal import latest
from heliograph.sources.warehouse import Warehouse
from heliograph.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(key: str, build: Callable[[Database], DataFrame | b.Builder], sql: str | None, *names: str) -> None:
    """Register build's result, its columns renamed to names, and the SQL for it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(database(spark, sf_dir))
        df = made.df() if isinstance(made, b.Builder) else made
        return df.toDF(*names) if names else df

    QUERIES[key] = run
    if sql:
        SQL[key] = sql


def of_sparse(key: str, criteria, where: str) -> None:
    add(key, lambda d: d.select("o_orderkey", "status").from_("sparse").where(criteria), f"WITH {SPARSE} SELECT o_orderkey, status FROM sparse WHERE {where}")


# ---- scans -----------------------------------------------------------------------------------------------

add("s01_full_scan", lambda d: d.select("o_orderkey", "o_totalprice").from_("orders").where(col("o_orderpriority").starts_with("1")), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%'")
add("s02_partition_scan", lambda d: d.select("c_custkey", "c_acctbal").from_("customer").in_partition("BUILDING").where(col("c_acctbal").gt(0.0)), "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
add("s03_identifier_point", lambda d: d.select("o_orderkey", "o_custkey").from_("orders").where(col("o_orderkey").eq(77)), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
add("s03_identifier_range", lambda d: d.select("o_orderkey").from_("orders").where(col("o_orderkey").lte(5000)).order_by("o_orderkey").offset(100).limit(20), "SELECT o_orderkey FROM orders WHERE o_orderkey <= 5000 ORDER BY 1 LIMIT 20 OFFSET 100")
add("s04_partition_identifier", lambda d: d.select("c_custkey", "c_name").from_("customer").in_partition("MACHINERY").where(col("c_custkey").between(10, 400)), "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey BETWEEN 10 AND 400")
add("s05_index_range", lambda d: d.select("o_orderkey", "o_totalprice").from_("orders").where(col("o_totalprice").gte(400000.0)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000")
add("s06_partition_index", lambda d: d.select("event_id", "value").from_("events").in_partition("click").where(col("value").lt(3.5)), "SELECT event_id, value FROM events WHERE event_type = 'click' AND value < 3.5")
add("s07_relationship_scan", lambda d: d.select("c_custkey").from_("customer").where(col("orders.o_totalprice").gt(480000.0)), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
add("s08_complement", lambda d: d.select("o_orderkey").from_("orders").where(~(col("o_orderstatus").eq("F") & col("o_totalprice").lt(450000.0))), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 450000)")
add("s14_range_merge", lambda d: d.select("o_orderkey").from_("orders").where(col("o_totalprice").gt(100000.0)).and_(col("o_totalprice").lt(101000.0)), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 101000")

# ---- predicates ------------------------------------------------------------------------------------------

of_sparse("c01_equal", col("priority").eq("2-HIGH"), "priority = '2-HIGH'")
of_sparse("c01_equal_null", col("priority").eq(None), "priority IS NULL")
of_sparse("c02_not_equal", col("priority").neq("2-HIGH"), "priority IS DISTINCT FROM '2-HIGH'")
of_sparse("c03_greater_than", col("price").gt(300000.0), "price > 300000")
of_sparse("c04_greater_than_equal", col("bucket").gte(6), "bucket >= 6")
of_sparse("c05_less_than", col("price").lt(20000.0), "price IS NULL OR price < 20000")
of_sparse("c06_less_than_equal", col("bucket").lte(3), "bucket IS NULL OR bucket <= 3")
of_sparse("c07_between", col("price").between(100000.0, 120000.0), "price BETWEEN 100000 AND 120000")
of_sparse("c08_not_between", col("price").not_between(20000.0, 480000.0), "price IS NULL OR price < 20000 OR price > 480000")
of_sparse("c09_in", col("bucket").is_in([1, 4, None]), "bucket IN (1, 4)")
of_sparse("c10_not_in", col("bucket").not_in([1, 4, None]), "bucket IS NULL OR bucket NOT IN (1, 4)")
add("c11_in_subquery", lambda d: d.select("o_orderkey").from_("orders").where(col("o_custkey").is_in(d.select("c_custkey").from_("customer").where(col("c_acctbal").gt(9000.0)))), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
add("c12_not_in_subquery", lambda d: d.select("doc_id").from_("documents").where(col("doc_id").not_in(d.select("doc_id").from_("labels").where(col("quality").eq(1)))), "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
add("c12_not_in_nullable_subquery", lambda d: d.select("o_orderkey").from_("sparse").where(col("bucket").not_in(d.select("bucket").from_("sparse").where(col("price").gt(499000.0)))), f"WITH {SPARSE} SELECT o_orderkey FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM sparse t WHERE t.price > 499000 AND t.bucket = s.bucket)")
of_sparse("c13_is_null", col("bucket").is_null(), "bucket IS NULL")
of_sparse("c14_not_null", col("bucket").not_null(), "bucket IS NOT NULL")
of_sparse("c15_starts_with", col("priority").starts_with("3-"), "coalesce(priority LIKE '3-%', false)")
of_sparse("c16_not_starts_with", col("priority").not_starts_with("3-"), "NOT coalesce(priority LIKE '3-%', false)")
of_sparse("c17_contains", col("priority").contains("IG"), "coalesce(contains(priority, 'IG'), false)")
of_sparse("c18_not_contains", col("priority").not_contains("IG"), "NOT coalesce(contains(priority, 'IG'), false)")
of_sparse("c19_contains_ignore_case", col("priority").contains_ignore_case("uRg"), "coalesce(contains(lower(priority), 'urg'), false)")
of_sparse("c20_not_contains_ignore_case", col("priority").not_contains_ignore_case("uRg"), "NOT coalesce(contains(lower(priority), 'urg'), false)")
of_sparse("c21_like", col("priority").like("5-low"), "coalesce(lower(priority) = '5-low', false)")
of_sparse("c22_not_like", col("priority").not_like("5-low"), "NOT coalesce(lower(priority) = '5-low', false)")
of_sparse("c23_matches", col("priority").matches("[12]-.*H.*"), "coalesce(regexp_full_match(priority, '[12]-.*H.*'), false)")
of_sparse("c24_not_matches", col("priority").not_matches("[12]-.*H.*"), "NOT coalesce(regexp_full_match(priority, '[12]-.*H.*'), false)")
add("c25_and_or_fold", lambda d: d.select("o_orderkey").from_("sparse").where(col("status").eq("F")).and_(col("price").gt(400000.0)).or_(col("bucket").eq(9)).and_(col("priority").neq("1-URGENT")), f"WITH {SPARSE} SELECT o_orderkey FROM sparse WHERE ((status = 'F' AND coalesce(price > 400000, false)) OR coalesce(bucket = 9, false)) AND priority IS DISTINCT FROM '1-URGENT'")
of_sparse("c26_not_compound", ~(col("price").lt(250000.0) | col("bucket").is_in([2, 3])), "NOT ((price IS NULL OR price < 250000) OR coalesce(bucket IN (2, 3), false))")
of_sparse("c26_not_leaf", ~col("price").lt(250000.0), "coalesce(price >= 250000, false)")
add("c27_rel_any_match", lambda d: d.select("n_nationkey", "n_name").from_("nation").where(col("suppliers.s_acctbal").gt(9000.0) | col("region.r_name").eq("ASIA")), "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) OR n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
add("c28_rel_identity_subquery", lambda d: d.select("o_orderkey").from_("orders").where(col("customer").is_in(d.select("c_custkey").from_("customer").where(col("c_mktsegment").eq("FURNITURE")))), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
add("c29_nested_path", lambda d: d.select("event_id", "props.k").from_("events").where(col("props.k").gt(90)), "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90", "event_id", "k")
add("c30_struct_identifiers", lambda d: _with_struct(d).select("o_orderkey").from_("boxed").where(col("owner").is_in([5, 6, 7])), "SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 6, 7)")
add("c32_partition", lambda d: d.select("doc_id", "n_chars").from_("documents").in_partition("fr").where(col("n_chars").gt(3000)), "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 3000")
add("c33_match_all", lambda d: d.select("p_partkey").from_("part"), "SELECT p_partkey FROM part")


def _with_struct(d: Database) -> Database:
    from heliograph.schema import EntitySchema

    df = d.catalog.table("orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("state")).alias("owner"))
    d.catalog.add(EntitySchema.of("boxed", df.schema, "o_orderkey"), df)
    return d


# ---- projection and relationships ------------------------------------------------------------------------

add("p01_entity", lambda d: d.from_("nation"), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("p02_project", lambda d: d.select("o_orderkey", "o_orderpriority").from_("orders"), "SELECT o_orderkey, o_orderpriority FROM orders")
add("p03_wildcard", lambda d: d.select("upper(p_name)", "*").from_("part").where(col("p_size").lt(5)), "SELECT upper(p_name) AS name_upper, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size < 5", "name_upper", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
add("p05_to_one_select", lambda d: d.select("o_orderkey", "customer.c_name", "customer.nation.region.r_name").from_("orders"), "SELECT o_orderkey, c_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey", "o_orderkey", "c_name", "r_name")
add("p06_to_many_list", lambda d: d.select("r_regionkey", "nations.n_name").from_("region").df().select("r_regionkey", F.array_join(F.array_sort("`nations.n_name`"), "|").alias("names")), "SELECT r_regionkey, coalesce(string_agg(n_name, '|' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
add("p06_to_many_empty", lambda d: d.select("s_suppkey", "parts.p_size").from_("supplier").df().select("s_suppkey", F.size("`parts.p_size`").cast("long").alias("n"), F.aggregate("`parts.p_size`", F.lit(0), lambda a, x: a + x).cast("long").alias("total")), "SELECT s_suppkey, count(p_partkey) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
add("p07_struct_hydrate", lambda d: d.select("n_nationkey", "region").from_("nation").df().select("n_nationkey", F.col("region.r_regionkey").alias("r_key"), F.col("region.r_name").alias("r_name")), "SELECT n_nationkey, r_regionkey AS r_key, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
add("p08_multi_level", lambda d: d.select("r_regionkey", "nations.suppliers.s_suppkey").from_("region").df().select("r_regionkey", F.array_join(F.transform(F.array_sort("`nations.suppliers.s_suppkey`"), lambda x: x.cast("string")), ",").alias("ids")), "SELECT r_regionkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS ids FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("p09_json_path", lambda d: d.select("event_id", "props.k").from_("events"), "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events", "event_id", "k")
add("p10_list_index", lambda d: d.select("r_regionkey", "nations.0.n_name").from_("region"), "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 1) AS first_name FROM region", "r_regionkey", "first_name")
add("p10_list_any", lambda d: d.select("c_custkey").from_("customer").where(col("orders.any.o_orderstatus").eq("F") & col("orders.any.o_totalprice").gt(490000.0)), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
add("p11_computed", lambda d: d.select("is_large", "count(o_orderkey)").from_("orders").group_by("is_large"), "SELECT o_totalprice > 250000 AS is_large, count(*) AS n FROM orders GROUP BY 1", "is_large", "n")
add("p12_eager", lambda d: _eager(d).from_("nation_eager").df().select("n_nationkey", F.col("region.r_name").alias("r_name")), "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
add("p14_resolvers", lambda d: d.from_("nation").resolve("suppliers").df().select("n_nationkey", F.size("suppliers").cast("long").alias("n")), "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("p15_values", lambda d: d.select("o_orderkey", "bucket").from_("sparse").values("bucket"), f"WITH {SPARSE} SELECT bucket FROM sparse WHERE bucket IS NOT NULL")


def _eager(d: Database) -> Database:
    from heliograph.schema import EntitySchema, Relationship

    df = d.catalog.table("nation")
    d.catalog.add(EntitySchema.of("nation_eager", df.schema, "n_nationkey", relationships=(Relationship("region", "MANY_TO_ONE", "region", "n_regionkey", "r_regionkey", fetch="EAGER"),)), df)
    return d


add("j01_semi_join", lambda d: d.select("o_orderkey").from_("orders").where(col("items.l_quantity").gt(49.0)), "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
add("j02_childless_or_null", lambda d: d.select("doc_id").from_("documents").where(col("label.quality").is_null()), "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NULL)")
add("j02_any_child_differs", lambda d: d.select("c_custkey").from_("customer").where(~col("orders.o_orderstatus").eq("F")), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
add("j07_many_to_many", lambda d: d.select("s_suppkey").from_("supplier").where(col("parts.p_size").eq(50) & col("parts.p_name").contains("red")), "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size = 50) AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND contains(p_name, 'red'))")
add("j08_recursive_path", lambda d: d.select("n_nationkey", "region.nations.n_name").from_("nation").df().select("n_nationkey", F.size("`region.nations.n_name`").cast("long").alias("siblings")), "SELECT n.n_nationkey, count(*) AS siblings FROM nation n JOIN nation m ON m.n_regionkey = n.n_regionkey GROUP BY 1")
add("j09_group_by_path", lambda d: d.select("customer.c_mktsegment", "count(o_orderkey)").from_("orders").group_by("customer.c_mktsegment").order_by("customer.c_mktsegment"), "SELECT c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1", "c_mktsegment", "n")

# ---- aggregates ------------------------------------------------------------------------------------------


def rounded(made: b.Builder, *places: int | None) -> DataFrame:
    df = made.df()
    return df.select(*[F.round(f"`{c}`", p).alias(c) if p is not None else F.col(f"`{c}`") for c, p in zip(df.columns, places, strict=True)])


def of_groups(key: str, function: str, sql: str, places: int = 4) -> None:
    add(key, lambda d: rounded(d.select("status", function).from_("sparse").group_by("status"), None, places), f"WITH {SPARSE} SELECT status, round({sql}, {places}) AS v FROM sparse GROUP BY 1", "status", "v")


of_groups("a01_sum", "sum(price)", "sum(price)", 2)
of_groups("a02_avg", "avg(price)", "avg(coalesce(price, 0))")
add("a02_avg_whole_number", lambda d: d.select("status", "avg(bucket)").from_("sparse").group_by("status"), f"WITH {SPARSE} SELECT status, CAST(trunc(avg(coalesce(bucket, 0))) AS BIGINT) AS v FROM sparse GROUP BY 1", "status", "v")
add("a03_count", lambda d: d.select("status", "count(price)").from_("sparse").group_by("status"), f"WITH {SPARSE} SELECT status, count(*) AS n FROM sparse GROUP BY 1", "status", "n")
add("a03_count_distinct", lambda d: d.select("status", "count(bucket)").from_("sparse").group_by("status").distinct(), f"WITH {SPARSE} SELECT status, count(DISTINCT bucket) + max(CAST(bucket IS NULL AS BIGINT)) AS n FROM sparse GROUP BY 1", "status", "n")
add("a04_min", lambda d: d.select("o_custkey", "min(price)").from_("sparse").group_by("o_custkey"), f"WITH {SPARSE} SELECT o_custkey, CASE WHEN count(*) = count(price) THEN min(price) END AS v FROM sparse GROUP BY 1", "o_custkey", "v")
of_groups("a05_max", "max(price)", "max(price)")
of_groups("a06_std", "std(price)", "stddev_pop(coalesce(price, 0))")
add("a07_variance", lambda d: rounded(d.select("status", "variance(bucket)").from_("sparse").group_by("status"), None, 4), f"WITH {SPARSE} SELECT status, round(var_pop(coalesce(bucket, 0)), 4) AS v FROM sparse GROUP BY 1", "status", "v")
of_groups("a08_median", "median(price)", "quantile_cont(price, 0.5)")
of_groups("a09_percentile", "percentile(price, 20)", "quantile_cont(price, 0.2)")
add("a10_flat", lambda d: rounded(d.select("sum(o_totalprice)", "max(o_totalprice)", "count(o_orderkey)").from_("orders"), 2, 2, None), "SELECT round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS most, count(*) AS n FROM orders", "total", "most", "n")
add("a11_argmax", lambda d: d.select("max(o_totalprice)", "o_orderkey", "o_orderpriority").from_("orders"), "SELECT o_totalprice AS most, o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1", "most", "o_orderkey", "o_orderpriority")
add("a11_argmin", lambda d: d.select("min(o_totalprice)", "o_orderkey").from_("orders"), "SELECT o_totalprice AS least, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1", "least", "o_orderkey")
add("a12_group_agg", lambda d: rounded(d.select("o_orderstatus", "o_orderpriority", "sum(o_totalprice)", "count(o_orderkey)").from_("orders").where(col("o_totalprice").gt(1000.0)).group_by("o_orderstatus", "o_orderpriority"), None, None, 2, None), "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2", "o_orderstatus", "o_orderpriority", "total", "n")
add("a12_bare_column", lambda d: d.select("o_custkey", "bucket", "count(o_orderkey)").from_("sparse").group_by("o_custkey"), f"WITH {SPARSE} SELECT o_custkey, arg_min(bucket, o_orderkey) FILTER (WHERE bucket IS NOT NULL) AS bucket, count(*) AS n FROM sparse GROUP BY 1", "o_custkey", "bucket", "n")
add("a13_group_first", lambda d: d.select("o_custkey", "o_orderkey", "o_orderstatus").from_("orders").group_by("o_custkey"), "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
add("a14_group_by_func", lambda d: d.select("substring(o_orderpriority, 0, 1)", "count(o_orderkey)").from_("orders").group_by("substring(o_orderpriority, 0, 1)"), "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1", "p", "n")
add("a14_group_by_format", lambda d: d.select("format(o_orderdate, 'yyyy-MM')", "count(o_orderkey)").from_("orders").group_by("format(o_orderdate, 'yyyy-MM')"), "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1", "m", "n")
add("a15_order_by_agg", lambda d: rounded(d.select("o_custkey", "sum(o_totalprice)").from_("orders").group_by("o_custkey").order_by(desc("sum(o_totalprice)"), asc("o_custkey")).limit(10), None, 2), "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10", "o_custkey", "total")
add("a15_order_by_unselected_agg", lambda d: d.select("o_custkey").from_("orders").group_by("o_custkey").order_by(desc("count(o_orderkey)"), asc("o_custkey")).limit(10), "SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
add("a16_null_group", lambda d: d.select("bucket", "count(o_orderkey)").from_("sparse").group_by("bucket"), f"WITH {SPARSE} SELECT bucket, count(*) AS n FROM sparse GROUP BY 1", "bucket", "n")
add("a17_distinct", lambda d: d.select("o_orderstatus", "o_orderpriority").from_("orders").distinct().order_by("o_orderstatus"), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("a18_count", lambda d: _one(d, n=d.from_("orders").where(col("o_orderstatus").eq("O")).count()), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
add("a19_results_count", lambda d: _one(d, n=d.from_("orders").where(col("o_totalprice").gt(300000.0)).limit(10).count()), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000")
add("a20_client_reduce", lambda d: (lambda r: _one(d, most=r["max"], least=r["min"], total=round(r["sum"], 2), n=r["n"]))(results.reduction(d.select("o_totalprice").from_("orders").df(), "o_totalprice")), "SELECT max(o_totalprice) AS most, min(o_totalprice) AS least, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")

# ---- order, paging, set operations -----------------------------------------------------------------------

add("o01_order_multi", lambda d: d.select("o_orderkey", "bucket", "price").from_("sparse").order_by(asc("bucket"), desc("price"), asc("o_orderkey")).limit(50), f"WITH {SPARSE} SELECT o_orderkey, bucket, price FROM sparse ORDER BY bucket ASC NULLS FIRST, price DESC NULLS LAST, o_orderkey LIMIT 50")
add("o01_order_desc_nulls_last", lambda d: d.select("o_orderkey", "price").from_("sparse").order_by(desc("price"), asc("o_orderkey")).offset(12840).limit(40), f"WITH {SPARSE} SELECT o_orderkey, price FROM sparse ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 12840")
add("o02_order_by_path", lambda d: d.select("o_orderkey").from_("orders").order_by(desc("customer.c_acctbal"), asc("o_orderkey")).limit(30), "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal DESC, o_orderkey LIMIT 30")
add("o03_order_unselected", lambda d: d.select("o_orderstatus").from_("orders").order_by(desc("o_totalprice"), asc("o_orderkey")).limit(25), "SELECT o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("o04_limit", lambda d: d.select("o_orderkey").from_("orders").order_by("o_orderkey").limit(7), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7")
add("o05_top_k", lambda d: d.select("o_orderkey", "o_totalprice").from_("orders").order_by(desc("o_totalprice"), asc("o_orderkey")).limit(10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
add("o06_offset", lambda d: d.select("o_orderkey").from_("orders").order_by("o_orderkey").offset(100).limit(20), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20 OFFSET 100")
add("o07_first", lambda d: d.select("o_orderkey", "o_orderstatus").from_("orders").order_by(desc("o_orderkey")).limit(1), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY 1 DESC LIMIT 1")


def _second_page(d: Database) -> DataFrame:
    from heliograph.results import after

    df = d.select("o_orderkey", "bucket").from_("sparse").df()
    keys = [("bucket", True), ("o_orderkey", True)]
    return after(df, keys, [3, 400]).orderBy(F.col("bucket").asc_nulls_first(), "o_orderkey").limit(25)


add("o08_keyset_page", _second_page, f"WITH {SPARSE} SELECT o_orderkey, bucket FROM sparse WHERE bucket > 3 OR (bucket = 3 AND o_orderkey > 400) ORDER BY bucket NULLS FIRST, o_orderkey LIMIT 25")
add("u01_union", lambda d: d.select("o_orderkey").from_("orders").where(col("o_totalprice").gt(490000.0)).or_(col("o_orderpriority").eq("1-URGENT")), "SELECT o_orderkey FROM orders WHERE o_totalprice > 490000 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
add("u02_intersect", lambda d: d.select("o_orderkey").from_("orders").where(col("o_totalprice").gt(250000.0)).and_(col("o_orderpriority").eq("1-URGENT")), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
add("u03_complement", lambda d: d.select("o_orderkey").from_("orders").where(~(col("o_totalprice").gt(250000.0) | col("o_orderpriority").eq("1-URGENT"))), "SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 OR o_orderpriority = '1-URGENT'")
add("u04_not_between", lambda d: d.select("o_orderkey").from_("orders").where(col("o_totalprice").not_between(5000.0, 495000.0)), "SELECT o_orderkey FROM orders WHERE o_totalprice < 5000 OR o_totalprice > 495000")

# ---- scalar functions ------------------------------------------------------------------------------------

add("x01_upper", lambda d: d.select("p_partkey", "upper(p_name)").from_("part"), "SELECT p_partkey, upper(p_name) AS v FROM part", "p_partkey", "v")
add("x02_lower", lambda d: d.select("c_custkey", "lower(c_mktsegment)").from_("customer"), "SELECT c_custkey, lower(c_mktsegment) AS v FROM customer", "c_custkey", "v")
add("x03_replace", lambda d: d.select("c_custkey", "replace(c_name, '[0-9]+', '#')").from_("customer"), "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS v FROM customer", "c_custkey", "v")
add("x04_substring", lambda d: d.select("o_orderkey", "substring(o_orderpriority, 2, 6)").from_("orders"), "SELECT o_orderkey, substring(o_orderpriority, 3, 4) AS v FROM orders", "o_orderkey", "v")
add("x05_format_number", lambda d: d.select("c_custkey", "format(c_acctbal, '#.##')").from_("customer"), "SELECT c_custkey, printf('%.2f', c_acctbal) AS v FROM customer", "c_custkey", "v")
add("x06_format_date", lambda d: d.select("o_orderkey", "format(o_orderdate, 'yyyy/MM/dd')").from_("orders"), "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS v FROM orders", "o_orderkey", "v")
add("x07_format_other", lambda d: d.select("o_orderkey", "format(priority)").from_("sparse"), f"WITH {SPARSE} SELECT o_orderkey, coalesce(priority, '') AS v FROM sparse", "o_orderkey", "v")

# ---- search ----------------------------------------------------------------------------------------------

PROBE = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_COSINE = f"list_sum(list_transform(list_zip(embedding, {PROBE}::DOUBLE[]), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / {sum(x * x for x in PROBE) ** 0.5!r}"
add("v01_knn_exact", lambda d: d.select("vec_id", "__score__").from_("embeddings").where(col("embedding").like(PROBE)).limit(10).df().select("vec_id", F.round("__score__", 6)), f"SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 10", "vec_id", "score")
_UNIT = [x / sum(y * y for y in PROBE) ** 0.5 for x in PROBE]
_WHOLE = [int(u * 127 + (0.5 if u >= 0 else -0.5)) for u in _UNIT]
add("v03_knn_int8", lambda d: vector.nearest(d.catalog.table("embeddings"), "embedding", PROBE, 10, "vec_id", quantization="INT8").select("vec_id", F.round("__score__", 6)), f"""
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / len * 127)), {_WHOLE}), lambda p: p[1] * p[2])) / 16129.0 AS s FROM n)
SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10""", "vec_id", "score")
add("v04_find_all", lambda d: d.select("vec_id").from_("embeddings").where(col("embedding").eq(PROBE)), f"SELECT vec_id FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 50")
add("v05_knn_post_filter", lambda d: d.select("vec_id", "label").from_("embeddings").where(col("embedding").like(PROBE)).and_(col("label").lt(4)).limit(20), f"SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 20) WHERE label < 4")
add("s11_knn_each_partition", lambda d: vector.nearest_each(d.catalog.table("embeddings"), "embedding", PROBE, 3, "vec_id", "label").select("label", "vec_id"), f"SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_COSINE} DESC, vec_id) <= 3")


def bm25_sql(words: list[str], source: str, key: str, text: str, condition: str = "true") -> str:
    """CTE s(key, score) of the rows of source that hold any of the words."""
    values = ", ".join(f"('{w}')" for w in words)
    return f"""t AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {source}),
stat AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
q(term) AS (VALUES {values}),
tf AS (SELECT k, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS f FROM t, q),
df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS d FROM tf GROUP BY term),
s AS (SELECT k, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
      FROM tf JOIN df USING (term), stat WHERE f > 0 AND {condition} GROUP BY k)"""


WORDS = ["thing", "erthe", "pour"]
add("f01_bm25_topk", lambda d: fulltext.search(d.catalog.table("documents"), F.col("text"), " ".join(WORDS)).select("doc_id", F.round("__score__", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20), f"WITH {bm25_sql(WORDS, 'documents', 'doc_id', 'text')} SELECT k AS doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, k LIMIT 20")
add("f02_fulltext_and_attr", lambda d: d.select("doc_id", "__score__").from_("documents").where(col("text").like("pour dans")).and_(col("n_chars").lt(2000)).df().select("doc_id", F.round("__score__", 6)), f"WITH {bm25_sql(['pour', 'dans'], 'documents', 'doc_id', 'text')} SELECT k AS doc_id, round(score, 6) AS score FROM s JOIN documents ON doc_id = k WHERE n_chars < 2000", "doc_id", "score")
add("f01_record_search", lambda d: d.select("item_id").from_("benchmark").where(search("the AND and -la")), "WITH t AS (SELECT item_id, regexp_extract_all(lower(concat_ws(' ', item_id, text)), '[\\p{L}\\p{N}_]+') AS w FROM benchmark) SELECT item_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND NOT list_contains(w, 'la')")
add("f03_phrase_or_prefix", lambda d: d.select("doc_id").from_("documents").where(search('"of the" OR elles*', attribute="text")), "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT doc_id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') OR len(list_filter(w, lambda x: starts_with(x, 'elles'))) > 0")
add("f04_min_score", lambda d: d.select("doc_id").from_("documents").where(search("pour dans", 0.9, "text")), f"WITH {bm25_sql(['pour', 'dans'], 'documents', 'doc_id', 'text')} SELECT k AS doc_id FROM s WHERE score >= 0.9")
add("f02_fulltext_or_attr", lambda d: d.select("doc_id").from_("documents").where(search("erthe", None, "text") | col("n_chars").gt(9000)), "WITH t AS (SELECT doc_id, n_chars, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'erthe') OR n_chars > 9000")
add("f05_partition_statistics", lambda d: fulltext.search(d.catalog.table("documents"), F.col("text"), "pour", partition="lang").select("doc_id", F.round("__score__", 6).alias("score")), """WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
f AS (SELECT doc_id, lang, len(w) AS dl, len(list_filter(w, lambda x: x = 'pour')) AS f FROM t),
st AS (SELECT lang, count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE f > 0) AS d FROM f GROUP BY lang)
SELECT doc_id, round(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM f JOIN st USING (lang) WHERE f > 0""")
add("f06_search_all", lambda d: fulltext.search_all({n: (d.catalog.table(n), d.catalog.schema(n).identifier) for n in DECLARED if n != "sparse"}, "nation_7 thing 3").select("entity", "id"), None)

_SEARCHABLE = {"documents": ("doc_id", "concat_ws(' ', doc_id, text, lang, source, n_chars)"), "pages": ("page_id", "concat_ws(' ', page_id, url, html)"), "benchmark": ("item_id", "concat_ws(' ', item_id, text)")}
_HITS = " UNION ALL ".join(f"SELECT * FROM (WITH {bm25_sql(['thing'], n, k, t)} SELECT '{n}' AS entity, CAST(k AS VARCHAR) AS id, score FROM s)" for n, (k, t) in _SEARCHABLE.items())
add("f06_search_searchable", lambda d: fulltext.search_all({n: (d.catalog.table(n), k) for n, (k, _) in _SEARCHABLE.items()}, "thing").select("entity", "id", F.round("score", 6).alias("score")), f"SELECT entity, id, round(score, 6) AS score FROM ({_HITS}) ORDER BY round(score, 9) DESC, entity, id LIMIT 100")

# ---- changes ---------------------------------------------------------------------------------------------

add("d01_update_result", lambda d: dml.updated(d.planner, Query("orders", criteria=col("o_totalprice").gt(450000.0) & col("customer.c_mktsegment").eq("BUILDING"), updates={"o_orderstatus": "X"}))[0].select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, CASE WHEN o_totalprice > 450000 AND c_mktsegment = 'BUILDING' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
add("d01_update_count", lambda d: dml.updated(d.planner, Query("orders", criteria=col("o_orderstatus").eq("P"), updates={"o_orderpriority": None}))[1], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
add("d02_move_partition", lambda d: dml.updated(d.planner, Query("customer", criteria=col("c_acctbal").lt(0.0), updates={"c_mktsegment": "CLOSED"}))[0].groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT CASE WHEN c_acctbal < 0 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
add("d03_delete_result", lambda d: dml.deleted(d.planner, Query("sparse", criteria=col("price").lt(200000.0)))[0].select("o_orderkey"), f"WITH {SPARSE} SELECT o_orderkey FROM sparse WHERE NOT (price IS NULL OR price < 200000)")
add("d04_delete_top", lambda d: dml.deleted(d.planner, Query("orders", criteria=col("o_orderstatus").eq("F"), order_by=(desc("o_totalprice"),), limit=100))[0].select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
add("d05_delete_subquery", lambda d: dml.deleted(d.planner, Query("orders", criteria=col("o_custkey").is_in(d.select("c_custkey").from_("customer").where(col("c_acctbal").lt(0.0)))))[0].select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


def _sequence(d: Database) -> DataFrame:
    schema = d.catalog.schema("orders").with_(generator="SEQUENCE", computed={})
    table = d.catalog.table("orders")
    rows = table.withColumn("o_orderkey", F.lit(None).cast("long"))
    return dml.with_identifiers(table, rows, schema).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count_distinct("o_orderkey").alias("n"))


add("d06_sequence", _sequence, "SELECT max(o_orderkey) + 1 AS first, max(o_orderkey) + count(*) AS last, count(*) AS n FROM orders")


def _upsert(d: Database) -> DataFrame:
    table = d.catalog.table("nation")
    rows = table.filter(F.col("n_nationkey") < 5).withColumn("n_name", F.upper(F.concat(F.lit("new "), "n_name"))).unionByName(table.filter(F.col("n_nationkey") == 7).withColumn("n_nationkey", F.lit(100)))
    return dml.upsert(table, rows, d.catalog.schema("nation"))


add("k07_upsert", _upsert, "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper('new ' || n_name) ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
add("k08_delete_entities", lambda d: dml.without(d.catalog.table("orders"), d.catalog.table("orders").filter(F.col("o_orderkey") % 3 == 0), "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
add("k09_find_by_id", lambda d: d.from_("customer").where(col("c_custkey").eq(42)).limit(1), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42")


def _changes(d: Database) -> DataFrame:
    """Events as a change log: each user's events in order of number, the fifth kind a delete."""
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE")
    return d.catalog.table("events").select(F.col("event_id").alias("seq"), "user_id", "value", op.alias("op"))


_CHANGES = "c AS (SELECT event_id AS seq, user_id, value, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op FROM events)"
add("k15_journal_replay", lambda d: latest(_changes(d), "user_id").filter(F.col("op") != "DELETE").select("user_id", "seq", "value"), f"WITH {_CHANGES} SELECT user_id, seq, value FROM c WHERE true QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1 AND op <> 'DELETE'")
_DELTAS = f"""{_CHANGES}, m AS (SELECT *, coalesce(lag(value > 50 AND op <> 'DELETE') OVER (PARTITION BY user_id ORDER BY seq), false) AS was, value > 50 AS hit FROM c),
e AS (SELECT seq, user_id, CASE WHEN op = 'DELETE' THEN CASE WHEN was OR hit THEN 'removed' END WHEN hit THEN CASE WHEN op = 'INSERT' THEN 'added' ELSE 'updated' END WHEN was AND op = 'UPDATE' THEN 'removed' END AS event FROM m)"""
add("r10_listener_deltas", lambda d: live.deltas(_changes(d), F.col("value") > 50, "user_id").select("event", "seq", "user_id"), f"WITH {_DELTAS} SELECT event, seq, user_id FROM e WHERE event IS NOT NULL")


def _snapshot(d: Database) -> DataFrame:
    table = d.catalog.table("events").filter(F.col("event_id") < 100).select(F.col("event_id").alias("user_id"), "value")
    return live.snapshot_and_deltas(table, _changes(d).filter(F.col("seq") >= 100), F.col("value") > 50, "user_id").select("event", "seq", "user_id")


add("r13_snapshot_plus_deltas", _snapshot, """WITH t AS (SELECT event_id AS user_id, value FROM events WHERE event_id < 100),
c AS (SELECT event_id AS seq, user_id, value, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op FROM events WHERE event_id >= 100),
m AS (SELECT c.*, c.value > 50 AS hit, coalesce(lag(c.value > 50 AND op <> 'DELETE') OVER (PARTITION BY c.user_id ORDER BY seq), t.value > 50, false) AS was FROM c LEFT JOIN t ON t.user_id = c.user_id),
e AS (SELECT seq, user_id, CASE WHEN op = 'DELETE' THEN CASE WHEN was OR hit THEN 'removed' END WHEN hit THEN CASE WHEN op = 'INSERT' THEN 'added' ELSE 'updated' END WHEN was AND op = 'UPDATE' THEN 'removed' END AS event FROM m)
SELECT event, seq, user_id FROM e WHERE event IS NOT NULL UNION ALL SELECT 'snapshot', 0, user_id FROM t WHERE value > 50""")


def _payload(d: Database) -> b.Builder:
    return d.payload({
        "type": "SelectQuery", "table": "orders", "fields": ["o_orderstatus", "count(o_orderkey)"], "groupBy": ["o_orderstatus"], "sort": [{"field": "o_orderstatus", "order": "DESC"}],
        "conditions": {"conditionType": "CompoundCondition", "operator": "OR", "conditions": [
            {"conditionType": "SingleCondition", "criteria": {"field": "o_totalprice", "operator": "GREATER_THAN", "value": 300000.0}},
            {"conditionType": "SingleCondition", "criteria": {"field": "o_custkey", "operator": "IN", "value": {"type": "SelectQuery", "table": "customer", "fields": ["c_custkey"], "conditions": {"conditionType": "SingleCondition", "criteria": {"field": "c_mktsegment", "operator": "EQUAL", "value": "BUILDING"}}}}},
        ]},
    })


add("k06_json_payload", _payload, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1", "o_orderstatus", "n")


# ---- the rest of the surface -----------------------------------------------------------------------------

add("g01_computed_in_condition", lambda d: d.select("o_orderkey").from_("orders").where(col("is_large").eq(True) & col("o_orderstatus").eq("P")), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'P'")
add("g04_user_processor", lambda d: results.processed(d.select("o_orderstatus", "o_totalprice").from_("orders").df(), _halved, "status string, half double"), "SELECT o_orderstatus AS status, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 400000")
add("k10_exists", lambda d: _flags(d, here=d.exists("orders", 77), gone=d.exists("orders", -1)), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 77) AS here, false AS gone")
add("k12_replace_links", lambda d: dml.linked(d.catalog.table("lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", 3, [1, 2, 2]), "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey <> 3 UNION ALL VALUES (3, 1), (3, 2)")
add("k19_truncate_partition", lambda d: dml.deleted(d.planner, Query("customer", partition="BUILDING"))[0].select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
add("o09_max_cardinality", lambda d: _one(d, few=_stopped(d, 24), enough=_stopped(d, 25)), "SELECT count(*) > 24 AS few, count(*) > 25 AS enough FROM nation")
add("p13_hydrate_many", lambda d: d.related("customer", 42, "orders").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey = 42")
add("p13_hydrate_linked", lambda d: d.related("supplier", 3, "parts").select("p_partkey"), "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_suppkey = 3")
add("p13_hydrate_map", lambda d: (lambda m: _one(d, c_custkey=m["c_custkey"], nation=m["nation"]["n_name"], orders=len(m["orders"])))(d.hydrated("customer", 42)), "SELECT c_custkey, n_name AS nation, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 42")
add("k11_map_of_row", lambda d: (lambda m: _one(d, **m))(d.map_of("nation", 7)), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
add("r04_sequence_iter", lambda d: _taken(d, 60), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 60")
add("r08_cached", lambda d: _hit(d.select("o_orderstatus", "count(o_orderkey)").from_("orders").group_by("o_orderstatus").cache()), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", "o_orderstatus", "n")
add("x08_cast_or_zero", lambda d: d.select("p_partkey", "p_brand").from_("part").df().select("p_partkey", cast_or_zero(F.substring("p_brand", 7, 9), T.IntegerType(), False).alias("number"), cast_or_zero(F.col("p_brand"), T.IntegerType(), False).alias("zero")), "SELECT p_partkey, CAST(substring(p_brand, 7) AS INTEGER) AS number, 0 AS zero FROM part")
add("x09_parse_dates", lambda d: d.select("o_orderkey", "format(o_orderdate, 'MM/dd/yyyy')").from_("orders").df().toDF("o_orderkey", "s").select("o_orderkey", F.date_format(parsed_date(F.col("s")), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")


# ---- writes, in a warehouse of its own ---------------------------------------------------------------------


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the one that the session names for shared files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _store(d: Database, names: tuple[str, ...], journal: bool = False, **changes: dict) -> Warehouse:
    """A new warehouse with these tables."""
    spark = d.catalog.table(names[0]).sparkSession
    store = Warehouse(spark, _folder(spark, "store"), journal)
    for name in names:
        schema = d.catalog.schema(name)
        store.declare(schema.with_(computed={}, **changes.get(name, {})))
        store.save(name, d.catalog.table(name))
    return store


def _cascading(d: Database, name: str, *below: str) -> dict:
    return {"relationships": tuple(replace(r, cascade="ALL") for r in d.catalog.schema(name).relationships if r.name in below)}


def _cascade_delete(d: Database) -> DataFrame:
    store = _store(d, ("region", "nation", "customer", "supplier"), region=_cascading(d, "region", "nations"), nation=_cascading(d, "nation", "customers", "suppliers"))
    store.remove_with("region", [2])
    left = [store.read(n).select(F.lit(n).alias("entity"), F.col(store.catalog.schema(n).identifier).cast("long").alias("id")) for n in ("region", "nation", "customer", "supplier")]
    return left[0].unionByName(left[1]).unionByName(left[2]).unionByName(left[3])


add("d07_cascade_delete", _cascade_delete, """WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2)
SELECT 'region' AS entity, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'nation', n_nationkey FROM n
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)""")


def _cascade_string(d: Database) -> DataFrame:
    """Nations saved below new regions by an instruction: those without a region get their parent's key."""
    store = _store(d, ("region", "nation"))
    regions = d.catalog.table("region").withColumn("r_regionkey", F.col("r_regionkey") + 10)
    nations = d.catalog.table("nation").select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name", F.lit(None).cast("int").alias("n_regionkey"), (F.col("n_regionkey") + 10).alias("_parent"))
    store.save_cascading("region", regions, {"nations": nations}, "nations:nation(n_regionkey, r_regionkey)")
    return store.read("nation").select("n_nationkey", "n_regionkey")


def _cascade_string_delete(d: Database) -> DataFrame:
    store = _store(d, ("region", "nation"))
    store.remove_cascading("region", [1, 3], "nations:nation(n_regionkey, r_regionkey)")
    return store.read("nation").select("n_nationkey").unionByName(store.read("region").select((F.col("r_regionkey") - 100).alias("n_nationkey")))


add("d08_cascade_string_delete", _cascade_string_delete, "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3) UNION ALL SELECT r_regionkey - 100 FROM region WHERE r_regionkey NOT IN (1, 3)")
add("d08_cascade_string", _cascade_string, "SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_regionkey + 10 FROM nation")


def _relate(d: Database) -> DataFrame:
    store = _store(d, ("region", "nation"))
    store.relate("region", "nations", 0, [1, 2, 3])
    return store.read("nation").select("n_nationkey", "n_regionkey")


add("d09_inverse_relationship", _relate, "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2, 3) THEN 0 WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")


def _hooks(d: Database) -> DataFrame:
    """Callbacks tell inserted from updated rows."""
    put = lambda text: lambda rows: rows.withColumn("n_name", F.concat(F.lit(text), "n_name"))
    store = _store(d, ("nation",))
    store.declare(store.catalog.schema("nation").with_(before_insert=(put("new "),), before_update=(put("old "),)))
    table = d.catalog.table("nation")
    store.save("nation", table.filter(F.col("n_nationkey") < 9).unionByName(table.withColumn("n_nationkey", F.col("n_nationkey") + 100)))
    return store.read("nation").select("n_nationkey", "n_name")


add("g02_callbacks", _hooks, "SELECT n_nationkey, CASE WHEN n_nationkey < 9 THEN 'old ' || n_name ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'new ' || n_name FROM nation")


def _recovered(d: Database) -> DataFrame:
    """A journaled table after updates, deletes, the loss of its rows and a replay."""
    store = _store(d, ("customer",), journal=True)
    store.update(Query("customer", criteria=col("c_acctbal").lt(0.0), updates={"c_name": "in debt"}))
    store.delete(Query("customer", criteria=col("c_acctbal").gt(9000.0)))
    store._write(store.catalog.schema("customer"), store.read("customer").limit(0))
    store.recover(store.journal)
    return store.read("customer").select("c_custkey", "c_name")


add("k14_journal_recover", _recovered, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_name END AS c_name FROM customer WHERE c_acctbal <= 9000")


def _cloned(d: Database) -> DataFrame:
    store = _store(d, ("customer",))
    other = Warehouse(store.spark, f"{store.root}-clone")
    store.clone_to(other)
    if store.checksums() != other.checksums():
        raise AssertionError("a clone differs")
    return other.read("customer")


add("k13_clone_verify", _cloned, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")


def _batches(d: Database) -> DataFrame:
    """Rows saved in batches; of those that repeat an identifier the last one counts."""
    store = _store(d, ("region",))
    table = d.catalog.table("nation")
    store.declare(d.catalog.schema("nation"))
    store.save_in_batches("nation", table, 10)
    store.save("nation", [{"n_nationkey": 3, "n_name": n, "n_regionkey": 1} for n in ("first", "second", "last")])
    return store.read("nation").select("n_nationkey", "n_name")


add("k16_batches_last_wins", _batches, "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'last' ELSE n_name END AS n_name FROM nation")


def _evolved(d: Database) -> DataFrame:
    store = _store(d, ("nation",))
    schema = store.catalog.schema("nation")
    store.declare(schema.with_(attributes=(*schema.attributes, Attribute("extra", T.StringType()))))
    return store.read("nation").select("n_nationkey", "extra", F.lit(len(store.history("nation"))).cast("long").alias("revisions"))


add("k18_schema_revisions", _evolved, "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS extra, 2 AS revisions FROM nation")


def _maintained(d: Database) -> DataFrame:
    """A cached result after a write to its table."""
    store = _store(d, ("nation",))
    query = store.select("n_regionkey", "count(n_nationkey)").from_("nation").group_by("n_regionkey").cache()
    _hit(query).collect()
    store.delete(Query("nation", criteria=col("n_nationkey").lt(10)))
    return query.df()


add("r09_cache_after_write", _maintained, "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 10 GROUP BY 1", "n_regionkey", "n")


def _indexed(d: Database, query: str) -> DataFrame:
    table = d.catalog.table("documents")
    index = TextIndex(table.sparkSession, _folder(table.sparkSession, "postings")).build(table, "doc_id", F.col("text"))
    return index.search(query).select(F.col("key").alias("doc_id"), F.round("__score__", 6).alias("score"))


add("f01_postings", lambda d: _indexed(d, " ".join(WORDS)), f"WITH {bm25_sql(WORDS, 'documents', 'doc_id', 'text')} SELECT k AS doc_id, round(score, 6) AS score FROM s")


def _recall(d: Database) -> DataFrame:
    """Whether the index finds nine of ten of the ten nearest of every 50th vector."""
    table = d.catalog.table("embeddings")
    index = VectorIndex(table.sparkSession, _folder(table.sparkSession, "cells")).build(table, "vec_id", "embedding")
    found = wanted = 0
    for row in table.filter(F.col("vec_id") % 50 == 0).orderBy("vec_id").limit(8).collect():  # a measure of the index, not a result
        exact = {r.vec_id for r in vector.nearest(table, "embedding", row.embedding, 10, "vec_id").collect()}
        found, wanted = found + len(exact & {r.key for r in index.search(row.embedding, 10).collect()}), wanted + len(exact)
    indexed = table.sparkSession.read.parquet(f"{index.path}/cells").count()
    return _one(d, reached=found >= 0.9 * wanted, n=indexed)


add("v02_vector_index", _recall, "SELECT true AS reached, count(*) AS n FROM embeddings")


# ---- ways of consuming --------------------------------------------------------------------------------------


def _streamed(d: Database) -> DataFrame:
    """Keys that a callback saw until it stopped the stream."""
    seen = []
    results.for_each(d.select("o_orderkey").from_("orders").order_by(desc("o_orderkey")).df(), lambda row: seen.append((row.o_orderkey,)) or len(seen) < 75)
    return d.catalog.table("orders").sparkSession.createDataFrame(seen, "o_orderkey long")


def _mapped(d: Database) -> DataFrame:
    seen = []
    results.for_each_map(d.select("n_nationkey", "region").from_("nation").df(), lambda m: seen.append((m["n_nationkey"], m["region"]["r_name"])))
    return d.catalog.table("nation").sparkSession.createDataFrame(seen, "n_nationkey long, region string")


def _columns(d: Database, pages: list[tuple], schema: str) -> DataFrame:
    """Pages, each as Arrow columns, back as a table: the driver holds a few bytes a value, not an object."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.float64() for c in schema.split(", ")]
    whole = pa.table([pa.chunked_array(x, kind) for x, kind in zip(zip(*pages, strict=True), kinds, strict=True)] if pages else [pa.array([], kind) for kind in kinds], names)
    return d.catalog.table("customer").sparkSession.createDataFrame(whole.combine_chunks(), schema)


def _parallel_pages(d: Database) -> DataFrame:
    import pyarrow as pa

    found = []
    results.for_each_page(d.planner, Query("customer", selections=("c_custkey",), page_size=300), lambda rows: found.append((pa.array([r.c_custkey for r in rows], pa.int64()),)))
    return _columns(d, found, "c_custkey long")


def _in_parallel(d: Database) -> DataFrame:
    total = d.catalog.table("orders").sparkSession.sparkContext.accumulator(0)
    results.for_each_parallel(d.select("o_orderkey").from_("orders").df(), lambda row: total.add(row.o_orderkey))
    return _one(d, total=total.value)


def _all_pages(d: Database) -> DataFrame:
    import pyarrow as pa

    query = Query("customer", selections=("c_custkey", "c_acctbal"), order_by=(Order("c_acctbal", False),), page_size=400)
    found = [(pa.array([r.c_custkey for r in page], pa.int64()), pa.array([r.c_acctbal for r in page], pa.float64())) for page in results.pages(d.planner, query)]
    return _columns(d, found, "c_custkey long, c_acctbal double")


add("r01_stream_early_stop", _streamed, "SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 75")
add("r02_map_stream", _mapped, "SELECT n_nationkey, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
add("r03_list_with_limit", lambda d: d.catalog.table("orders").sparkSession.createDataFrame([tuple(r) for r in d.select("o_orderkey").from_("orders").order_by("o_orderkey").limit(33).list()], "o_orderkey long"), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 33")
add("r05_parallel_stream", _in_parallel, "SELECT CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
add("r14_parallel_pages", _parallel_pages, "SELECT c_custkey FROM customer")
add("r14_all_pages", _all_pages, "SELECT c_custkey, c_acctbal FROM customer")


def _one(d: Database, **values) -> DataFrame:
    """One row of these values."""
    spark = d.catalog.table("region").sparkSession
    return spark.range(1).select(*[F.lit(v).cast("long" if isinstance(v, int) and not isinstance(v, bool) else "double" if isinstance(v, float) else "boolean" if isinstance(v, bool) else "string").alias(k) for k, v in values.items()])


def _stopped(d: Database, most: int) -> bool:
    """Whether the guard stops a query over all nations."""
    try:
        d.select("n_nationkey").from_("nation").max_cardinality(most).df()
    except MaxCardinalityExceeded:
        return True
    return False


def _hit(query: b.Builder) -> DataFrame:
    """The kept result of a cached query, asked for twice."""
    first = query.df()
    if query.df() is not first:
        raise AssertionError("a cached result was not found")
    return first


def _halved(frames):
    for frame in frames:
        large = frame[frame.o_totalprice > 400000]
        yield large.assign(status=large.o_orderstatus, half=large.o_totalprice / 2)[["status", "half"]]


def _flags(d: Database, **values: bool) -> DataFrame:
    return d.catalog.table("region").limit(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _taken(d: Database, n: int) -> DataFrame:
    """The first rows of a lazy sequence, back as a table."""
    taken = list(itertools.islice(d.select("o_orderkey").from_("orders").order_by("o_orderkey").rows(), n))
    return d.catalog.table("orders").sparkSession.createDataFrame([tuple(r) for r in taken], "o_orderkey long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by status for customers of one region, from the large orders alone."""
    d = database(spark, sf_dir)
    made = d.select("o_orderstatus", "sum(o_totalprice)", "count(o_orderkey)").from_("orders").where(col("o_totalprice").gt(1000.0)).and_(col("customer.nation.region.r_name").eq("ASIA")).group_by("o_orderstatus").order_by("o_orderstatus")
    return rounded(made, None, 2, None).toDF("o_orderstatus", "total", "n")


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 1000 AND r_name = 'ASIA' GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
