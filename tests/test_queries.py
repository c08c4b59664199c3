import pytest

from heliograph.builder import asc, avg, col, count_, desc, max_, median, min_, percentile, sum_
from heliograph.plans import registry
from heliograph.plans.planner import MaxCardinalityExceeded
from tests.fixtures import database, moment


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


CASES = [
    (col("id").between("FIRST", "LAST"), 6),
    (col("id").not_between("FIRST", "LAST"), 0),
    (col("dateValue").between(moment(1001), moment(1022)), 3),
    (col("dateValue").not_between(moment(1001), moment(1022)), 3),
    (col("stringValue").contains("Some test string"), 4),
    (col("stringValue").neq("Some test string1"), 4),
    (col("stringValue").not_starts_with("Some"), 2),
    (col("stringValue").not_matches("Some.*"), 2),
    (col("stringValue").not_like("some test string1"), 4),
    (~(col("stringValue").eq("Some test string1") & col("stringValue").starts_with("Some")), 4),
    (col("stringValue").lt("Some test string2"), 5),
    (col("longValue").lt(323), 5),
    (col("intValue").lt(3), 4),
    (col("doubleValue").lt(1.11), 3),
    (col("dateValue").lt(moment(1001)), 3),
    (col("stringValue").not_in(["Some test string1", "Some test string3"]), 3),
    (col("longValue").not_in([322, None]), 3),
    (col("stringValue").eq(None), 2),
    (col("stringValue").is_null(), 2),
    (col("longValue").gte(None), 6),
    (col("longValue").gt(None), 4),
    (col("longValue").lte(None), 2),
    (col("stringValue").matches("string"), 0),
    (col("stringValue").contains_ignore_case("TEST"), 4),
    (col("child.someOtherField").eq("HIYA"), 1),
    (col("child.someOtherField").is_null(), 4),
    (col("child").not_null(), 2),
    (~col("child.someOtherField").eq("HIYA"), 1),
    (col("stringValue").sql_like("%string_"), 3),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_conditions(db, number):
    criteria, expected = CASES[number]
    builder = db.from_("fetch").where(criteria)
    assert builder.count() == expected
    assert len(builder.list()) == expected


def test_fold_has_no_precedence(db):
    a = db.from_("fetch").where(col("intPrimitive").eq(4)).or_(col("intPrimitive").eq(3)).and_(col("longValue").eq(323))
    assert [r.id for r in a.list()] == ["FIRST ONE"]


def test_order_puts_null_lowest(db):
    rows = db.from_("fetch").order_by(desc("longValue"), desc("id")).list()
    assert [r.id for r in rows] == ["FIRST ONE", "FIRST ONE3", "FIRST ONE2", "FIRST ONE1", "FIRST ONE5", "FIRST ONE4"]
    assert [r.id for r in db.from_("fetch").order_by("longValue", "id").limit(2).list()] == ["FIRST ONE4", "FIRST ONE5"]


def test_functions(db):
    row = db.select("sum(longPrimitive)", "avg(longPrimitive)", "min(longPrimitive)", "max(longPrimitive)", "count(longPrimitive)", "median(longPrimitive)", "percentile(longPrimitive, 20)").from_("functions").first()
    assert tuple(row) == (162, 14, 2, 99, 11, 7, 4)
    assert db.select(count_("otherString")).from_("functions").distinct().first()[0] == 6
    assert tuple(db.select(max_("longPrimitive"), "stringValue").from_("functions").first()) == (99, "9")
    half = db.select("stringValue", percentile("longPrimitive", 50)).from_("functions").group_by("stringValue").where(col("stringValue").eq("9")).first()
    assert half[1] == 54


def test_nulls_in_aggregates(db):
    row = db.select(sum_("longValue"), avg("longValue"), min_("longValue"), max_("longValue"), median("longValue"), "count(longValue)", "std(longValue)").from_("fetch").first()
    assert tuple(row)[:6] == (1289, 214, None, 323, 322, 6)
    assert round(row[6], 3) == round((sum((x - 1289 / 6) ** 2 for x in (323, 322, 322, 322, 0, 0)) / 6) ** 0.5, 3)
    empty = db.select(sum_("longValue"), avg("longValue"), "std(longValue)").from_("fetch").where(col("id").eq("none")).first()
    assert tuple(empty) == (None, None, None)


def test_relationships(db):
    rows = db.select("id", "occupants.name", "occupants").from_("address").order_by("id").list()
    assert [r["occupants.name"] for r in rows] == [["A", "B"], ["C"], []]
    assert [len(r["occupants"]) for r in rows] == [2, 1, 0]
    assert db.from_("address").where(col("occupants.name").eq("A") & col("occupants.name").eq("B")).count() == 1
    assert db.from_("address").where(col("occupants.age").is_null()).count() == 2  # a child without age, and no child
    assert [r[0] for r in db.select("address.street").from_("person").order_by("id").list()] == ["Main", "Main", "Side", None]
    assert db.from_("person").where(col("address.occupants.name").eq("B")).count() == 2
    only = db.from_("address").where(col("occupants.age").gt(100) | col("street").eq("Empty"))
    assert [r.id for r in only.list()] == [3]
    assert db.from_("person").where(~(col("address.street").eq("Main") | col("age").gt(30))).count() == 1


def test_subqueries(db):
    young = db.select("address_id").from_("person").where(col("age").lt(15))
    assert sorted(r.id for r in db.from_("address").where(col("id").is_in(young)).list()) == [1, 2]
    assert sorted(r.id for r in db.from_("address").where(col("id").not_in(db.select("address_id").from_("person"))).list()) == [3]
    assert db.from_("person").where(col("address").is_in(db.select("id").from_("address").where(col("houseNr").eq(5)))).count() == 2


def test_strict_coercion(spark):
    strict = database(spark, strict=True)
    assert strict.from_("fetch").where(col("doublePrimitive").eq(3)).count() == 4
    assert database(spark).from_("fetch").where(col("doublePrimitive").eq(3)).count() == 0


def test_distinct_group_and_paging(db):
    assert [r[0] for r in db.select("intPrimitive").from_("fetch").distinct().order_by("intPrimitive").list()] == [0, 3, 4]
    first = db.select("intPrimitive", "id").from_("fetch").group_by("intPrimitive").order_by(asc("intPrimitive")).list()
    assert [tuple(r) for r in first] == [(0, "FIRST ONE4"), (3, "FIRST ONE"), (4, "FIRST ONE2")]
    assert [r.id for r in db.from_("fetch").order_by("id").offset(4).limit(5).list()] == ["FIRST ONE4", "FIRST ONE5"]
    with pytest.raises(MaxCardinalityExceeded):
        db.from_("fetch").max_cardinality(3).list()
    with pytest.raises(KeyError):
        db.from_("fetch").where(col("nothing").eq(1)).df()


def test_scalars(db):
    row = db.select("upper(stringValue)", "substring(stringValue, 5, 9)", "replace(stringValue, '[aeiou]', '*')", "format(doublePrimitive, '#.##')", "format(dateValue, 'yyyy')").from_("fetch").where(col("id").eq("FIRST ONE")).first()
    assert tuple(row) == ("SOME TEST STRING", "test", "S*m* t*st str*ng", "3.30", "1970")
    none = db.select("upper(stringValue)", "format(dateValue)").from_("fetch").where(col("id").eq("FIRST ONE4")).first()
    assert tuple(none) == (None, "")


def test_filters_reach_the_scan(spark, sf):
    from heliograph.plans.tables import database as tables

    df = tables(spark, sf).select("o_orderkey").from_("orders").where(col("o_totalprice").gt(1000.0) & col("o_orderstatus").neq("F")).df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


@pytest.mark.parametrize("key", ["r14_all_pages", "r14_parallel_pages"])
def test_page_queries_read_their_table_once(spark, monkeypatch, key):
    from heliograph.plans.planner import Planner

    read, planned = Planner.plan, []
    monkeypatch.setattr(Planner, "plan", lambda self, query: planned.append(query) or read(self, query))
    found = registry.QUERIES[key](spark, "/root/testdata/sf0.01")
    assert found.count() == 1500 and len(planned) == 1


def test_pages_as_columns(spark, sf):
    import pyarrow as pa

    d = registry.database(spark, sf)
    some = [(pa.array([1, None], pa.int64()), pa.array([None, 2.5], pa.float64())), (pa.array([3], pa.int64()), pa.array([0.5], pa.float64()))]
    assert [tuple(r) for r in registry._columns(d, some, "k long, v double").collect()] == [(1, None), (None, 2.5), (3, 0.5)]
    assert registry._columns(d, [], "k long, v double").collect() == []
