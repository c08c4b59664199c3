"""Small tables with nulls, and what is known about them."""

from datetime import datetime, timedelta

from heliograph.builder import Database
from heliograph.schema import Catalog, EntitySchema, Relationship

EPOCH = datetime(1970, 1, 1)


def moment(ms):
    return None if ms is None else EPOCH + timedelta(milliseconds=ms)


FETCH = [
    ("FIRST ONE", "Some test string", 1000, 3.3, 1.1, False, True, 1000, 323, 3, 3, 1),
    ("FIRST ONE1", "Some test string1", 1001, 3.31, 1.11, True, False, 1002, 322, 2, 3, None),
    ("FIRST ONE2", "Some test string1", 1001, 3.31, 1.11, True, False, 1002, 322, 2, 4, None),
    ("FIRST ONE3", "Some test string3", 1022, 3.35, 1.126, False, True, 1301, 322, 6, 3, None),
    ("FIRST ONE4", None, None, 0.0, None, None, False, 0, None, None, 0, 2),
    ("FIRST ONE5", None, None, 0.0, None, None, False, 0, None, None, 0, None),
]
FETCH_SCHEMA = "id string, stringValue string, dateValue timestamp, doublePrimitive double, doubleValue double, booleanValue boolean, booleanPrimitive boolean, longPrimitive long, longValue long, intValue int, intPrimitive int, child_id long"
CHILDREN = [(1, "HIYA"), (2, "HIYA DOS")]
FUNCTIONS = [(i, str(v), v, o) for i, (v, o) in enumerate(zip([2, 3, 4, 5, 6, 7, 8, 9, 10, 99, 9], "aabbccddeef", strict=True))]
NAMES = ["2", "3", "4", "5", "6", "7", "8", "9", "Some other Value", "9", "99"]


def database(spark, strict=False):
    rows = [(*r[:2], moment(r[2]), *r[3:]) for r in FETCH]
    fetch = spark.createDataFrame(rows, FETCH_SCHEMA)
    child = spark.createDataFrame(CHILDREN, "id long, someOtherField string")
    functions = spark.createDataFrame([(i, n, v, o) for (i, _, v, o), n in zip(FUNCTIONS, NAMES, strict=True)], "id long, stringValue string, longPrimitive long, otherString string")
    people = spark.createDataFrame([(1, "A", 10, 1), (2, "B", 20, 1), (3, "C", None, 2), (4, "D", 40, None)], "id long, name string, age int, address_id long")
    addresses = spark.createDataFrame([(1, "Main", 5), (2, "Side", None), (3, "Empty", 7)], "id long, street string, houseNr int")
    catalog = Catalog()
    catalog.add(EntitySchema.of("fetch", fetch.schema, "id", relationships=(Relationship("child", "ONE_TO_ONE", "child", "child_id", "id"),)), fetch)
    catalog.add(EntitySchema.of("child", child.schema, "id"), child)
    catalog.add(EntitySchema.of("functions", functions.schema, "id"), functions)
    catalog.add(EntitySchema.of("person", people.schema, "id", relationships=(Relationship("address", "MANY_TO_ONE", "address", "address_id", "id"),)), people)
    catalog.add(EntitySchema.of("address", addresses.schema, "id", relationships=(Relationship("occupants", "ONE_TO_MANY", "person", "id", "address_id"),)), addresses)
    return Database(catalog, strict)
