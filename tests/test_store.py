import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph import results
from heliograph.builder import col, desc
from heliograph.plans.ir import Order, Query
from heliograph.plans.parse import call, cascades, query_of
from heliograph.schema import Attribute, EntitySchema, Index, Relationship, difference
from heliograph.sources.journal import Journal
from heliograph.sources.warehouse import Conflict, Warehouse
from heliograph.streaming import live

ITEM = EntitySchema("item", (Attribute("id", T.LongType()), Attribute("name", T.StringType(), size=5), Attribute("kind", T.StringType(), values=("a", "b")), Attribute("box", T.LongType())), "id", "SEQUENCE", indexes=(Index("name"),), relationships=(Relationship("parent", "MANY_TO_ONE", "box", "box", "id", cascade="SAVE"),))
BOX = EntitySchema("box", (Attribute("id", T.LongType(), False), Attribute("label", T.StringType())), "id", relationships=(Relationship("items", "ONE_TO_MANY", "item", "id", "box", cascade="ALL"),))


@pytest.fixture
def store(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"), journal=True)
    store.declare(ITEM)
    store.declare(BOX)
    return store


def rows(store, name="item"):
    return sorted(tuple(r) for r in store.from_(name).list())


def test_save_update_delete_and_replay(spark, store, tmp_path):
    assert store.save("item", [{"name": "x", "kind": "a"}, {"name": "y", "kind": "b"}, {"id": 10, "name": "z"}]) == 3
    assert sorted(r[0] for r in rows(store)) == [10, 11, 12]
    store.save("item", [{"id": 10, "name": "zz", "kind": "a"}])
    assert (10, "zz", "a", None) in rows(store)
    assert store.update(Query("item", criteria=col("kind").eq("a"), updates={"box": 7})) == 2
    assert store.delete(Query("item", criteria=col("kind").eq("b"))) == 1
    with pytest.raises(ValueError, match="longer"):
        store.save("item", [{"name": "too long"}])
    with pytest.raises(ValueError, match="values"):
        store.save("item", [{"kind": "c"}])
    with pytest.raises(ValueError, match="identifier"):
        store.update(Query("item", updates={"id": 3}))
    before = rows(store)
    store._write(ITEM, store.read("item").limit(0))
    store.recover(Journal(spark, f"{store.root}/_journal"))
    assert rows(store) == before
    again = Warehouse(spark, store.root)
    assert rows(again) == before and again.find("item", 10)["name"] == "zz" and not again.exists("item", 99)
    store.vacuum("item")
    assert rows(store) == before and store.verify() == {"item": 2, "box": 0}
    other = Warehouse(spark, str(tmp_path / "copy"))
    store.clone_to(other)
    assert rows(other) == before
    assert store.truncate("item") == 2 and rows(store) == []


def test_top_k_changes(store):
    store.save("item", [{"id": i, "name": str(i)} for i in range(1, 7)])
    assert store.delete(Query("item", order_by=(desc("id"),), limit=2)) == 2
    assert [r[0] for r in rows(store)] == [1, 2, 3, 4]
    assert store.remove("item", [1, 99]) == 1


def test_relations_and_cascades(spark, store):
    store.save("box", [{"id": 1, "label": "one"}, {"id": 2, "label": "two"}])
    store.save_with("item", spark.createDataFrame([(5, "n", "a", 3)], "id long, name string, kind string, box long"), {"parent": spark.createDataFrame([(3, "three")], "id long, label string")})
    assert len(rows(store, "box")) == 3
    store.save("item", [{"id": 6, "name": "m"}])
    store.relate("box", "items", 1, [6])
    assert (6, "m", None, 1) in rows(store)
    assert store.remove_with("box", [3]) == {"items": 1, "box": 1}
    assert [r[0] for r in rows(store)] == [6]


def test_cascade_strings(spark, store):
    boxes = spark.createDataFrame([(8, "eight"), (9, "nine")], "id long, label string")
    items = spark.createDataFrame([(8, 80, "x"), (9, 90, "y")], "_parent long, id long, name string")
    assert store.save_cascading("box", boxes, {"items": items}, "items:item(box, id)") == {"box": 2, "items": 2}
    assert [(r[0], r[3]) for r in rows(store)] == [(80, 8), (90, 9)]


def test_documents(store, tmp_path):
    from heliograph.sources.documents import Documents

    docs = Documents(store)
    one = docs.save(b"hello", "a/b.txt")
    assert docs.get(one)["content"] == b"hello" and docs.get(one)["mimeType"] == "text/plain"
    docs.save(b"again", "a/b.txt", one)
    assert bytes(docs.get(one)["content"]) == b"again"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(b"123")
    assert docs.import_folder(str(tmp_path / "in")) == 1 and docs.table().count() == 2
    assert docs.delete(one) and not docs.delete(one)


def test_dates_and_casts(spark):
    from heliograph.functions.scalars import cast_or_zero, parsed_date

    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01",), ("2024-05-01 11:12:13",), ("no",), (None,)], "s string")
    years = [r[0].year if r[0] else None for r in df.select(parsed_date(F.col("s"))).collect()]
    assert years == [2024, 2024, 2024, None, None]
    zeros = [r[0] for r in df.select(cast_or_zero(F.col("s"), T.IntegerType(), nullable=False)).collect()]
    assert zeros == [0, 0, 0, 0, 0]


def test_schemas(store):
    wider = ITEM.with_(attributes=(*ITEM.attributes, Attribute("note", T.StringType())))
    store.save("item", [{"id": 1, "name": "a"}])
    store.declare(wider)
    assert rows(store) == [(1, "a", None, None, None)] and len(store.history("item")) == 2
    assert difference(ITEM, wider)["added"] == ["note"]
    with pytest.raises(ValueError):
        EntitySchema("bad", (Attribute("a", T.LongType()),), "b")
    with pytest.raises(ValueError):
        difference(BOX, BOX.with_(relationships=(Relationship("items", "MANY_TO_ONE", "item", "id", "box"),)))


def test_pages_and_reductions(spark, store):
    store.save("item", [{"id": i, "name": str(i % 3), "box": None if i % 4 == 0 else i} for i in range(1, 12)])
    query = Query("item", order_by=(Order("box", False),), page_size=4)
    seen = [r["id"] for page in results.pages(store.planner, query) for r in page]
    assert len(seen) == 11 and seen[:3] == [11, 10, 9] and sorted(seen[-2:]) == [4, 8]
    r = results.reduction(store.from_("item").df(), "box")
    assert (r["max"], r["min"], r["n"]) == (11, 1, 9)
    got = []
    assert results.for_each(store.from_("item").order_by("id").df(), lambda row: got.append(row.id) or len(got) < 3) == 3
    cache = results.ResultCache(store.planner, 1)
    assert cache.get(Query("item")) is cache.get(Query("item"))
    cache.written("item")
    assert not cache._kept
    assert store.from_("item").values("box").count() == 9


def test_more_ways_of_consuming(spark, store):
    from heliograph.builder import format_
    from heliograph.sources.warehouse import in_memory

    assert store.save_in_batches("item", spark.createDataFrame([(i, "n") for i in range(1, 21)], "id long, name string"), 5) == 20
    seen = []
    assert results.for_each_map(store.from_("item").df(), lambda row: seen.append(row["name"])) == 20
    results.for_each_parallel(store.from_("item").df(), lambda row: None)
    assert results.cancellable(spark, "counting", store.from_("item").count) == 20
    assert set(store.all_tables()) == {"item", "box"}
    kept = in_memory(spark, {"item": (ITEM, store.read("item"))})
    assert kept.select(format_("id", "0.0")).from_("item").order_by("id").limit(1).first()[0] == "1.0"


def test_parsing():
    assert call("sum(price)").aggregate and call("replace(a, 'x', \"y\")").arguments == ("x", "y") and call("a.b") is None
    assert [c.attribute for c in cascades("a:T(x,y), b : U ( p , q )")] == ["a", "b"]
    with pytest.raises(ValueError):
        cascades("a:T(x")
    q = query_of({"type": "SelectQuery", "table": "t", "conditions": {"conditionType": "SingleCondition", "criteria": {"field": "a", "operator": "EQUAL", "value": 1}}, "sort": [{"field": "a", "order": "DESC"}]})
    assert q.criteria.value == 1 and not q.order_by[0].ascending


def test_live_events(spark, tmp_path):
    data = [(1, "INSERT", 1, 60), (2, "UPDATE", 1, 10), (3, "UPDATE", 2, 70), (4, "DELETE", 2, 70), (5, "DELETE", 3, 5), (6, "UPDATE", 1, 10), (7, "INSERT", 4, 3)]
    changes = spark.createDataFrame(data, "seq long, op string, id long, value int")
    expected = [("added", 1), ("removed", 2), ("updated", 3), ("removed", 4)]
    assert sorted((r.event, r.seq) for r in live.deltas(changes, F.col("value") > 50, "id").collect()) == sorted(expected)
    changes.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "log"))
    seen = []
    on = {e: lambda row: seen.append((row["event"], row["seq"])) for e in (live.ADDED, live.UPDATED, live.REMOVED)}
    listener = live.Listener(stream, F.col("value") > 50, "id", on, str(tmp_path / "state"), available_now=True)
    listener.query.awaitTermination(120)
    assert sorted(seen) == sorted(expected)
    table = spark.createDataFrame([(9, 80), (1, 20)], "id long, value int")
    both = live.snapshot_and_deltas(table, changes, F.col("value") > 50, "id").collect()
    assert ("snapshot", 9) in [(r.event, r.id) for r in both]


def test_last_row_wins_and_callbacks(spark, store):
    seen = []
    tell = lambda kind: lambda frame: seen.append((kind, sorted(r.id for r in frame.collect()))) or frame
    store.declare(BOX.with_(before_insert=(tell("before insert"),), after_insert=(tell("after insert"),), before_update=(tell("before update"),), after_update=(tell("after update"),), before_remove=(tell("before remove"),), after_remove=(tell("after remove"),)))
    assert store.save("box", [{"id": 1, "label": "a"}, {"id": 1, "label": "b"}, {"id": 2, "label": "c"}, {"id": 1, "label": "d"}]) == 4
    assert rows(store, "box") == [(1, "d"), (2, "c")]
    store.save("box", [{"id": 2, "label": "x"}, {"id": 3, "label": "y"}])
    store.remove("box", [3])
    assert seen == [
        ("before insert", [1, 2]), ("before update", []), ("after insert", [1, 2]), ("after update", []),
        ("before insert", [3]), ("before update", [2]), ("after insert", [3]), ("after update", [2]), ("before remove", [3]), ("after remove", [3]),
    ]


def test_generated_texts_are_the_same_everywhere(spark, tmp_path):
    note = EntitySchema("note", (Attribute("id", T.StringType()), Attribute("text", T.StringType())), "id", "UUID")
    store = Warehouse(spark, str(tmp_path / "n"), journal=True)
    store.declare(note)
    store.save("note", [{"text": str(i)} for i in range(20)])
    logged = {r.pk for r in store.journal.read().collect()}
    assert logged == {r[0] for r in rows(store, "note")} and len(logged) == 20


def test_cascades_go_down_and_stop_at_cycles(spark, tmp_path):
    link = lambda name, target, cascade="ALL": Relationship(name, "ONE_TO_MANY", target, "id", "up", cascade=cascade)
    columns = (Attribute("id", T.LongType(), False), Attribute("up", T.LongType()))
    store = Warehouse(spark, str(tmp_path / "c"))
    for schema in (EntitySchema("a", columns, "id", relationships=(link("bs", "b"),)), EntitySchema("b", columns, "id", relationships=(link("cs", "c"),)), EntitySchema("c", columns, "id", relationships=(link("as", "a"), link("kept", "b", "SAVE")))):
        store.declare(schema)
    for name in "abc":
        store.save(name, [{"id": i, "up": i % 3} for i in range(9)])
    assert store.remove_with("a", [1]) == {"a": 1, "bs": 3, "bs.cs": 3}
    assert [r[0] for r in rows(store, "b")] == [0, 2, 3, 5, 6, 8]


def test_cached_results_follow_writes(store):
    store.save("box", [{"id": 1, "label": "a"}])
    query = store.from_("box").cache()
    assert query.df() is query.df() and query.count() == 1
    store.save("box", [{"id": 2, "label": "b"}])
    assert query.df().count() == 2


def test_hydration_and_guard(spark, store):
    from heliograph.plans.planner import MaxCardinalityExceeded

    store.save("box", [{"id": 1, "label": "a"}, {"id": 2, "label": "b"}])
    store.save("item", [{"id": i, "name": "n", "box": 1} for i in (5, 6)])
    assert sorted(r["id"] for r in store.hydrated("box", 1)["items"]) == [5, 6] and store.hydrated("box", 2)["items"] == []
    assert store.hydrated("item", 5, "parent")["parent"] == {"id": 1, "label": "a"} and store.hydrated("box", 9) is None
    store.planner.max_cardinality = 1
    with pytest.raises(MaxCardinalityExceeded):
        store.from_("box").list()
    assert len(store.from_("box").max_cardinality(2).list()) == 2


def test_distinct_in_order(spark, store):
    store.save("item", [{"id": i, "name": "xyz"[i % 3], "box": None if i == 4 else 20 - i} for i in range(1, 10)])
    names = lambda order: [r[0] for r in store.select("name").from_("item").distinct().order_by(order).list()]
    assert names("box") == ["y", "x", "z"]  # the null at 4 is lowest, then 11 at 9, 12 at 8
    assert names(desc("box")) == ["y", "z", "x"]


def test_pages_side_by_side(store):
    store.save("item", [{"id": i, "name": "n"} for i in range(1, 24)])
    query = Query("item", selections=("id",), page_size=4)
    assert [[r.id for r in p] for p in results.pages(store.planner, query)] == [[r.id for r in p] for p in results.pages(store.planner, query, prefetch=False)]
    seen = []
    assert results.for_each_page(store.planner, query, lambda rows: seen.extend(r.id for r in rows)) == 6
    assert sorted(seen) == list(range(1, 24))
    assert results.for_each_page(store.planner, query, lambda rows: False, workers=1) < 6


def test_pages_are_cut_from_one_sort(spark, store, monkeypatch):
    """However many pages: one plan; and rows that repeat an identifier are lost at no page's end."""
    store.save("item", [{"id": i, "name": "n"} for i in range(1, 24)])
    read, planned = store.planner.plan, []
    monkeypatch.setattr(store.planner, "plan", lambda query: planned.append(query) or read(query).unionByName(read(query)))
    query = Query("item", selections=("id",), page_size=3)
    found = [[r.id for r in p] for p in results.pages(store.planner, query)]
    assert [i for p in found for i in p] == sorted([*range(1, 24)] * 2) and [len(p) for p in found] == [3] * 15 + [1]
    assert len(planned) == 1
    _, token = results.page(store.planner, query.with_(page_size=4))
    assert [r.id for p in results.pages(store.planner, query.with_(next_page=token)) for r in p] == sorted([*range(3, 24)] * 2)


def test_validation_and_cascade_string_deletes(spark, store):
    assert not any(store.validate(BOX).values())
    assert any(store.validate(BOX.with_(attributes=(*BOX.attributes, Attribute("more", T.LongType())))).values()) and len(store.history("box")) == 1
    assert any(store.validate(BOX.with_(name="other")).values())
    store.save("box", [{"id": 1}, {"id": 2}])
    store.save("item", [{"id": i, "name": "n", "box": 1 + i % 2} for i in range(5, 10)])
    assert store.remove_cascading("box", [2], "items:item(box, id)") == {"items": 3, "box": 1}
    assert [r[0] for r in rows(store)] == [6, 8]


PARTED = EntitySchema("parted", (Attribute("id", T.LongType()), Attribute("area", T.StringType()), Attribute("n", T.LongType())), "id", partition="area")


def test_a_change_rewrites_the_partitions_it_touches(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    store.declare(PARTED)
    assert rows(store, "parted") == []
    store.save("parted", [{"id": i, "area": ("007", "b/=c", None)[i % 3], "n": i} for i in range(9)])

    def folders():
        return store._commit("parted", store._version("parted"))["folders"]

    first = folders()
    assert len(first) == 3 and set(store.read("parted").select("area").distinct().toPandas()["area"].map(str)) == {"007", "b/=c", "None"}
    store.save("parted", [{"id": 0, "area": "new", "n": 100}])  # leaves 007 for a partition of its own
    second = folders()
    assert [k for k in first if second.get(k) != first[k]] == ["area=007"] and len(second) == 4
    assert store.read("parted").count() == 9
    assert store.update(Query("parted", criteria=col("id").eq(4), updates={"n": -4})) == 1
    assert store.update(Query("parted", criteria=col("id").eq(5), updates={"area": "007"})) == 1
    assert store.delete(Query("parted", criteria=col("id").eq(8))) == 1
    store.save("parted", [{"id": 20, "area": "", "n": 20}])
    store.remove("parted", [0])
    third = folders()
    assert "area=new" not in third
    want = [(1, "b/=c", 1), (2, None, 2), (3, "007", 3), (4, "b/=c", -4), (5, "007", 5), (6, "007", 6), (7, "b/=c", 7), (20, None, 20)]
    assert rows(store, "parted") == want
    store.vacuum("parted")
    assert rows(store, "parted") == want and rows(Warehouse(spark, store.root), "parted") == want
    store.declare(PARTED.with_(attributes=(*PARTED.attributes, Attribute("more", T.StringType()))))
    store.save("parted", [{"id": 3, "area": "007", "n": 3, "more": "x"}])  # a new revision writes all of it
    assert len(set(folders().values())) == 1
    assert [r[0] for r in rows(store, "parted") if r[3]] == [3] and len(rows(store, "parted")) == 8
    assert store.truncate("parted") == 8 and rows(store, "parted") == []


def test_of_two_writers_the_first_wins(store):
    store.save("item", [{"id": 1, "name": "x"}])
    since, mine = store._version("item"), store.read("item")
    store.save("item", [{"id": 2, "name": "y"}])
    with pytest.raises(Conflict):
        store._write(ITEM, mine, since)
    assert [r[0] for r in rows(store)] == [1, 2]
    store.vacuum("item")
    assert len(store.files.names(f"{store.root}/item")) == 3  # the schema, the commits, one folder of rows


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    plain = EntitySchema("dealt", (Attribute("id", T.LongType()), Attribute("n", T.LongType())), "id")
    dealt = plain.with_(buckets=8)
    store.declare(dealt)
    store.save("dealt", [{"id": i, "n": i} for i in range(100)])

    def folders():
        return store._commit("dealt", store._version("dealt"))["folders"]

    first = folders()
    assert len(first) == 8 and store.read("dealt").columns == ["id", "n"]
    store.save("dealt", [{"id": 5, "n": -5}, {"id": 5, "n": -6}])
    second = folders()
    assert len([k for k in first if second[k] != first[k]]) == 1
    store.remove("dealt", [7])
    assert store.update(Query("dealt", criteria=col("id").eq(9), updates={"n": 0})) == 1
    assert store.delete(Query("dealt", criteria=col("id").eq(11))) == 1
    want = [(i, {5: -6, 9: 0}.get(i, i)) for i in range(100) if i not in (7, 11)]
    assert rows(store, "dealt") == want
    store.vacuum("dealt")
    assert rows(Warehouse(spark, store.root), "dealt") == want
    for schema in (plain, dealt.with_(buckets=3), plain):  # dealt anew: the next write is of the whole table
        store.declare(schema)
        assert rows(store, "dealt") == want
        store.save("dealt", [{"id": 5, "n": -6}])
        assert len(folders()) == schema.buckets and rows(store, "dealt") == want
