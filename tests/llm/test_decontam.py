import hashlib
import random
import re

import pytest

from heliograph.llm import decontam
from tests.llm.cases import documents, empty, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    table = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            table.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in table}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in table:
                    hit |= set(range(i, i + n))
                    found |= table[tuple(w[i : i + n])]
        ids = ",".join(sorted(map(str, found - {None})))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(6)
    rows = documents()
    texts = [t for _, t, _ in rows if t]
    items = [(i, prose(rng, "en", 25)) for i in range(5)]
    items += [(10, " ".join(texts[2].split()[3:20])), (11, " ".join(texts[7].split()[-12:])), (9, "one"), (100, "small7 house"), (12, None), (13, ""), (14, "!!"), (None, texts[3]), (10, texts[5]), (15, texts[2].upper())]
    rows += [(2000 + i, prose(rng, "en", 10) + " " + t + " " + prose(rng, "fr", 10), None) for i, (_, t) in enumerate(items[:3])]
    return rows, items


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST, 0])
def test_against_brute_force(spark, broadcast):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contaminated(frame(spark, rows), table, broadcast=broadcast)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, items)


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST, 0])
def test_a_large_benchmark(spark, broadcast):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for i in range(500)]  # 25,500 windows
    rows = [(i, " ".join([*items[i][1].split()[i % 40 : i % 40 + rng.randrange(8, 14)], *(f"w{rng.randrange(4000)}" for _ in range(30))]), None) for i in range(300)]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = sorted((tuple(r) for r in decontam.contaminated(frame(spark, rows), table, broadcast=broadcast).collect()), key=str)
    assert out == brute(rows, items) and 100 < sum(r[5] for r in out) < 300


def test_ties_and_short_items(spark):
    """Windows of one word over and over have several least hashes; texts longer than 64 words wrap the places."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    rows = [(i, text(rng.randrange(0, 300)), None) for i in range(60)] + [(100, "a " * 400, None), (101, "a " * 9, None)]
    items = [(1, text(10)), (2, text(12)), (3, "a " * 11), (4, "b a b"), (5, text(7)), (6, text(5)), (7, text(6)), (None, text(9))]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontam.contaminated(frame(spark, rows), table).collect()), key=str) == brute(rows, items)


def test_clean_and_empty(spark):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    for options in ({}, {"broadcast": 0}):
        kept = decontam.clean(df, table, **options)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(rows, items) if not r[5]), key=str)
    assert decontam.clean(empty(spark), table).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(df, nothing).filter("contaminated").isEmpty()
    assert decontam.contaminated(df, nothing).count() == decontam.clean(df, nothing).count() == len(rows)
    assert decontam.contaminated(empty(spark), table).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = decontam.op7_decontaminate(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
