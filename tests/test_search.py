import math

import pytest
from pyspark.sql import functions as F

from heliograph.operators import fulltext, vector
from heliograph.operators.fulltext import parsed

TEXTS = [(1, "The quick brown fox"), (2, "quick quick fox jumps"), (3, "lazy dog"), (4, None), (5, "brown dog, brown fox!")]


def test_bm25(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    found = {r.id: r["__score__"] for r in fulltext.search(df, F.col("text"), "quick").collect()}
    mean = (4 + 4 + 2 + 0 + 4) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    assert set(found) == {1, 2}
    assert math.isclose(found[2], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean)))

    def ids(query):
        return sorted(r.id for r in fulltext.search(df, F.col("text"), query).collect())

    assert ids("quick dog") == [1, 2, 3, 5] and ids("quick AND brown") == [1] and ids("fox -quick") == [5]
    assert ids('"brown fox"') == [1, 5] and ids("qu*") == [1, 2] and ids("d?g") == [3, 5]
    assert ids("+fox (lazy OR brown)") == [1, 2, 5] and ids("fox AND NOT brown") == [2] and ids("") == []
    assert ids("(unclosed fox") == [1, 2, 5]
    assert parsed("a AND b").must and not parsed("a b").must


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "id long, v array<float>")
    top = vector.nearest(df, "v", [1.0, 0.1], 2, "id").collect()
    assert [r.id for r in top] == [1, 3]
    assert [r.id for r in vector.nearest(df, "v", [1.0, 0.0], 5, "id", minimum_score=0.5).collect()] == [1, 3]
    near = vector.nearest(df, "v", [1.0, 0.1], 2, "id", quantization="INT8").collect()
    assert abs(near[0]["__score__"] - top[0]["__score__"]) < 0.02


@pytest.mark.parametrize("query", ["the house", "the AND house", "+hous* -the", "house OR NOT light", "nothing_here", "th? light", "-the", ""])
def test_postings_answer_as_the_texts_do(spark, tmp_path, query):
    from heliograph.sources.indexes import TextIndex

    words = "the house light houses water Été été a_b 12".split()
    rows = [(i, " ".join(words[(i * 7 + k * k) % 9] for k in range(i % 11))) for i in range(60)] + [(100, None), (101, ""), (None, "the house"), (102, "the " * 50)]
    df = spark.createDataFrame(rows, "id long, text string")
    index = TextIndex(spark, str(tmp_path / "i")).build(df, "id", F.col("text"), 4)
    expected = {r.id: round(r["__score__"], 9) for r in fulltext.search(df, F.col("text"), query).collect()}
    assert {r.key: round(r["__score__"], 9) for r in index.search(query).collect()} == expected
    with pytest.raises(ValueError):
        index.search('"the house"')


def test_vector_cells(spark, tmp_path):
    import numpy as np

    from heliograph.sources.indexes import VectorIndex

    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 16))
    points = [(i, [float(x) for x in middles[i % 12] + rng.normal(0, 0.4, 16)]) for i in range(1200)]
    df = spark.createDataFrame([*points, (5000, None), (5001, [1.0] * 3), (5002, [0.0] * 16)], "id long, v array<float>")
    index = VectorIndex(spark, str(tmp_path / "v")).build(df, "id", "v")
    assert spark.read.parquet(f"{index.path}/cells").count() == 1201
    found = 0
    for i in range(0, 200, 20):
        exact = {r.id for r in vector.nearest(df, "v", points[i][1], 10, "id").collect()}
        found += len(exact & {r.key for r in index.search(points[i][1], 10).collect()})
    assert found >= 90
    whole = index.search(points[3][1], 10, probes=10_000).collect()
    assert {r.key for r in whole} == {r.id for r in vector.nearest(df, "v", points[3][1], 10, "id").collect()}


def test_texts_with_a_word_inside_others_are_not_cut(spark):
    texts = ["3", "a3 3b 33", "x-3.5", "\u00e93", "3\u00e9", "3_", "33 3", "13-3", None, "\U0001d4b3 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    term = fulltext.Term(("3",))
    assert [r.id for r in df.filter(fulltext.stands(fulltext.lowered(F.col("text")), term)).orderBy("id").collect()] == [0, 2, 6, 7, 9]
    assert sorted(r.id for r in fulltext.search(df, F.col("text"), "3").collect()) == [0, 2, 6, 7, 9]


def test_postings_are_counted_where_the_text_is(spark, tmp_path, monkeypatch):
    """One block for each term and deal of a task's texts, not a row for each term of each text, with the tokens of the texts."""
    from heliograph.sources import indexes

    texts = ["ab", "cd", "", None, "ab cd", "Straße—Été", "é \U0001f600ab", "a_b-12 ٣", "x", "İx", "--", "日本 ab。cd", "\x00ab\x7fcd"]
    df = spark.createDataFrame([(f"k{i}", texts[i % len(texts)]) for i in range(1300)], "id string, text string").coalesce(1)
    plain = df.select("id", F.size(fulltext.tokens(fulltext.lowered(F.col("text")))).alias("n"), F.explode(fulltext.tokens(fulltext.lowered(F.col("text")))).alias("term"))
    expected = sorted((r.term, r.id, r["count"], r.n) for r in plain.groupBy("term", "id", "n").count().collect())
    for size in (indexes.BLOCK, 100):
        monkeypatch.setattr(indexes, "BLOCK", size)
        index = indexes.TextIndex(spark, str(tmp_path / str(size))).build(df, "id", F.col("text"), 4)
        stored = spark.read.parquet(f"{index.path}/postings")
        assert sorted(tuple(r) for r in stored.select("term", F.inline("rows")).select("term", "key", "tf", "n").collect()) == expected
        if size > 100:
            assert stored.count() <= len({t for t, *_ in expected}) * indexes.DEALS < len(expected)
