import pytest

from tests.llm.cases import documents, frame
from tests.llm.test_decontam import brute as contamination
from tests.llm.test_neardup import brute as groups
from tests.llm.test_packing import check

pipeline = pytest.importorskip("corpus_pipeline")


def test_against_brute_force(spark, tmp_path):
    from heliograph.llm import pii

    rows = [(i, t, lang) for i, t, lang in documents(5) if i is not None]
    rows += [(5000, "write to someone@example.org or call +1 555 010 9999 about the morning light", "en")]
    items = [(1, " ".join(rows[2][1].split()[:14]))]
    folder = str(tmp_path / "sf")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = pipeline.run(spark, folder).collect()
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    own = groups(left, 5)
    left = [r for r in left if own[r[0]][2]]
    bad = {r[0] for r in contamination(left, items) if r[5]}
    assert bad
    left = [(i, pii.redact(t)) for i, t, _ in left if i not in bad]
    assert {r.doc_id for r in out} == {i for i, _ in left}
    check(out, left)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect() == []


def write(spark, folder, rows, items):
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_a_missing_language_is_filled_in(spark, tmp_path):
    rows = [r for r in documents(6, 60)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id: r.lang for r in pipeline.language(spark, docs, "").collect()}
    for i, text, lang in rows:
        if not text or not any(c.isalpha() for c in text):
            assert i not in kept
        else:
            assert kept[i] == lang or lang is None and kept[i] in ("en", "fr")
    assert any(lang is None and i in kept for i, _, lang in rows)


def test_null_and_repeated_ids_and_nothing(spark, tmp_path):
    rows = documents(7)
    rows += [(None, "another text that has no number but words enough", "en"), rows[0], rows[0]]
    write(spark, tmp_path / "some", rows, [(1, " ".join(rows[2][1].split()[:14])), (None, None)])
    out = pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sum(r.doc_id is None for r in out) == 2
    write(spark, tmp_path / "none", [], [])
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []
