"""A corpus pipeline: language ID, near-dedup, benchmark decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import decontam, langid, neardup, packing, pii
from heliograph.llm.common import read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go; a null lang becomes the predicted one.

    Trained as the query of operator 2, so where no row has a lang nothing can be told and nothing stays.
    Rows are judged one by one, also those with a null or repeated id.
    """
    found = langid.identify(docs, langid.trained_on(docs))
    found = found.filter(found["lang_pred"] != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8), the one with the smallest doc_id; rows with a null id stay."""
    return neardup.deduplicated(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of the benchmark, whatever their ids."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids under the limits of operator 8's query; each row gives its pieces, also those with a null id."""
    return packing.pack(packing.pieces(docs, ranked=True), **packing.LIMITS)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("pack", pack)]

#: SQL has no tokenizer and no trained model; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the session names for shared files; its warehouse where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; once a stage is written, what the one before it wrote goes."""
    folder, docs, before = shared_folder(spark), read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
