"""Nearest vectors by cosine, exactly, with optional 8- or 4-bit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = {"INT8": 127, "INT4": 7}


def normalised(x: Column) -> Column:
    """x by its length, as array<double>; a vector of length 0 stays as it is."""

    def divided(s):  # the length is computed once a vector, not once a component
        return F.when(s["length"] > 0, F.transform(s["x"], lambda c: c.cast("double") / s["length"])).otherwise(F.transform(s["x"], lambda c: c.cast("double")))

    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), length_of(x).alias("length"))), divided), 1)


def length_of(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def quantised(x: Column, kind: str) -> Column:
    """Components of a normalised vector as whole numbers of the kind's range."""
    level = float(LEVELS[kind])
    return F.transform(x, lambda c: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) * level).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, c: s + c)


def cosine(x: Column, query: list[float], quantization: str = "NONE") -> Column:
    """Cosine of x and the query; null where x is null or has another dimension."""
    length = sum(float(c) ** 2 for c in query) ** 0.5
    unit = [float(c) / length if length else float(c) for c in query]
    same = F.size(x) == len(unit)
    if quantization == "NONE":
        size = length_of(x)
        product = dot(x, F.array(*[F.lit(c) for c in unit]))
        score = F.when(size > 0, product / size).otherwise(product)
    else:
        level = LEVELS[quantization]
        whole = [int(max(-1.0, min(1.0, c)) * level + (0.5 if c >= 0 else -0.5)) for c in unit]
        score = dot(quantised(normalised(x), quantization), F.array(*[F.lit(c) for c in whole])) / F.lit(float(level * level))
    return F.when(same, score)


def nearest(df: DataFrame, attribute: str, query: list[float], k: int, key: str, minimum_score: float = -1.0, quantization: str = "NONE") -> DataFrame:
    """The k rows of the largest cosine with __score__, ties to the smaller key; a minimum under 0 is off.

    The plan keeps k rows a partition and merges those, so no shuffle carries the table.
    """
    scored = df.withColumn("__score__", cosine(F.col(attribute), query, quantization)).filter(F.col("__score__").isNotNull())
    if minimum_score > 0:
        scored = scored.filter(F.col("__score__") >= minimum_score)
    return scored.orderBy(F.col("__score__").desc(), F.col(key)).limit(k)


def nearest_each(df: DataFrame, attribute: str, query: list[float], k: int, key: str, partition: str, minimum_score: float = -1.0) -> DataFrame:
    """The k best rows of each partition value: group limits before the shuffle, ranks after it."""
    from pyspark.sql import Window

    scored = df.withColumn("__score__", cosine(F.col(attribute), query)).filter(F.col("__score__").isNotNull())
    if minimum_score > 0:
        scored = scored.filter(F.col("__score__") >= minimum_score)
    place = F.row_number().over(Window.partitionBy(partition).orderBy(F.col("__score__").desc(), key))
    return scored.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
