"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood and verified on full sets.

A document's sketch has REGISTERS registers. Register i holds the least of exponential values of the
document's shingles under hash i, on an exponentially spaced scale and cut to a range:
K = 1 - floor-ish log to BASE of the minimum. Sketches of parts merge by the larger register. Two sketches
agree in a register with about the chance of the Jaccard similarity, so ROWS registers make one band key,
and documents with a common key become candidates: at a similarity of 0.8 all BANDS keys differ with a
chance of 1e-7.

Documents with equal sets form classes first, so copies cost nothing further. In each bucket of a band key
every class is paired with one pivot only, not with all: the class that shares the most buckets with others,
which in a family of copies is the one closest to them all, and the same one in most buckets. Pairs whose joint maximum-likelihood similarity is
far too low are left; the rest are verified on full sets. Where a bucket still holds several components, its
classes outside the largest one meet all classes of other components in that bucket, so no link that the
bands have found is lost. They meet inside a join whose condition compares bitmaps of their shingles: a bit
that one has and the other lacks is a shingle less in common, so a pair passes if it may reach the threshold
and is dropped only if it can't. Components come from labels that spread along links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import byte_view, durable, lean, modest, read, release, runs
from heliograph.llm.shingles import Words, mix, sets

BANDS, ROWS, BASE, RATE = 40, 5, 1.001, 20.0
REGISTERS = BANDS * ROWS
#: Pairs are left unverified if their estimate is under the threshold by more than this (5 standard deviations).
MARGIN = 0.16
#: 64-bit words of a bitmap.
BITMAP = 32
_U = np.uint64
_RNG = np.random.default_rng(55)
_XOR, _TIMES = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64), _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)


def sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each non-empty set that begins at starts."""
    least = np.empty((REGISTERS, len(starts)), np.uint64)
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat((shingles ^ _XOR[i]) * _TIMES[i], starts)
    x = -np.log1p(-(least.T.astype(np.float64) + 1) / (2.0**64 + 4096)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of the sets of two sketches."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of sketches (rows), given the sizes of their sets."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    value = more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(j, value.argmax(1)[:, None], 1)[:, 0]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, 128-bit digest and sketch of each row's set of n-word shingles."""

    def part(batches):
        import pyarrow as pa

        hasher = Words()
        for batch in batches:
            data, offsets = byte_view(batch["text"])
            for start, stop in runs(offsets, 1 << 18):
                o = offsets[start : stop + 1] - offsets[start]
                shingles, at = sets(*hasher(data[offsets[start] : offsets[stop]], o), stop - start, n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                d = np.zeros((2, len(size)), np.uint64)
                sketch = np.zeros((len(size), REGISTERS), np.uint16)
                if len(full):
                    d[0, full] = np.add.reduceat(mix(shingles), at[full])
                    d[1, full] = np.add.reduceat(mix(shingles ^ _XOR[0]), at[full])
                    sketch[full] = sketches(shingles, at[full])
                raw = [s.tobytes() for s in sketch]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start).cast(pa.int64()), pa.array(size), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(raw, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(part), "doc_id long, n long, d1 long, d2 long, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id): BANDS rows a class."""

    def part(batches):
        import pyarrow as pa

        salts = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
        for batch in batches:
            if not len(batch):
                continue
            k = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = mix(mix(k + salts).sum(2))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch["id"].to_numpy(), BANDS))], ["key", "id"])

    return classes.select("id", "sketch").mapInArrow(lean(part), "key long, id long")


def plausible(pairs: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose likeliest similarity is not far below it."""
    left = info.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    right = info.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    joined = pairs.join(left, "b").join(right, "a").filter(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                k = [np.frombuffer(b"".join(some[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s_a", "s_b")]
                ok = likeliest(*k, some["n_a"].to_numpy().astype(float), some["n_b"].to_numpy().astype(float)) >= threshold - MARGIN
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (some["a"], some["b"])], ["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(lean(part), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, n, bits, set, w0 ...): sorted 64-bit shingles as bytes, their number, and their bitmap with the number of its bits, of the wanted documents."""
    names = ["id", "n", "bits", "set", *[f"w{i}" for i in range(BITMAP)]]

    def part(batches):
        import pyarrow as pa

        hasher = Words()
        for batch in batches:
            data, offsets = byte_view(batch["text"])
            for start, stop in runs(offsets, 1 << 18):
                o = offsets[start : stop + 1] - offsets[start]
                shingles, at = sets(*hasher(data[offsets[start] : offsets[stop]], o), stop - start, n)
                raw = [shingles[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                bits = np.zeros((stop - start, 64 * BITMAP), bool)
                bits[np.repeat(np.arange(stop - start), np.diff(at)), (mix(shingles) % _U(64 * BITMAP)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1).view(np.int64)
                ids = batch["doc_id"].slice(start, stop - start).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(bits.sum(1)), pa.array(raw, pa.binary()), *[pa.array(np.ascontiguousarray(w)) for w in words.T]], names)

    return docs.select("doc_id", "text").join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(lean(part), "id long, n long, bits long, set binary" + "".join(f", w{i} long" for i in range(BITMAP)))


def may_reach(percent: int) -> Column:
    """Whether the pair (x, y) may reach the threshold, by sizes nx, ny and bitmaps x0 ..., y0 ... of bx, by bits: never false for one that does."""
    shared = sum((F.bit_count(F.col(f"x{i}").bitwiseAND(F.col(f"y{i}"))) for i in range(BITMAP)), F.lit(0))
    common = F.least(F.col("nx") - F.col("bx"), F.col("ny") - F.col("by")) + shared  # each bit that the other lacks is a shingle less
    return common * (100 + percent) >= F.lit(percent) * (F.col("nx") + F.col("ny"))


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    left = shingles.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    right = shingles.select(F.col("id").alias("a"), F.col("set").alias("set_a"))

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    return pairs.join(left, "b").join(right, "a").select("a", "b", "set_a", "set_b").mapInArrow(lean(part), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each linked id.

    Each round takes the least label among neighbours and then the label of that label, until none changes.
    Every round is checkpointed, so lost executors cost one round at most.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        step = durable(step)
        labels = step.select("id", "component")
        if step.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text; more columns are ignored).

    n: words of a shingle; percent: least Jaccard similarity. A null text, or one without words, has an
    empty set and stays by itself. A null doc_id is linked with nothing, has no component and is kept. Rows
    that repeat a doc_id are each given the component of their own text's class.
    """
    modest(docs.sparkSession)
    base = durable(signatures(docs, n))
    keyed = base.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = durable(keyed.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "sketch")).alias("r")).select("d1", "d2", "n", F.col("r.doc_id").alias("id"), F.col("r.sketch").alias("sketch")))
    bands = band_keys(classes)
    buckets = durable(bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("p"), F.max("id").alias("q")).filter(F.col("p") < F.col("q")).select("key", "m"))
    members = durable(bands.join(buckets, "key"))
    weights = members.groupBy("id").agg(F.sum("m").alias("weight"))
    best = F.max(F.struct(F.col("weight"), (-F.col("id")).alias("minus"))).alias("best")
    pivots = durable(members.join(weights, "id").groupBy("key").agg(best).select("key", (-F.col("best.minus")).alias("pivot")))
    pairs = members.join(pivots, "key").filter(F.col("pivot") != F.col("id"))
    pairs = durable(pairs.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct())
    shingles = durable(full_sets(docs, members.select("id").distinct(), n))
    first = durable(verified(plausible(pairs, classes, percent / 100), shingles, percent))
    labels = components(first)

    release(docs.sparkSession)

    placed = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("t"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    mixed = durable(mixed.select("key", F.col("t.component").alias("largest")))
    placed = placed.join(mixed, "key").join(pivots, "key").filter(F.col("id") != F.col("pivot"))  # a pivot has met them all
    placed = durable(placed.drop("pivot").join(shingles.drop("set"), "id"))
    side = lambda s: [F.col("id").alias(s), F.col("component").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"), *[F.col(f"w{i}").alias(f"{s}{i}") for i in range(BITMAP)]]
    apart = placed.filter(F.col("component") != F.col("largest")).select("key", *side("x"))
    across = apart.join(placed.select(F.col("key").alias("_key"), *side("y")), (F.col("key") == F.col("_key")) & (F.col("cx") != F.col("cy")) & may_reach(percent))
    more = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    second = durable(verified(more, shingles, percent))
    if not second.isEmpty():
        labels = components(first.union(second))

    of_class = classes.select("d1", "d2", "n", "id").join(labels, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    found = base.select("doc_id", "n", "d1", "d2").join(durable(of_class), ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group of near copies, the one with the smallest doc_id."""
    gone = near_duplicates(docs, n, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(durable(gone), "doc_id", "left_anti").select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents` on 2-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), n=2)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n m ON m.doc_id = p.a JOIN n o ON o.doc_id = p.b WHERE 100 * k >= 80 * (m.n + o.n - k)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), c AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
