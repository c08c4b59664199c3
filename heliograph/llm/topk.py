"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are dealt by length into range partitions, and each `BUCKET` vectors of a partition, sorted from the
longest down, are one bucket of nearly equal lengths. A query's k-th best score so far, divided by its own
length and by the bucket's longest length, is the cosine that a vector of the bucket must reach. From that
local threshold each query picks its pruning in each bucket: none left (threshold over 1: the bucket is
skipped), coordinates (high threshold: a few of the query's largest coordinates bound those of any
partner), or length (low threshold: only the bucket's longest vectors can reach the score). All survivors
are verified by exact integer products.

Queries go in blocks of about `block` rows. Where there are several, each is searched, its results written and
its broadcast released before the next, so the driver and the executors hold one block at a time; the number
of passes, not the size of a broadcast, grows with the queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import durable, lean, read

#: Local cosine from which coordinates prune, coordinates looked at, seeds for the first thresholds.
COORDINATES_FROM, FOCUS, SEEDS = 0.75, 4, 1024
#: Vectors of a bucket.
BUCKET = 4096


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(key, v array<bigint>, norm): floor(scale * x) of each component as double.

    Rows without a key, and vectors that are null or hold a null, NaN or infinite component, are left out.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    df = df.filter(F.col(key).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(key).alias("key"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return df.withColumn("norm", F.sqrt(square))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products as int64: by float64 where every partial sum is below 2**53, else by integers."""
    largest = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    if float(largest) ** 2 * max(1, vectors.shape[1]) < 2.0**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Best:
    """The k best of each query so far, ties to the smaller key, and the score that a newcomer must reach."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = ids, k, least.copy()
        self.rows = np.zeros((3, 0), np.int64)  # query position, score, key

    def add(self, position: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        ok = (score >= self.least[position]) & (key != self.ids[position])
        rows = np.concatenate([self.rows, np.stack([position[ok], score[ok], key[ok]])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        self.rows = rows = rows[:, place < self.k]
        kth = place[place < self.k] == self.k - 1
        np.maximum.at(self.least, rows[0][kth], rows[1][kth])


def search_bucket(q: np.ndarray, lengths: np.ndarray, best: Best, keys: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
    """One bucket, sorted by falling norm, against one block of queries of the same dimension."""
    longest = norms[0] if len(norms) else 0.0
    least = best.least.astype(np.float64)
    bound = lengths * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least <= 0, -1.0, np.where(bound > 0, least / bound, np.inf))
    cosine = np.where(best.least == np.iinfo(np.int64).min, -1.0, cosine)
    alive = cosine <= 1 + 1e-9
    by_coordinate = alive & (cosine >= COORDINATES_FROM)
    by_length = np.flatnonzero(alive & ~by_coordinate)
    for start in range(0, len(by_length), 512):
        part = by_length[start : start + 512]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((least[part] <= 0) | (lengths[part] == 0), -1.0, least[part] / lengths[part] * (1 - 1e-9))
        reach = int(np.searchsorted(-norms, -need.min(), "right"))  # the longest ones that any of these needs
        scores = products(q[part], v[:reach])
        floor = best.least[part]
        if reach > 8 * best.k:
            own = scores.copy()
            own[keys[:reach][None, :] == best.ids[part][:, None]] = np.iinfo(np.int64).min
            floor = np.maximum(floor, np.partition(own, reach - best.k, axis=1)[:, reach - best.k])
        i, j = np.nonzero(scores >= floor[:, None])
        best.add(part[i], scores[i, j], keys[:reach][j])
    if by_coordinate.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(norms[:, None] > 0, v / norms[:, None], 0.0)
        order: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in np.flatnonzero(by_coordinate):
            direction = q[p] / lengths[p]
            angle = np.arccos(min(1.0, best.least[p] / bound[p]))
            left = None
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                if f not in order:
                    rank = np.argsort(unit[:, f], kind="stable")
                    order[f] = (unit[rank, f], rank)
                own = np.arccos(np.clip(direction[f], -1, 1))
                low = np.cos(min(np.pi, own + angle)) - 1e-9
                high = np.cos(max(0.0, own - angle)) + 1e-9
                values, rank = order[f]
                if left is None:
                    left = rank[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]
                else:
                    left = left[(unit[left, f] >= low) & (unit[left, f] <= high)]
            if len(left):
                best.add(np.full(len(left), p), products(q[p : p + 1], v[left])[0], keys[left])


def by_dimension(keys: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, tuple[list, list]] = {}
    for key, v in zip(keys, vectors, strict=True):
        a, b = found.setdefault(len(v), ([], []))
        a.append(key)
        b.append(v)
    return {d: (np.array(a, np.int64), np.array(b, np.int64).reshape(len(a), d)) for d, (a, b) in found.items()}


def buckets(batches, size: int = BUCKET):
    """(keys, vectors) of each `size` rows in order, whatever the batches hold."""
    keys, vectors = [], []
    for batch in batches:
        keys += batch["key"].to_pylist()
        vectors += batch["v"].to_pylist()
        while len(keys) >= size:
            yield keys[:size], vectors[:size]
            keys, vectors = keys[size:], vectors[size:]
    if keys:
        yield keys, vectors


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query, ties to the smaller key.

    candidates, queries: (key, v, norm) as from quantised(). A candidate with the query's own key is left
    out; only vectors of the same number of components are compared. Rows that repeat a key: each candidate
    row counts, and queries with one key share their k places, whatever row asks. Queries with fewer than k
    partners get all they have; empty tables give no rows.
    """
    spark = candidates.sparkSession
    queries = queries.select("key", "v")
    n = queries.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        queries = durable(queries)
    ranged = candidates.repartitionByRange(F.col("norm").desc(), F.col("key")).sortWithinPartitions(F.col("norm").desc())
    if blocks > 1:
        ranged = durable(ranged)
    seeds = candidates.orderBy(F.col("norm").desc(), "key").limit(SEEDS).collect()
    seeds = by_dimension([r.key for r in seeds], [r.v for r in seeds])
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("key", "v"), F.lit(blocks)) == b).collect()
        asked = {}
        for d, (ids, q) in by_dimension([r.key for r in rows], [r.v for r in rows]).items():
            least = np.full(len(ids), np.iinfo(np.int64).min)
            if d in seeds:
                keys, v = seeds[d]
                for start in range(0, len(ids), 1024):
                    scores = products(q[start : start + 1024], v)
                    scores[keys[None, :] == ids[start : start + 1024, None]] = np.iinfo(np.int64).min
                    if len(keys) >= k:
                        least[start : start + 1024] = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
            asked[d] = (ids, q, least)
        shared = spark.sparkContext.broadcast(asked)

        def part(batches, shared=shared, k=k):
            import pyarrow as pa

            state = {d: (q, np.sqrt((q.astype(np.float64) ** 2).sum(1)), Best(ids, k, least)) for d, (ids, q, least) in shared.value.items()}
            for keys, vectors in buckets(batches):
                for d, (keys, v) in by_dimension(keys, vectors).items():
                    if d in state:
                        norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                        rank = np.argsort(-norms, kind="stable")
                        search_bucket(*state[d], keys[rank], v[rank], norms[rank])
            for _, _, best in state.values():
                position, score, key = best.rows
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[position]), pa.array(key), pa.array(score)], ["query_id", "vec_id", "score"])

        some = ranged.mapInArrow(lean(part), "query_id long, vec_id long, score long")
        if blocks > 1:
            some = durable(some)
            shared.destroy()
        found = some if found is None else found.unionByName(some)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50, against all other rows of `embeddings`; k = 5."""
    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("key") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
