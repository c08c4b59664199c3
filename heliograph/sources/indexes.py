"""Search indexes as tables of their own: postings of terms, and cells of vectors. A search reads what it needs of them."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import fulltext, vector


#: Bytes of texts whose postings are put together, about.
BLOCK = 24 << 20
#: Tasks among which a bucket of terms is dealt, by the key.
DEALS = 8


def blocks(kind: str):
    """(part, schema): from rows (key, deal, text) the blocks (term, deal, total, rows), one for each term and deal of about BLOCK bytes.

    text is as fulltext.separated() leaves it. rows: (key, tf, n) of each text with the term; total: the sum of their
    tf. A text's tokens are at hand together, so frequencies are counted where the text is and only blocks are shuffled.
    """
    table = np.zeros(256, bool)
    table[sorted(fulltext.TOKEN_BYTES)] = True

    def part(batches):
        import pyarrow as pa

        def cut(texts):
            """The tokens of the texts in a row, and how many each has."""
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            inside = table[raw]
            before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
            before[ends[:-1][ends[:-1] < len(raw)]] = False  # no token crosses texts
            after[ends[1:][ends[1:] > 0] - 1] = False
            first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
            stops = np.r_[0, np.cumsum(last - first + 1)].astype(np.int32)
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(stops), pa.py_buffer(raw[inside]))
            return words, np.diff(np.searchsorted(first, ends))

        def block(held):
            keys, deals, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            words, n = cut(texts)
            if not len(words):
                return
            words, deals = words.dictionary_encode(), deals.to_numpy()
            # one number for each token, in the order of terms, deals and texts
            by = np.argsort(deals, kind="stable")
            place = np.empty(len(n), np.int64)
            place[by] = np.arange(len(n))
            code = np.sort(words.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(place, n))
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            tf = np.diff(np.r_[heads, len(code)])
            term, text = np.divmod(code[heads], len(n))
            text = by[text]
            deal = deals[text]
            starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (deal[1:] != deal[:-1])])
            rows = pa.StructArray.from_arrays([keys.take(pa.array(text)), pa.array(tf, pa.int32()), pa.array(n[text], pa.int32())], ["key", "tf", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(term)], pa.int32()), rows)
            out = [words.dictionary.take(pa.array(term[starts])), pa.array(deal[starts], pa.int32()), pa.array(np.add.reduceat(tf, starts), pa.int64()), lists]
            whole = pa.RecordBatch.from_arrays(out, ["term", "deal", "total", "rows"])
            yield from (whole.slice(at, 50_000) for at in range(0, len(whole), 50_000))

        held, size = [], 0
        for some in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            texts = some["text"].cast(pa.string())
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            held.append((some["key"], some["deal"], texts))
            size += int(ends[-1] - ends[0])
            if size >= BLOCK:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    return part, f"term string, deal int, total long, rows array<struct<key:{kind},tf:int,n:int>>"


class TextIndex:
    """Postings (bucket, term, total, rows) under a folder, by buckets of terms and sorted by term within them; rows hold (key, tf, n).

    A search for terms reads their buckets alone, and of their files the parts that may hold the terms. Numbers of
    rows and the mean length are kept beside the postings, document frequencies are counted from what is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, key: str, text, buckets: int = 64) -> TextIndex:
        """Index every row of df. A null text has no terms, but counts as a row, as in a search without an index."""
        rows = df.select(F.col(key).alias("key"), F.pmod(F.xxhash64(F.col(key)), F.lit(DEALS)).cast("int").alias("deal"), fulltext.lowered(text).alias("text"))
        rows = rows.withColumn("text", fulltext.separated(F.col("text")))
        postings = rows.mapInArrow(*blocks(rows.schema["key"].dataType.simpleString()))
        postings = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # a frequent term goes to several tasks, by its key
        dealt = postings.repartition("bucket", "deal").sortWithinPartitions("bucket", "term").drop("deal")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        docs = df.count()
        total = self.spark.read.schema("total long").parquet(f"{self.path}/postings").agg(F.sum("total")).first()[0] or 0
        facts = self.spark.createDataFrame([(docs, total / docs if docs else 0.0, buckets)], "docs long, mean double, buckets int")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/facts")
        return self

    def search(self, query: str, minimum_score: float | None = None) -> DataFrame:
        """(key, __score__) of the rows that match, scored as fulltext.search does. Phrases need the texts and are refused."""
        node = fulltext.parsed(query)
        scoring, every = fulltext.terms(node), fulltext.all_terms(node)
        if any(len(t.words) > 1 for t in every):
            raise ValueError("a phrase can't be answered from postings")
        facts = self.spark.read.parquet(f"{self.path}/facts").first()
        postings = self.spark.read.parquet(f"{self.path}/postings")
        plain = sorted({t.words[0] for t in every if not t.pattern})
        wanted = F.col("term").isin(plain) if plain else F.lit(False)
        if plain and not any(t.pattern for t in every):
            own = self.spark.createDataFrame([(w,) for w in plain], "w string").select(F.pmod(F.xxhash64("w"), F.lit(facts["buckets"])).cast("int")).distinct()
            wanted = wanted & F.col("bucket").isin([r[0] for r in own.collect()])  # as many as the query has terms
        for t in every:
            if t.pattern:
                wanted = wanted | F.col("term").rlike(fulltext.wildcard(t.words[0]))
        of = [F.col("term").rlike(fulltext.wildcard(t.words[0])) if t.pattern else F.col("term") == t.words[0] for t in every]
        rows = postings.filter(wanted).select("term", F.inline("rows")).groupBy("key").agg(F.first("n").alias("_n"), *[F.coalesce(F.sum(F.when(x, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, x in enumerate(of)])
        counts = rows.agg(*[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(every))]).first() if every else {}
        score, mean = F.lit(0.0), max(float(facts["mean"]), 1e-9)
        for i, t in enumerate(every):
            if t in scoring:
                tf, d = F.col(f"_tf{i}").cast("double"), float(counts[f"d{i}"] or 0)
                idf = math.log(1.0 + (facts["docs"] - d + 0.5) / (d + 0.5))
                score = score + F.lit(idf) * tf * (fulltext.K1 + 1) / (tf + fulltext.K1 * (F.lit(1 - fulltext.B) + fulltext.B * F.col("_n") / F.lit(mean)))
        found = rows.filter(fulltext.matches(node, lambda t: F.col(f"_tf{every.index(t)}") > 0)).select("key", score.alias("__score__"))
        return found.filter(F.col("__score__") >= minimum_score) if minimum_score is not None else found


class VectorIndex:
    """Vectors under a folder by cells: each row is in the cell of its nearest centre, and a search reads the cells nearest to it.

    Centres are fitted on a sample of about `sample` rows, twice as many at most, chosen by a hash of the key; every
    row is indexed. How many cells a search reads is measured on the sample: as many as hold the share `recall` of
    the ten nearest neighbours that brute force finds there. Neighbours in the whole table are nearer than those.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, key: str, attribute: str, cells: int | None = None, sample: int = 20_000, rounds: int = 10, recall: float = 0.96) -> VectorIndex:
        """Index every row whose vector is there and as long as most are; cells: by default the root of the number of rows, 1,024 at most."""
        rows = df.select(F.col(key).alias("key"), F.transform(attribute, lambda c: c.cast("double")).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        if sizes is None:
            raise ValueError("no vector to index")
        rows = rows.filter(F.size("v") == sizes["d"])
        share = min(1.0, sample / sizes["count"])
        drawn = rows.filter(F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * sample).collect()
        points = unit(np.array([r["v"] for r in drawn]).reshape(-1, sizes["d"]) if drawn else np.zeros((1, sizes["d"])))
        number = min(len(points), cells or max(1, min(1024, math.isqrt(sizes["count"]))))
        rng = np.random.default_rng(0)
        centres = points[rng.choice(len(points), number, replace=False)]
        for _ in range(rounds):
            nearest = (points @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, points)
            empty = np.bincount(nearest, minlength=number) == 0
            sums[empty] = centres[empty]
            centres = unit(sums)
        cell = (points @ centres.T).argmax(1)
        asked = points[rng.choice(len(points), min(len(points), 256), replace=False)]
        close = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :10]
        rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell for each query
        probes = int(np.quantile(np.take_along_axis(rank, cell[close], axis=1), recall, method="higher")) + 1
        names = [*rows.columns, "cell"]

        def part(batches):
            import pyarrow as pa

            for batch in batches:
                if len(batch):
                    v = np.array(batch["v"].to_pylist())
                    yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array((unit(v) @ centres.T).argmax(1), pa.int32())], names)

        kind = rows.schema["key"].dataType.simpleString()
        placed = rows.mapInArrow(part, f"key {kind}, v array<double>, cell int")
        # a large cell goes to several tasks, by its key
        placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        self.spark.createDataFrame([(json.dumps(centres.tolist()), probes)], "centres string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(key, __score__) of the k largest cosines in the `probes` cells nearest to the query; by default as many as were measured."""
        made = self.spark.read.parquet(f"{self.path}/centres").first()
        centres, probes = np.array(json.loads(made["centres"])), probes or made["probes"]
        near = np.argsort(-(centres @ unit(np.array([query], float))[0]), kind="stable")[:probes]
        rows = self.spark.read.parquet(f"{self.path}/cells").filter(F.col("cell").isin(near.tolist())).select("key", "v")
        return vector.nearest(rows, "v", query, k, "key").select("key", "__score__")


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)
