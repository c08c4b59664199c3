"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order tree of byte contexts (orders 3 to 0). A byte's code length comes from
the longest context that the language has seen: with count c of n and d different successors it costs
-log2(c / (n + d)); an unseen byte first costs the escape -log2(d / (n + d)) and is then coded in the next
shorter context, down to a uniform code over the 256 bytes. The statistics are frozen after training, so a
text's code length is a sum of table entries. The trees of all languages are held in sorted sparse tables
that have every context and successor of the sample: four bytes that some language has seen have their code
lengths under all languages in a row; of others the escape of the context is added to what their last three
bytes cost, and so on. The tables are bounded by the sample alone.

Training reads whole texts of a bounded sample: about `sample_docs` of each language, chosen by a hash of
the key, the same at every input size. Prediction reads every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import byte_view, lean, modest, read, remainder, runs

SAMPLE_DOCS, ORDER = 1500, 3
UNDETERMINED = "und"


def gram_counts(batches):
    """Counts of each four bytes (three bytes of context and the next one) by language."""
    import pyarrow as pa

    totals: dict[str, dict] = {}
    for batch in batches:
        data, offsets = byte_view(batch["text"])
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(langs == lang)
            parts = []
            for i in mine:
                b = np.concatenate([np.full(ORDER, 10, np.uint8), data[offsets[i] : offsets[i + 1]]]).astype(np.uint32)
                parts.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            own = totals.setdefault(lang, {})
            for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                own[key] = own.get(key, 0) + n
    for lang, own in totals.items():
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def place_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values stand in the sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def flatten(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """The model: languages, and for each of them the bits of bytes and of escapes.

    four, bits4: all four bytes that a language has seen and their code lengths; three, bits3: the same of the
    last three bytes of those; context, escape3: contexts of three bytes and the bits of leaving them; escape2:
    of leaving a context of two bytes (0 where a language has not seen it); bits1: code lengths in a context of
    one byte. Rows of bits have a column for each language.
    """
    langs = sorted(counts)
    grams = {lang: (keys.astype(np.uint32), n) for lang, (keys, n) in counts.items()}
    four = np.unique(np.concatenate([g for g, _ in grams.values()]))
    three, context = np.unique(four & np.uint32(0xFFFFFF)), np.unique(four >> np.uint32(8))
    model = {"langs": langs, "four": four, "three": three, "context": context}
    shapes = {"bits4": len(four), "bits3": len(three), "escape3": len(context), "escape2": 1 << 16, "bits1": 1 << 16}
    model |= {name: np.zeros((rows, len(langs)), np.float32) for name, rows in shapes.items()}

    def escape(c: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """n + d of each context, and the probability of leaving it (1 where it has not been seen)."""
        n = np.bincount(of, c, size) + np.bincount(of, c > 0, size)
        return n, np.where(n > 0, np.bincount(of, c > 0, size) / np.maximum(n, 1), 1.0)

    for j, lang in enumerate(langs):
        keys, n = grams[lang]
        c0 = np.bincount(keys & 255, n, 256)
        p0 = np.where(c0 > 0, c0, (c0 > 0).sum() / 256) / (c0.sum() + (c0 > 0).sum())
        c1 = np.bincount(keys & 0xFFFF, n, 1 << 16)
        before = np.arange(1 << 16) >> 8
        whole, leave = escape(c1, before, 256)
        p1 = np.where(c1 > 0, c1 / np.maximum(whole[before], 1), leave[before] * np.tile(p0, 256))
        c2 = np.bincount(np.searchsorted(three, keys & np.uint32(0xFFFFFF)), n, len(three))
        before = (three >> 8).astype(np.int64)
        whole, leave = escape(c2, before, 1 << 16)
        model["escape2"][:, j] = -np.log2(leave)
        p2 = np.where(c2 > 0, c2 / np.maximum(whole[before], 1), leave[before] * p1[three & 0xFFFF])
        c3 = np.bincount(np.searchsorted(four, keys), n, len(four))
        before = np.searchsorted(context, four >> np.uint32(8))
        whole, leave = escape(c3, before, len(context))
        model["escape3"][:, j] = -np.log2(leave)
        p3 = np.where(c3 > 0, c3 / np.maximum(whole[before], 1), leave[before] * p2[np.searchsorted(three, four & np.uint32(0xFFFFFF))])
        model["bits1"][:, j], model["bits3"][:, j], model["bits4"][:, j] = -np.log2(p1), -np.log2(p2), -np.log2(p3)
    return model


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Model from (key, text, lang) rows; rows with a null text or lang are ignored. No rows: no model.

    sample_docs bounds the sample: documents of each language are kept with the probability that gives
    about that many, by a hash of the key; all, where a language has fewer.
    """
    modest(labelled.sparkSession)
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["count"])))])
    hashed = F.pmod(F.xxhash64(F.col("key"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(hashed < part[F.col("lang")]).select("text", "lang")
    grams = sample.mapInArrow(lean(gram_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toPandas()  # bounded by the sample
    counts = {lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for lang, g in table.groupby("lang")}
    return flatten(counts) if counts else None


def bits_of(model: dict, grams: np.ndarray) -> np.ndarray:
    """Bits of the last of each four bytes after the other three, under each language (columns)."""
    at, seen = place_of(model["four"], grams)
    out = model["bits4"].take(at, axis=0) if len(model["four"]) else np.zeros((len(grams), len(model["langs"])), np.float32)
    new = np.flatnonzero(~seen)
    if len(new):
        rest = grams[new]
        last = (rest & np.uint32(0xFFFFFF)).astype(np.uint32)
        at, seen = place_of(model["three"], last)
        shorter = model["escape2"][last >> 8] + model["bits1"][last & 0xFFFF]
        shorter[seen] = model["bits3"][at[seen]]
        at, seen = place_of(model["context"], rest >> np.uint32(8))
        shorter[seen] += model["escape3"][at[seen]]
        out[new] = shorter
    return out


def code_lengths(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    out = np.zeros((len(offsets) - 1, len(model["langs"])))
    for start, stop in runs(offsets, 1 << 18):
        o = offsets[start : stop + 1] - offsets[start]
        filled = np.flatnonzero(o[1:] > o[:-1])
        for part in range(0, int(o[-1]), 1 << 20):  # a text longer than a run goes by parts
            b = data[offsets[start] + part : offsets[start] + min(int(o[-1]), part + (1 << 20))].astype(np.uint32)
            early = data[offsets[start] + max(0, part - ORDER) : offsets[start] + part].astype(np.uint32)
            padded = np.concatenate([np.full(ORDER - len(early), 10, np.uint32), early, b])
            before = [padded[ORDER - k : len(padded) - k].copy() for k in (1, 2, 3)]
            heads = o[:-1][filled] - part
            for k, x in zip((1, 2, 3), before, strict=True):
                for step in range(k):  # a text's first bytes have line ends before them, not the text before
                    at = heads + step
                    x[at[(at >= 0) & (at < len(x))]] = 10
            cost = bits_of(model, (before[2] << np.uint32(24)) | (before[1] << np.uint32(16)) | (before[0] << np.uint32(8)) | b)
            inside = np.flatnonzero((o[1:][filled] > part) & (heads < len(b)))
            out[start + filled[inside]] += np.add.reduceat(cost, np.maximum(heads[inside], 0), axis=0, dtype=np.float64)
    return out


def identify(df: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and bits_per_byte, read from the whole text alone.

    lang_pred is the language of the shortest code, the first by name of several; `und` if the text is null or has no letter, or if there
    is no model. score is the share of that language in the posterior over all languages, with each code
    length divided by the square root of the text's length in bytes; 0 for `und`. Columns of those three
    names in df are replaced; others pass unchanged. Each row is judged alone, however often it comes.
    """
    df = df.drop("lang_pred", "score", "bits_per_byte")
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    modest(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    mark = "_lettered" + "_" * sum(n.startswith("_lettered") for n in names)
    schema = df.withColumns({mark: lettered})

    def part(batches):
        import pyarrow as pa

        model = shared.value
        langs = np.array(model["langs"], dtype=object)
        for batch in batches:
            data, offsets = byte_view(batch[text])
            bits = code_lengths(model, data, offsets)
            size = np.maximum(1, np.diff(offsets))
            best = bits.argmin(1) if len(bits) else np.zeros(0, int)
            least = bits.min(1) if len(bits) else np.zeros(0)
            share = 1 / np.exp2(-(bits - least[:, None]) / np.sqrt(size)[:, None]).sum(1)
            ok = batch[mark].to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(ok, langs[best], UNDETERMINED)
            out = [batch[n] for n in names] + [pa.array(pred.tolist(), pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(least / size)]
            yield pa.RecordBatch.from_arrays(out, [*names, "lang_pred", "score", "bits_per_byte"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return schema.mapInArrow(lean(part), f"{kinds}, lang_pred string, score double, bits_per_byte double")


def trained_on(docs: DataFrame) -> dict | None:
    """The model of the contract's training fold: crc32(doc_id as text) mod 3 is not 1 (a null id: not used)."""
    fold = docs.filter(remainder("doc_id", 3) != 1)
    return train(fold.select(F.col("doc_id").alias("key"), "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`; held_out marks the fold that training does not see."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), trained_on(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
