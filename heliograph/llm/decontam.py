"""Benchmark decontamination by winnowing. DataFrame functions only.

The contract's windows are 10 consecutive words of a benchmark item. Both sides hash every 5 consecutive
words and keep, of the 6 hashes in each window, the least: its fingerprint, which every occurrence of the
window has at the same place. Neighbouring windows mostly share it, so a document has about two distinct
fingerprints for every seven words. These meet the benchmark's in one join, whatever the sizes of both;
where a fingerprint agrees, the words around it are compared as text with the window that has it there.

Items shorter than a window are one window of their own length, with hashes of 5 words or all they have.

The join is a broadcast where the benchmark's windows take at most `BROADCAST` bytes, so that documents are
not shuffled, and a merge join on the fingerprints otherwise; both do the same work. Each document sends one
more row, that meets one of `SPREAD` rows on the other side, so documents without a hit come through too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import durable, read

WINDOW, GRAM, BROADCAST, SPREAD = 10, 5, 64 << 20, 4096
#: Low bits of a hash give way to its place, so that the least of several tells where it stands.
LOW = 63
#: Words of the contract, after A-Z are lower-cased: what is left beside \x00-\x2F \x3A-\x60 \x7B-\x7F (fixed values).
#: Named one by one, the characters are matched some ten times faster than as the rest of all others.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null: none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.regexp_extract_all(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def at(array: Column, place: Column, n: int) -> list[Column]:
    return [F.get(array, place + i) for i in range(n)]


def indices(number: Column) -> Column:
    """0 to number - 1; nothing for a number under 1."""
    return F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))


def each(number: Column, then) -> Column:
    return F.transform(indices(number), then)


def plain(print_: Column) -> Column:
    return print_.bitwiseAND(F.lit(~LOW))


def hashed(g: int):
    """The hash of g consecutive words' hashes from place i on, its low bits cleared."""
    return lambda i: plain(F.xxhash64(*at(F.col("_hashes"), i, g)))


def with_grams(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df (with _words), _hashes of its words and _grams{g}: hash and place of each g consecutive words, for each g that the lengths need."""
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    for g in sorted({min(gram, n) for n in lengths}):
        own = hashed(g)
        df = df.withColumn(f"_grams{g}", placed(F.size("_hashes") - g + 1, own))
    return df


def placed(number: Column, hash_) -> Column:
    return each(number, lambda i: hash_(i).bitwiseOR(i.bitwiseAND(F.lit(LOW)).cast("long")))


def least(grams: Column, windows: Column, number: int) -> Column:
    """The least of each `number` neighbours."""
    return each(windows, lambda i: F.least(*at(grams, i, number)) if number > 1 else F.get(grams, i))


def text_at(words: Column, place: Column, n) -> Column:
    return F.array_join(F.slice(words, place + 1, n), " ")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(n, print, offset, window, items) of every window of the items, each once: where in it the hash stands that marks it.

    A window whose least hash occurs in it several times comes with each of the places.
    """
    words_ = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("_all")).filter(F.size("_all") > 0)
    n = F.least(F.size("_all"), F.lit(window))
    found = words_.select("item", n.alias("n"), F.explode(each(F.size("_all") - n + 1, lambda i: text_at(F.col("_all"), i, n))).alias("window"))
    found = found.groupBy("n", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hashes = F.transform(F.split("window", " "), lambda w: F.xxhash64(w))
    out = None
    for k in range(1, window + 1):
        g = min(gram, k)
        own = found.filter(F.col("n") == k).withColumn("_hashes", hashes)
        own = own.withColumn("_grams", each(F.lit(k - g + 1), hashed(g)))
        own = own.withColumn("print", F.array_min("_grams")).select("n", "print", F.explode(each(F.size("_grams"), lambda i: F.when(F.get(F.col("_grams"), i) == F.col("print"), i))).alias("offset"), "window", "items")
        own = own.filter(F.col("offset").isNotNull())
        out = own if out is None else out.unionByName(own)
    return out


def marks(n: int, gram: int) -> Column:
    """(n, print, place, base, text) of each distinct fingerprint of a row's windows of n words: where it stands, and the words around it from base on."""
    g = min(gram, n)
    reach, prints = n - g, F.col(f"_prints{n}")

    def made(i):
        own = F.get(prints, i)
        place = i + (own - i).bitwiseAND(F.lit(LOW)).cast("int")
        base = F.greatest(place - reach, F.lit(0))
        return F.struct(F.lit(n).alias("n"), plain(own).alias("print"), place.alias("place"), base.alias("base"), text_at(F.col("_words"), base, place - base + n).alias("text"))

    changes = F.filter(indices(F.size(prints)), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))
    return F.transform(changes, made)


def hits(docs: DataFrame, items: DataFrame, keep: list[Column], text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast: int = BROADCAST) -> DataFrame:
    """(_row, kept columns, n_words, n, place, items): one row with n = 0 for each row of docs and one for each window in it."""
    table = durable(windows(items, window=window, gram=gram))
    facts = table.agg(F.collect_set("n").alias("lengths"), F.sum(F.length("window") + 64 + 16 * F.size("items")).alias("bytes")).first()
    lengths = sorted(facts["lengths"])
    base = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, words(F.col(text)).alias("_words"))
    names = [c for c in base.columns if c not in ("_row", "_words")]
    base = with_grams(base, lengths, gram)
    for n in lengths:
        g = min(gram, n)
        grams = F.col(f"_grams{g}")
        base = base.withColumn(f"_prints{n}", least(grams, F.size(grams) - (n - g), n - g + 1))
    own = F.struct(F.lit(0).alias("n"), F.pmod(F.col("_row"), F.lit(SPREAD)).alias("print"), F.lit(0).alias("place"), F.lit(0).alias("base"), F.lit("").alias("text"))
    every = reduce(lambda a, b: F.concat(a, b), [marks(n, gram) for n in lengths], F.array(own))
    rows = base.select("_row", *names, F.size("_words").cast("long").alias("n_words"), F.explode(every).alias("_m")).select("_row", *names, "n_words", "_m.*")
    spread = table.sparkSession.range(SPREAD).select(
        F.lit(0).alias("n"), F.col("id").alias("print"), F.lit(0).alias("offset"), F.lit("").alias("window"), F.array().cast("array<string>").alias("items")
    )
    known = table.unionByName(spread)
    known = F.broadcast(known) if (facts["bytes"] or 0) <= broadcast else known.hint("merge")
    met = rows.join(known, ["n", "print"])
    start = F.col("place") - F.col("offset")
    same = (start >= F.col("base")) & (text_at(F.split("text", " "), start - F.col("base"), F.col("n")) == F.col("window"))
    return met.filter((F.col("n") == 0) | same).select("_row", *names, "n_words", "n", start.alias("place"), "items")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    Null texts have no words; null items and items without words have no windows. Rows that repeat a key
    are judged one by one. An item that repeats counts by its id, once; one with a null id hits words, but
    is no item to count or list.
    """
    found = hits(docs, items, [F.col(key).alias(key)], text, **options)
    grouped = found.groupBy("_row").agg(
        F.first(key).alias(key), F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("n") > 0, F.struct("place", "n"))).alias("_hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"),
    )
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))

    def cover(a, h):
        stop = h["place"] + h["n"]
        return F.struct((a["covered"] + F.greatest(F.lit(0), stop - F.greatest(a["end"], h["place"]))).alias("covered"), F.greatest(a["end"], stop).alias("end"))

    covered = F.aggregate(F.array_sort("_hits"), start, cover)["covered"].cast("long")
    return grouped.select(
        key, "n_words", covered.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold any window of an item, with the columns that docs has.

    A text decides for itself, so the texts that hold one are listed by 128 bits of their hashes and the rows
    with such a text left out: no text goes through the search for hits but its own words. Null ids, null texts
    and repeated rows are rows like others; with an empty benchmark all stay.
    """
    identity = [F.xxhash64(F.col(text), F.lit(k)) for k in (1, 2)]
    found = hits(docs, items, [c.alias(f"_text{k}") for k, c in enumerate(identity)], text, **options)
    listed = durable(found.filter(F.col("n") > 0).select("_text0", "_text1").distinct())
    listed = F.broadcast(listed) if listed.count() * 64 <= options.get("broadcast", BROADCAST) else listed.hint("merge")
    return docs.join(listed, (identity[0] == listed["_text0"]) & (identity[1] == listed["_text1"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of `benchmark` in every whole text of `documents`."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= n)
), hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON p.g = win.g AND p.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
