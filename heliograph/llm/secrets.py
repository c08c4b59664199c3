"""Secrets: fixed patterns, and a battery of randomness tests over encoded tokens. DataFrame functions only.

A candidate is a run of 20 or more characters of an encoding that holds a letter and a digit, or of 20 or
more letters. Its encoding is the narrowest alphabet that covers it: hexadecimal (16), base32 (32),
lower-case alphanumeric (36), alphanumeric (62) or base64 (64). Three tests ask whether it is uniform noise
over that alphabet:

* chi-squared: the sum of squared symbol counts against its exact mean and variance under uniformity;
* runs: Wald-Wolfowitz over the symbols from the token's own median on and those below it;
* serial correlation of neighbouring symbols at lag one.

Their standardised values together (the first only where it is too uneven) must not reject noise at ALPHA.
Conversely, the chi-squared value is held against what an ordinary word of that length would show, whose
symbols repeat as letters do. The chance of so even a token among words is its p-value; Benjamini-Hochberg
at RATE over the candidates of all rows, weighted by their lengths since long tokens tell more, says which
are found. The cut comes from counts of weighted p-values by classes of a sixteenth of an e-fold, each
class taken at its upper end: a few thousand numbers, whatever the corpus.

Each step of the battery is linear in the token (one sort apart), as what a step names is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import durable, read

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A failing run is a maximal run that is too short, so its length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+|[A-Za-z]{20,}+(?![0-9+/_-]))={0,2}"
#: The symbols in order (fixed values); the last two pairs are the two ways of writing base64.
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
#: Per encoding: its pattern, its number of symbols, the chance that two symbols of an ordinary word agree.
ENCODINGS = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.15), ("base32", "^[A-Z2-7]+$", 32, 0.066), ("base36", "^[a-z0-9]+$", 36, 0.066), ("base62", "^[A-Za-z0-9]+$", 62, 0.06), ("base64", "", 64, 0.06))
ALPHA, RATE = 0.001, 0.05
#: Classes of p-values in an e-fold; elements that are added up at a time.
CLASSES, CHUNK = 16, 256


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column) -> Column:
    """Sum of the values before each one; copies grow with the length to the power 1.5 at most by chunks."""

    def short(part):
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("p"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["p"], a["s"]).alias("p")))["p"]

    number = F.size(values)
    chunks = F.when(number > 0, F.transform(F.sequence(F.lit(0), F.floor((number - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<bigint>>"))
    totals = F.transform(chunks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, short(totals), lambda part, base: F.transform(short(part), lambda p: p + base)))


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (start, kind, end, value) of all matches, in code points; value: the group's text.

    The text between matches comes from split, the matches from extraction; their lengths give the places.
    """
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def lengths(x):
        return F.struct(x["m"].alias("m"), x["v"].alias("v"), F.zip_with(F.slice(x["b"], 1, F.size(x["m"])), x["m"], lambda p, m: (F.length(p) + F.length(m)).cast("long")).alias("l"))

    def places(x):
        ends = F.zip_with(running(x["l"]), x["l"], lambda a, b: a + b)
        return F.transform(F.arrays_zip(ends.alias("e"), x["m"].alias("m"), x["v"].alias("v")), one)

    def one(x):
        return F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["v"].alias("value"))

    found = F.struct(matches.alias("m"), values.alias("v"), F.split(text, pattern, -1).alias("b"))
    return F.when(text.rlike(pattern), let(found, lambda x: let(lengths(x), places))).otherwise(nothing)


def normal_cdf(z: Column) -> Column:
    """Logistic approximation of the normal distribution function."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-1.5976) * z - F.lit(0.07056) * z * z * z))


def by_encoding(token: Column, value) -> Column:
    """value(encoding) of the narrowest encoding that covers the token."""
    out = F.lit(value(ENCODINGS[-1]))
    for encoding in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(encoding[1]), F.lit(value(encoding))).otherwise(out)
    return out


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, c: a + c)


def neighbours(values: Column, both) -> Column:
    """both(a, b) of each element and the next."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), both)


def battery(token: Column) -> Column:
    """(n, noise, word) of a token: its length, and its p-values as noise and as an ordinary word."""

    def symbols(t):
        codes = F.transform(F.slice(F.split(t, ""), 1, F.length(t)), lambda c: F.instr(F.lit(SYMBOLS), c).cast("double"))
        return F.struct(F.length(t).cast("double").alias("n"), codes.alias("codes"), by_encoding(t, lambda e: float(e[2])).alias("k"), by_encoding(t, lambda e: e[3]).alias("same"))

    def ordered(x):
        return F.struct(*[x[c].alias(c) for c in ("n", "k", "same", "codes")], F.array_sort(x["codes"]).alias("sorted"))

    def counted(x):
        # the j-th of equal symbols adds 2 j - 1, so c of them add their square
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

        def more(a, c):
            run = F.when(a["last"] == c, a["run"] + 1.0).otherwise(F.lit(1.0))
            return F.struct(c.alias("last"), run.alias("run"), (a["sum"] + 2.0 * run - 1.0).alias("sum"))

        codes = x["codes"]
        middle = F.element_at(x["sorted"], (x["n"] / 2).cast("int") + 1)
        return F.struct(
            *[x[c].alias(c) for c in ("n", "k", "same", "codes")], F.aggregate(x["sorted"], start, more)["sum"].alias("squares"), middle.alias("middle"), total(codes).alias("total"),
            total(F.transform(codes, lambda c: c * c)).alias("power"), total(neighbours(codes, lambda a, b: a * b)).alias("lag"), (F.element_at(codes, 1) + F.element_at(codes, -1)).alias("ends"),
        )

    def halved(x):
        names = ("n", "k", "same", "squares", "total", "power", "lag", "ends")
        return F.struct(*[x[c].alias(c) for c in names], F.transform(x["codes"], lambda c: (c >= x["middle"]).cast("double")).alias("high"))

    def switched(x):
        names = ("n", "k", "same", "squares", "total", "power", "lag", "ends")
        return F.struct(*[x[c].alias(c) for c in names], total(neighbours(x["high"], lambda a, b: (a != b).cast("double"))).alias("changes"), total(x["high"]).alias("highs"))

    def judged(x):
        n, k, one = x["n"], x["k"], F.lit(1.0)
        chi = x["squares"] * k / n - n
        even = (chi - (k - one)) / F.sqrt(F.lit(2.0) * (k - one) * (n - one) / n)
        mean = x["total"] / n
        spread = x["power"] - n * mean * mean
        along = x["lag"] - mean * (F.lit(2.0) * x["total"] - x["ends"]) + (n - one) * mean * mean
        serial = F.when(spread > 0, (along / spread + one / n) * F.sqrt(n)).otherwise(F.lit(12.0))
        expected = F.lit(2.0) * x["highs"] * (n - x["highs"]) / n + one
        variance = (expected - one) * (expected - F.lit(2.0)) / (n - one)
        runs = F.when(variance > 0, (x["changes"] + one - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(F.lit(12.0))
        together = F.pow(F.greatest(even, F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial
        # Wilson-Hilferty: the cube root of a chi-squared value over its degrees of freedom is nearly normal
        noise = one - normal_cdf((F.cbrt(together / F.lit(3.0)) - F.lit(1 - 2 / 27)) / F.lit((2 / 27) ** 0.5))
        excess = k * x["same"] - one
        ordinary = (k - one) + (n - one) * excess
        word = normal_cdf((chi - ordinary) / F.sqrt(F.lit(2.0) * (k - one) + F.lit(4.0) * n * excess))
        return F.struct(n.alias("n"), noise.alias("noise"), word.alias("word"))

    def chain(x, *steps):
        return let(x, (lambda y: chain(steps[0](y), *steps[1:])) if len(steps) > 1 else steps[0])

    return chain(F.rtrim(token, F.lit("=")), symbols, ordered, counted, halved, switched, judged)


def tested(found: Column) -> Column:
    """The candidate spans with their lengths, whether they pass as noise, and the class of their p-value over their length."""

    def one(x):
        weighed = F.ceil(F.log(F.greatest(x["b"]["word"] / x["b"]["n"], F.lit(1e-300))) * CLASSES).cast("int")
        s = x["s"]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), x["b"]["n"].alias("n"), (x["b"]["noise"] >= ALPHA).alias("noise"), weighed.alias("class"))

    return F.transform(F.transform(found, lambda s: F.struct(s.alias("s"), battery(s["value"]).alias("b"))), one)


def highest_class(rows: DataFrame) -> int | None:
    """The last class of weighted p-values that the false-discovery rate lets through, of all rows' _tested; none: None."""
    classes = rows.select(F.explode("_tested").alias("t")).groupBy("t.class").agg(F.count(F.lit(1)).alias("c"), F.sum("t.n").alias("n"))
    classes = sorted(classes.collect(), key=lambda r: r["class"])  # as many rows as there are classes
    number, length = sum(r["c"] for r in classes), sum(r["n"] for r in classes)
    best, below = None, 0
    for r in classes:
        below += r["c"]
        if math.exp(r["class"] / CLASSES) * length / number <= RATE * below / number:
            best = r["class"]
    return best


def written(found: Column) -> Column:
    """kind:start:end of each span, in order of start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of each row's whole text; a null text counts as empty, repeated rows are scanned each.

    The base kinds are found by their patterns alone. Spans of kind random come from the battery, with one
    rate of false discoveries over all rows of df, and are left out where they overlap one of the base kinds.
    Texts are read once; what is kept of them in between (spans and p-values) is written as a checkpoint.
    """
    base_text = F.coalesce(F.col(text), F.lit(""))
    df = df.select(F.col(key).alias(key), base_text.alias("_text"))
    t = F.col("_text")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    df = df.select(
        key, bare(F.filter(spans(t, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 12)).alias("_assign"),
        bare(spans(t, ACCESS, 1)).alias("_access"), bare(spans(t, HEX, 2)).alias("_hex"), tested(spans(t, CANDIDATE, 3)).alias("_tested"),
    )
    df = durable(df)
    top = highest_class(df)
    df = df.select(key, "_assign", "_access", "_hex", F.concat("_assign", "_access", "_hex").alias("_base"), F.filter("_tested", lambda s: s["noise"] & (s["class"] <= F.lit(top))).alias("_random"))
    clear = F.filter("_random", lambda r: ~F.exists(F.col("_base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    df = df.select(key, "_assign", "_access", "_hex", "_base", bare(clear).alias("_clear"))
    return df.select(
        key, F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.concat("_base", "_clear")).alias("spans"), F.size("_clear").cast("long").alias("n_random"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`."""
    return scan(read(spark, sf_dir, "documents"))
