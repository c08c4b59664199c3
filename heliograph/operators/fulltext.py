"""Ranked full-text search by BM25 (k1 = 1.2, b = 0.75) over one column or a whole record.

Score of a text for a query: the sum over its scoring terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean)),
with idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Tokens are runs of letters, digits and underscores, lower-cased.

Query syntax: terms (any of them matches), AND, OR, NOT, + and -, "phrases", prefix* and wild?cards. A query
that can't be read is taken as plain terms. One aggregate pass gives N, the mean length and each df - as many
numbers as the query has terms - and a second pass scores; texts are never exploded or shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Letters, digits and underscores of lower-cased texts, the common ones first, which nearly halves the time; of ASCII texts.
TOKEN, PLAIN_TOKEN = r"[a-z0-9_\p{L}\p{N}]+", r"[a-z0-9_]+"
PART = re.compile(r'\s*(?:(?P<phrase>[+-]?"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Term:
    """words: a word, a phrase of several, or one pattern with * or ?."""

    words: tuple[str, ...]

    @property
    def pattern(self) -> bool:
        return any(c in w for w in self.words for c in "*?")


@dataclass(frozen=True)
class Node:
    """must, should and must_not clauses, as Terms or Nodes."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Tokens of a lower-cased text."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, F.regexp_extract_all(text, F.lit(PLAIN_TOKEN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def separated(text: Column) -> Column:
    """A lower-cased text without the characters beyond ASCII that no token holds: its tokens are the runs of TOKEN_BYTES in it."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_, text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F\p{L}\p{N}]", " "))


#: Bytes of tokens in texts of separated().
TOKEN_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_") | frozenset(range(0x80, 0x100))


def words_of(text: str) -> tuple[str, ...]:
    import regex

    return tuple(regex.findall(r"[\p{L}\p{N}_*?]+", text.lower()))


def plain(text: str) -> Node:
    """Every word of the text, any of which matches."""
    return Node(should=tuple(Term((w.replace("*", "").replace("?", ""),)) for w in words_of(text) if w.strip("*?")))


def parsed(text: str) -> Node:
    """The query as a tree; plain terms if it can't be read."""
    parts = [(m.lastgroup, m[m.lastgroup]) for m in PART.finditer(text)]
    if "".join(p for _, p in parts).replace(" ", "") != text.replace(" ", "").replace("\t", "").replace("\n", ""):
        return plain(text)

    def clauses(at: int) -> tuple[Node, int]:
        must, should, must_not = [], [], []
        join, deny = "", False
        while at < len(parts) and parts[at][0] != "close":
            group, raw = parts[at]
            if group == "word" and raw in ("AND", "&&", "OR", "||", "NOT", "!"):
                join, deny = ("AND" if raw in ("AND", "&&") else join, deny) if raw not in ("NOT", "!") else (join, True)
                at += 1
                continue
            sign = raw[0] if raw[0] in "+-" and len(raw) > 1 and group != "open" else ""
            if group == "open":
                item, at = clauses(at + 1)
                if at >= len(parts):
                    raise ValueError("a parenthesis is not closed")
            else:
                words = words_of(raw)
                item = Term(words) if words else None
            at += 1
            if item is None:
                continue
            if deny or sign == "-":
                must_not.append(item)
            elif sign == "+":
                must.append(item)
            elif join == "AND":
                if should and not must or should:
                    must.append(should.pop())  # what stood before the AND is required too
                must.append(item)
            else:
                should.append(item)
            join, deny = "", False
        return Node(tuple(must), tuple(should), tuple(must_not)), at

    try:
        node, at = clauses(0)
    except ValueError:
        return plain(text)
    return node if at == len(parts) else plain(text)


def terms(node: Node) -> list[Term]:
    """Terms that count for the score, each once: all but those that must not match."""
    out: list[Term] = []
    for part in (*node.must, *node.should):
        for t in terms(part) if isinstance(part, Node) else [part]:
            if t not in out:
                out.append(t)
    return out


def wildcard(word: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in word) + "$"


def holds(text: Column, term: Term) -> Column:
    """Whether the lower-cased text has each of the term's words as a string, as every text with the term has."""
    return reduce(lambda a, b: a & b, [text.contains(w) for w in term.words])


def stands(text: Column, term: Term) -> Column:
    """Whether the lower-cased text may have the term: for a single word a test of what is beside it, which lets few other texts through."""
    word, kind = re.escape(term.words[0]), TOKEN[:-1]
    return holds(text, term) & text.rlike(f"{word}(?<!{kind}{word})(?!{kind})") if len(term.words) == 1 else holds(text, term)


def frequency(text: Column, words: Column, term: Term) -> Column:
    """How often the term stands in the token array of the lower-cased text; only texts that can have it are gone through."""
    return counted(words, term) if term.pattern else F.when(holds(text, term), counted(words, term)).otherwise(F.lit(0))


def counted(words: Column, term: Term) -> Column:
    if len(term.words) == 1:
        w = term.words[0]
        if term.pattern:
            return F.size(F.filter(words, lambda t: t.rlike(wildcard(w))))
        return F.size(words) - F.size(F.array_remove(words, w))  # compiled, unlike a lambda
    # the lambdas name nothing but their own arguments, so the tokens are never computed once an element
    def equal(w: str) -> Column:
        return F.transform(words, lambda t: t == w)

    found = equal(term.words[0])
    for k, w in enumerate(term.words[1:], 1):
        later = F.slice(equal(w), F.lit(k + 1), F.size(words))
        found = F.zip_with(found, later, lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.size(F.filter(found, lambda x: x))


def matches(node: Node | Term, has) -> Column:
    """Whether a text matches, given has(term)."""
    if isinstance(node, Term):
        return has(node)
    out = [matches(p, has) for p in node.must] + [~matches(p, has) for p in node.must_not]
    if node.should and not node.must:
        out.append(reduce(lambda a, b: a | b, [matches(p, has) for p in node.should]))
    if not node.must and not node.should:
        out.append(F.lit(False))  # nothing asked for: nothing found
    return reduce(lambda a, b: a & b, out)


def all_terms(node: Node) -> list[Term]:
    out = []
    for part in (*node.must, *node.should, *node.must_not):
        for t in all_terms(part) if isinstance(part, Node) else [part]:
            if t not in out:
                out.append(t)
    return out


def record_text(df: DataFrame, names: list[str]) -> Column:
    """The columns as one text, non-text ones by their text forms."""
    return F.concat_ws(" ", *[F.col(f"`{n}`").cast("string") for n in names])


def search(df: DataFrame, text: Column, query: str, minimum_score: float | None = None, partition: str | None = None) -> DataFrame:
    """Rows that match the query with __score__, those under the minimum left out.

    partition: N, mean length and df are those of the row's own partition value.
    """
    node = parsed(query)
    scoring, every = terms(node), all_terms(node)

    def frequencies(rows: DataFrame) -> DataFrame:
        # as output of a generator the frequencies can't be substituted into a filter further down, so tokens are cut once a row
        rows = rows.withColumn("__text", lowered(text)).withColumn("__tokens", tokens(F.col("__text")))
        figures = [frequency(F.col("__text"), F.col("__tokens"), t).alias(f"_tf{i}") for i, t in enumerate(every)]
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*figures, F.size("__tokens").alias("_n")))))

    whole, hopeful = frequencies(df), df
    if scoring and not any(t.pattern for t in scoring):
        # whatever matches has a scoring term, so only texts where one stands by itself are cut into tokens again
        hopeful = df.filter(reduce(lambda a, b: a | b, [stands(lowered(text), t) for t in scoring]))
    measures = [F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean")] + [F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(every))]
    if partition:
        stats = whole.groupBy(F.col(partition).alias("_p")).agg(*measures)
        joined = frequencies(hopeful).join(stats, F.col(partition).eqNullSafe(F.col("_p"))).drop("_p")
        figure = F.col
    else:
        row = whole.agg(*measures).first().asDict()
        joined = frequencies(hopeful)
        figure = lambda name: F.lit(float(row[name] or 0))
    score = F.lit(0.0)
    for i, t in enumerate(every):
        if t in scoring:
            tf, df_ = F.col(f"_tf{i}").cast("double"), figure(f"_df{i}")
            idf = F.log(F.lit(1.0) + (figure("_docs") - df_ + 0.5) / (df_ + 0.5))
            mean = F.greatest(figure("_mean"), F.lit(1e-9))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + B * F.col("_n") / mean))
    found = joined.filter(matches(node, lambda t: F.col(f"_tf{every.index(t)}") > 0)).withColumn("__score__", score)
    if minimum_score is not None:
        found = found.filter(F.col("__score__") >= minimum_score)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "__score__")


def search_all(tables: dict[str, tuple[DataFrame, str]], query: str, limit: int = 100, minimum_score: float | None = None) -> DataFrame:
    """(entity, id, score, row) of the best matches of all tables together, ranked over all of them.

    tables: name -> (table, identifier). Scores of each table use its own statistics.
    """
    parts = []
    for name in sorted(tables):
        df, key = tables[name]
        found = search(df, record_text(df, df.columns), query, minimum_score)
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        parts.append(found.select(F.lit(name).alias("entity"), F.col(key).cast("string").alias("id"), F.col("__score__").alias("score"), row.alias("row")).orderBy(F.col("score").desc(), "id").limit(limit))
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("score").desc(), "entity", "id").limit(limit)
