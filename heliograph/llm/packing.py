"""Vector best-fit packing of token sequences.

A piece needs tokens, one document place and attention cost (its length squared), so its demand follows
from its length alone. The number of pieces of each length - a table of at most `capacity` rows, however
large the corpus - is therefore all that the packing itself needs. Lengths are placed from the longest
down; among the open kinds of bins that have room in every dimension, the best is the one with the largest
weighted dot-product of demand and residual, or the least residual norm. Bins of one kind are filled
together, as ranges of bin numbers, so a plan has as many steps as there are kinds, not bins.

The plan says which ranks among the pieces of one length go where. Ranks come from counts for each
partition of the written table of pieces, so no length, however common, meets in one task.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import durable, lean, modest, read

CAPACITY, END = 1024, 2
#: What a sequence holds besides its tokens - documents and attention cost, each as much as CAPACITY tokens can come to,
#: so that neither asks for more sequences - and the weights of tokens, documents and cost in the choice of a bin.
LIMITS = {"most_docs": CAPACITY, "most_cost": CAPACITY * CAPACITY, "weights": (1.0, 1.0, 1.0)}
#: Documents encoded together.
SOME = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Before a text's first word, which follows no space.
FIRST = "\x00"
#: How the vocabulary writes a space (a fixed value).
SPACE = "\u0120"


class Words:
    """Ids of words, each encoded by the tokenizer once while it is kept: one flat array, and each word's stretch of it.

    A word follows a space, or holds the line end or FIRST that it follows. New words are encoded in long
    joined texts, where each begins a token, and the ids are dealt back by the lengths of their tokens in
    bytes. A comma or full stop after a letter or digit is a token of its own, so such words take the ids of
    what stands before it. Words of letters alone are one piece to the tokenizer's pattern, so they go to its
    model without the pattern. Over `most` words, all are forgotten.
    """

    def __init__(self, tokenizer, most: int = 600_000):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.most = tokenizer, most
        vocabulary = tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # one character for each byte
        # the same model without the pattern, for words written as its vocabulary writes bytes
        self.plain = type(tokenizer)(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.marks = {mark: tokenizer.encode(mark, add_special_tokens=False).ids[0] for mark in ",."}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def learn(self, new: list[str]) -> None:
        firsts = [w for w in new if w[0] == FIRST]
        self._keep(firsts, [e.ids for e in self.tokenizer.encode_batch_fast([w[1:] for w in firsts], add_special_tokens=False)])
        lines, words, marked = [w for w in new if w[0] == "\n"], [], []
        for w in new:
            if w[0] != FIRST and w[0] != "\n":
                (marked if w[-1] in ",." and w[-2:-1].isalnum() and w[-2] < BEYOND else words).append(w)
        words += {w[:-1] for w in marked}.difference(self.place, words)
        plain, latin, others = [], [], []
        for w in words:
            (others if not w.isalpha() else plain if w.isascii() else latin if max(w) < BEYOND else others).append(w)
        for at in range(0, max(len(plain), len(latin)), 4096):
            for part, alphabet in ((plain[at : at + 4096], None), (latin[at : at + 4096], LETTERS)):
                if part:
                    text = " ".join(part)
                    text = SPACE + (text.translate(alphabet) if alphabet else text).replace(" ", f" {SPACE}")
                    self._deal(part, 1, self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        for group, lead in ((lines, ""), (others, " ")):
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                self._deal(part, len(lead), self.tokenizer.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids)
        if marked:
            base = np.fromiter((self.place[w[:-1]] for w in marked), np.int64, len(marked))
            sizes = self.size[base] + 1
            ends = np.cumsum(sizes)
            at = np.minimum(np.repeat(self.start[base] - ends + sizes, sizes) + np.arange(ends[-1]), len(self.ids) - 1)
            ids = self.ids[at]
            ids[ends - 1] = np.fromiter((self.marks[w[-1]] for w in marked), np.uint32, len(marked))
            self._store(marked, ids, sizes)

    def _deal(self, words: list[str], lead: int, ids: list[int]) -> None:
        """Store the ids of the joined words, each of which `lead` bytes precede."""
        ids = np.array(ids, np.uint32)
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + lead)
        after = np.cumsum(self.bytes[ids])
        cuts = np.searchsorted(after, stops)
        if not np.array_equal(after[cuts], stops):
            raise ValueError("a token crosses a space")
        self._store(words, ids, np.diff(cuts, prepend=-1))

    def _keep(self, words: list[str], ids: list[list[int]]) -> None:
        self._store(words, np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64))

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, need = len(self.place), self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), np.uint32)])
        while first + len(words) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : need] = ids
        self.start[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(words)] = sizes
        self.used = need
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def encoded(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words between the spaces of joined, one after the other, and how many each word has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.place) > self.most:
            self.forget()
        words = pc.split_pattern(pa.array([joined], pa.large_string()), " ").flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        each = pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")  # looked up once, however often they come
        at = np.fromiter(map(self.place.get, each, itertools.repeat(-1)), np.int64, len(each))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lacking = [each[i] for i in missing.tolist()]
            self.learn(lacking)
            at[missing] = np.fromiter(map(self.place.__getitem__, lacking), np.int64, len(lacking))
        at = at[words.indices.to_numpy()]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(ends[-1])], sizes


def words_of(text: str) -> str | None:
    """The text with a space before each line end: between its spaces are words that no token crosses; None if it has other space.

    The tokenizer's pattern lets a token begin with one space and never hold a space elsewhere, except in
    runs of white space; a text with such runs, or with a special token's string, is encoded as one.
    """
    if any(c in text for c in ASCII_ODD) or "<|" in text or not text.isascii() and any(c in text for c in ODD):
        return None
    if text.startswith((" ", "\n")) or text.endswith((" ", "\n")) or not text:
        return None
    cut = text.replace("\n", " \n")
    return None if "  " in cut or "\n " in cut else FIRST + cut


#: Letters before this one are letters to every version of Unicode (a fixed value).
BEYOND = "\u0250"


def letters() -> dict[int, str]:
    """How the vocabulary writes the bytes of the letters before BEYOND."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves
    others = [b for b in range(256) if b not in seen]
    of = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(128, ord(BEYOND)) if chr(c).isalpha()}


#: White space beyond ASCII (fixed values).
ODD = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


ASCII_ODD = "\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
LETTERS = letters()


def packed_ids(texts: list[str], words: Words) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    cut = [words_of(t) for t in texts]
    whole = iter(words.tokenizer.encode_batch_fast([t for t, parts in zip(texts, cut, strict=True) if parts is None], add_special_tokens=False))
    joined = [parts for parts in cut if parts is not None]
    ids, sizes = words.encoded(" ".join(joined)) if joined else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    raw, ends = ids.astype("<u4").tobytes(), np.r_[0, 4 * np.cumsum(sizes)]
    bounds = iter(ends[np.cumsum([0, *[parts.count(" ") + 1 for parts in joined]])].tolist())
    begin, out = next(bounds), []
    for parts in cut:
        if parts is None:
            out.append(np.array(next(whole).ids, "<u4").tobytes())
        else:
            end = next(bounds)
            out.append(raw[begin:end])
            begin = end
    return out


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END, ranked: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of each document: (doc_id, piece, start, length, ids_crc32).

    A document is its ids, then `end`; a null text counts as empty, so each row gives one piece at least.
    All pieces but the first are full. Repeated rows are cut as often as they come. ranked: with _rank, as
    pack() needs it, so that it takes no second pass through the workers.
    """

    def part(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        import tokenizers

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        words = Words(tokenizers.Tokenizer.from_file(path))
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            texts = batch["text"]
            for at in range(0, len(keys), SOME):
                rows = []
                for key, ids in zip(keys[at : at + SOME], packed_ids([t or "" for t in texts.slice(at, SOME).to_pylist()], words), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    rows += [(key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def with_ranks(batches):
        yield from local_ranks(part(batches))

    modest(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(with_ranks if ranked else part), f"{PIECES}, _rank long" if ranked else PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY, most_docs: int | None = None, most_cost: int | None = None, weights: tuple = (1.0, 0.0, 0.0), score: str = "norm") -> tuple[np.ndarray, int]:
    """Steps (length, first rank, number, first bin, offset) that place all pieces, and the number of bins.

    counts: pieces of each length (1 to capacity). most_docs and most_cost bound a bin's pieces and its sum
    of squared lengths (None: no bound; a piece whose own cost is over the bound gets a bin of its own).
    score: "norm" takes the bin whose residual after placing has the least weighted norm, "dot" the one
    whose residual before has the largest weighted dot-product with the demand.
    """
    limit = np.array([capacity, most_docs or np.iinfo(np.int64).max // 4, most_cost or np.iinfo(np.int64).max // 4], np.int64)
    scale = np.where(np.array([True, most_docs is not None, most_cost is not None]), np.array(weights, float), 0.0) / limit
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # used -> ranges (first bin, number)
    steps, bins = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        left, rank = counts[length], 0
        while left:
            kinds = np.array(list(open_bins), np.int64).reshape(-1, 3)
            fits = kinds[(kinds + need <= limit).all(1)]
            if len(fits):
                residual = (limit - fits) * scale
                if score == "dot":
                    value = -(residual * (need * scale)).sum(1)
                else:
                    value = ((residual - need * scale) ** 2).sum(1)
                used = tuple(fits[np.lexsort((fits[:, 1], fits[:, 0], value))[0]].tolist())
                ranges = open_bins.pop(used)
            else:
                room = max(1, int(min((limit // need).tolist())))
                number = -(-left // room)
                used, ranges = (0, 0, 0), [(bins, number)]
                bins += number
            after = tuple((np.array(used) + need).tolist())
            rest = []
            for first, number in ranges:
                take = min(left, number)
                if take:
                    steps.append((length, rank, take, first, used[0]))
                    open_bins.setdefault(after, []).append((first, take))
                    left, rank = left - take, rank + take
                if take < number:
                    rest.append((first + take, number - take))
            if rest and used != (0, 0, 0):
                open_bins.setdefault(used, []).extend(rest)
    return np.array(steps, np.int64).reshape(-1, 5), bins


def local_ranks(batches):
    """Each row's place among the rows of its length in this task."""
    import pyarrow as pa

    done = np.zeros(0, np.int64)
    for batch in batches:
        lengths = batch["length"].to_numpy()
        if len(lengths) and lengths.max() >= len(done):
            done = np.concatenate([done, np.zeros(lengths.max() + 1 - len(done), np.int64)])
        by = np.argsort(lengths, kind="stable")
        values, first, n = np.unique(lengths[by], return_index=True, return_counts=True)
        rank = np.zeros(len(lengths), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(first, n) + np.repeat(done[values], n)
        done[values] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "_rank"])


def pack(cut: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """cut (columns of pieces(), ranked or not) with sequence_id and offset; further columns of cut do not pass.

    Full pieces are sequences of their own (negative numbers); all others share the bins of plan(), whose
    limits may be given. An empty table stays empty.
    """
    spark = cut.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = cut if "_rank" in cut.columns else cut.select(*names).mapInArrow(lean(local_ranks), f"{PIECES}, _rank long")
    ranked = durable(ranked.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counted = ranked.filter(F.col("length") < capacity).groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps, _ = plan(totals, capacity, **limits)
    shared = spark.sparkContext.broadcast(steps[np.lexsort((steps[:, 1], steps[:, 0]))])

    def part(batches):
        import pyarrow as pa

        table = shared.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            lengths = batch["length"].to_numpy()
            rank = batch["_rank"].to_numpy() + batch["_before"].to_numpy(zero_copy_only=False)
            sequence, offset = -1 - batch["_row"].to_numpy(), np.zeros(len(lengths), np.int64)
            at = np.flatnonzero(lengths < capacity)
            step = table[np.searchsorted(keys, lengths[at] * (1 << 44) + rank[at], "right") - 1]
            sequence[at] = step[:, 3] + rank[at] - step[:, 1]
            offset[at] = step[:, 4]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = ranked.join(starts, ["_part", "length"], "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    return placed.mapInArrow(lean(part), f"{PIECES}, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 1024 ids under LIMITS."""
    return pack(pieces(read(spark, sf_dir, "documents"), ranked=True), **LIMITS)
