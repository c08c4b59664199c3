import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from heliograph.llm import packing
from tests.llm.cases import documents, empty, frame

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(out, texts, capacity=1024):
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.piece), []).append(r)
    for key, text in texts:
        ids, start, piece = ids_of(text), 0, 0
        sizes = [len(ids) % capacity or capacity, *[capacity] * ((len(ids) - 1) // capacity)]
        for size in sizes:
            r = by[key, piece][0]
            assert (r.start, r.length) == (start, size) and r.ids_crc32 == zlib.crc32(ids[start : start + size].tobytes())
            start, piece = start + size, piece + 1
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip(spark):
    rows = documents() + [(3000, "a  b\t c\nd \n e  ", None), (3001, " x", None), (3002, "x y z", None), (3003, "<|endoftext|> y", None), (3004, "don't we'll x", None)]
    rows += [(4000 + i, "word " * (i % 7) + "end", None) for i in range(300)]
    out = packing.pack(packing.pieces(frame(spark, rows), ranked=True)).collect()
    number = check(out, [(i, t) for i, t, _ in rows])
    assert len(out) == sum(-(-len(ids_of(t)) // 1024) for _, t, _ in rows)
    assert number <= -(-sum(r.length for r in out) // 1024) + 2
    assert packing.pack(packing.pieces(empty(spark))).collect() == []
    limited = packing.pack(packing.pieces(frame(spark, rows), ranked=True), **packing.LIMITS).collect()
    assert check(limited, [(i, t) for i, t, _ in rows]) <= number
    few = packing.pack(packing.pieces(frame(spark, rows), ranked=True), most_docs=20, most_cost=300_000, weights=(1.0, 1.0, 1.0)).collect()
    assert check(few, [(i, t) for i, t, _ in rows]) > number
    sequences = {}
    for r in few:
        sequences.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(s) <= 20 and (len(s) == 1 or sum(x * x for x in s) <= 300_000) for s in sequences.values())


def test_repeated_rows(spark):
    rows = [(1, "same text here", None)] * 50
    out = packing.pack(packing.pieces(frame(spark, rows))).collect()
    assert len(out) == 50 and len({(r.sequence_id, r.offset) for r in out}) == 50


def test_plans_keep_every_limit():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    for score in ("norm", "dot"):
        for options in ({}, {"most_docs": 3}, {"most_docs": 5, "most_cost": 2500, "weights": (1.0, 0.3, 0.5)}):
            steps, bins = packing.plan(counts, 64, score=score, **options)
            used = np.zeros((bins, 3), np.int64)
            placed = Counter()
            for length, rank, number, first, offset in steps.tolist():
                assert (used[first : first + number, 0] == offset).all()
                used[first : first + number] += (length, 1, length * length)
                placed[length] += number
            assert placed == counts and used[:, 0].max() <= 64 and used[:, 1].max() <= options.get("most_docs", 10**9)
            if "most_cost" in options:
                assert (used[used[:, 1] > 1, 2] <= 2500).all()
            if not options:
                assert bins <= 1.02 * sum(k * n for k, n in counts.items()) / 64
    assert packing.plan({}) [1] == 0


def test_words_of_letters_need_no_pattern():
    """Words of letters, with a comma or full stop or without, go to the model alone, and every word is learnt once."""

    class Seen:
        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.inner.encode_batch_fast(texts, **options)

    letters = "Straße été, Été. über Ġ ŉ aĠb ªº µm ÿž, plain Plain. ǅx".split()
    others = "x², ¼. don't, ʰa ɐ, é, 日本 日本, ٣ -é ,. a,b. × é× 12, \U0001f600, ­".split()
    texts = ["x " + " ".join(letters * 3) + "\nline " + " ".join(others), "y " + " ".join(others[::-1]), "", " lead", "trail ", "a\n", "a \nb", "a\n\nb", "\x00a", "é", "x  y"]
    words = packing.Words(TOKENIZER)
    assert packing.packed_ids(texts, words) == [ids_of(t)[:-1].tobytes() for t in texts]
    assert packing.packed_ids([], words) == [] and packing.packed_ids(["", " a"], words) == [ids_of(t)[:-1].tobytes() for t in ("", " a")]
    words.forget()
    words.tokenizer = Seen(words.tokenizer)
    packing.packed_ids(["x " + " ".join(letters * 3)], words)
    assert words.tokenizer.texts == ["x"]
    for c in map(chr, range(33, ord(packing.BEYOND))):  # each letter and sign where it stands alone, first and last
        text = f"x {c} {c}a a{c} a{c}, {c}."
        if packing.words_of(text):
            assert packing.packed_ids([text], words) == [ids_of(text)[:-1].tobytes()], c
