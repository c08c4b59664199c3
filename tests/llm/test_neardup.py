import random

import numpy as np

from heliograph.llm import neardup
from heliograph.llm.shingles import Words, sets
from tests.llm.cases import documents, empty, frame


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n):
    found = {i: shingle_set(t, n) for i, t, _ in rows if i is not None}
    label = {i: i for i in found}
    changed = True
    links = [(a, b) for a in found for b in found if a < b and found[a] and found[b] and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return {i: (len(found[i]), label[i], label[i] == i) for i in found}


def check(spark, rows, n):
    out = neardup.near_duplicates(frame(spark, rows), n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute(rows, n)
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark):
    out = check(spark, documents(), 2)
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]


def family(rng, number, words, most):
    """Copies of one text with different numbers of changed words: pairs on both sides of the threshold."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(number):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), None))
    return rows


def test_family_around_the_threshold(spark):
    check(spark, family(random.Random(8), 120, 100, 14), 2)


def test_chain_and_five_words(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(160)]
    rows = [(100 - i, " ".join(words[i : i + 120]), None) for i in range(0, 30, 2)]
    rows += [(500 + i, " ".join(f"q{rng.randrange(50)}" for _ in range(4)), None) for i in range(3)]
    check(spark, rows, 5)
    assert neardup.near_duplicates(empty(spark), 5).collect() == []


def test_deduplicated_keeps_the_columns(spark):
    rows = documents()
    df = frame(spark, rows)
    kept = neardup.deduplicated(df, 5)
    expected = {i for i, (_, _, own) in brute(rows, 5).items() if own} | {None}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == expected


def test_sketches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = values[:2000], values[500:2500]
    whole = neardup.sketches(np.concatenate([a, b, values[:2500]]), np.array([0, 2000, 4000]))
    assert (neardup.merged(whole[0], whole[1]) == whole[2]).all()
    estimate = neardup.likeliest(whole[:1], whole[1:2], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(estimate - 1500 / 2500) < 0.15


def test_word_hashes_see_words_alone():
    texts = [b"Ab  cd\n", b"ab cd", b"", b"cd", b"a b cd"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    shingles, at = sets(*Words()(data, offsets), len(texts), 2)
    parts = [shingles[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert parts[0] == parts[1] and parts[2] == [] and len(parts[3]) == 1 and len(parts[4]) == 2 and parts[3] != parts[0]
