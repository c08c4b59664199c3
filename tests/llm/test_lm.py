import math
import zlib
from collections import Counter

import numpy as np

from heliograph.llm import lm
from tests.llm.cases import documents, empty, frame


def expected(rows, fold=5):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    counts = Counter(w for (i, _, _), ws in zip(rows, tokens) if i is not None and zlib.crc32(str(i).encode()) % fold != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws) for ws in tokens]
    return [(i, len(ws), sum(counts[w] > 0 for w in ws), total, round(b, 6)) for (i, _, _), ws, b in zip(rows, tokens, base)]


def scored(spark, rows, **options):
    from heliograph.llm.common import remainder

    df = frame(spark, rows)
    return lm.score_texts(df.select("doc_id", "text"), df.filter(remainder("doc_id", 5) != 1), **options).collect()


def test_base_scores(spark):
    rows = documents() + documents()[:3]
    for options in ({}, {"model_words": 5, "known_words": 20}):
        out = scored(spark, rows, **options)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)
        assert got == sorted(expected(rows), key=str)
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert scored(spark, []) == []


def plain_probability(model, last, before):
    """The distribution over all classes after one context, class by class."""
    a, b = model["context"]
    r = (a[last] + b[before]).astype(float)
    groups = [math.exp(r @ g[:-1] + g[-1]) for g in model["group"].astype(float)]
    out = []
    for k in range(len(model["class"])):
        first = k // model["size"] * model["size"]
        inside = [math.exp(r @ e[:-1] + e[-1]) for e in model["class"][first : first + model["size"]].astype(float)]
        out.append(groups[k // model["size"]] / sum(groups) * inside[k - first] / sum(inside))
    return out


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    for v in (1, 2, 7, 10):
        model = lm.fit(rng.integers(0, v, (500, 2)), rng.integers(0, v, 500), np.arange(1.0, v + 1), epochs=1)
        assert model["size"] * len(model["group"]) >= v
        for last in range(v):
            for before in range(v):
                p = np.exp(lm.log_probabilities(model, np.tile([[last, before]], (v, 1)), np.arange(v)))
                assert abs(p.sum() - 1) < 1e-4
                assert np.allclose(p, plain_probability(model, last, before), atol=1e-4)


def test_contexts_stop_at_texts():
    classes, sizes = np.array([5, 6, 0, 0, 7, 0]), np.array([3, 1, 2])
    assert lm.contexts_of(classes, sizes).tolist() == [[0, 0], [5, 0], [6, 5], [0, 0], [0, 0], [7, 0]]
    assert lm.contexts_of(classes[:3]).tolist() == [[0, 0], [5, 0], [6, 5]]


def test_scores_against_brute_force(spark, monkeypatch):
    """score is the sum over tokens of the class's probability by the model that was trained and the word's share of its class."""
    made = []
    fit_all = lm.fit_all
    monkeypatch.setattr(lm, "fit_all", lambda *a, **k: made.append((fit_all(*a, **k), a[1])) or made[-1][0])
    rows = [r for r in documents() if r[0] is not None]
    out = {r.doc_id: r.score for r in scored(spark, rows, model_words=5, known_words=20)}
    (model, _), frequency = made[-1]
    counts = Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in (t or "").encode().lower().split())
    root = math.isqrt(len(counts))
    m = max(5, root)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    least = counts[ranked[m - 1]]
    # the most frequent words by count, as far as their order is certain, and shared classes by hash
    if counts[ranked[m]] == least:
        m = len(model["class"]) - 1 - (root + 1)
    own = {w: k + 2 for k, w in enumerate(ranked[:m])}
    shared = lambda w: (lambda k: m + 1 + k if k else 1)(zlib.crc32(w) % (root + 1))
    sharing = Counter(shared(w) for w in counts if w not in own)
    mass = Counter()
    for w, n in counts.items():
        if w not in own:
            mass[shared(w)] += n
    for k, n in mass.items():
        assert frequency[k] == n
    for i, t, _ in rows:
        last = before = 0
        total = 0.0
        for w in [*(t or "").encode().lower().split(), None][:60]:
            k = 0 if w is None else own.get(w) or shared(w)
            total += math.log10(plain_probability(model, last, before)[k])
            if w is not None and w not in own:
                total += math.log10((counts[w] + 0.5) / (mass[k] + 0.5 * (sharing[k] + 1)))
            last, before = k, last
        if len((t or "").split()) < 60:
            assert abs(out[i] - total) < 1e-2 * max(1, abs(total) ** 0.5), i


def test_context_beats_the_base(spark, sf):
    out = lm.op9_lm_scores(spark, sf).filter("held_out").groupBy().sum("score", "base_score").first()
    assert out[0] > out[1]


def test_no_training_rows(spark):
    df = frame(spark, documents()[:5])
    out = lm.score_texts(df.select("doc_id", "text"), empty(spark)).collect()
    assert len(out) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


def test_every_training_position_teaches(spark):
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(2, 20, 9999), 0) for _ in range(50)] + [np.array([*[20, 21] * 2000, 0])]
    frequency = np.bincount(np.concatenate(texts), minlength=22).astype(float)
    encoded = spark.createDataFrame([(t.astype(lm.code_type(22)).tobytes(), i % lm.ROUNDS) for i, t in enumerate(texts)], "c binary, turn int").repartition(5)
    model, positions = lm.fit_all(encoded, frequency, int(frequency.sum()))
    assert positions == sum(len(t) for t in texts) > 500_000
    p = lm.log_probabilities(model, np.tile([[20, 21]], (22, 1)), np.arange(22))
    assert np.argmax(p) == 21  # one text in 51 says so


def test_words_that_share_a_class_see_their_context(spark):
    few = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(["the", "of", few[i % 40], few[(i + 1) % 40]] * 5), "en") for i in range(200)]
    told = [(1000, "w3 w4 w9 w10", "en"), (1001, "w4 w9 w3 w10", "en")]  # the same words in another order
    out = lm.score_texts(frame(spark, told).select("doc_id", "text"), frame(spark, rows), model_words=2, known_words=10).collect()
    a, b = (r.score for r in sorted(out))
    assert abs(a - b) > 1e-3


def test_classes_and_shares_are_a_probability():
    known = [f"w{i}".encode() for i in range(30)]
    s = lm.Scorer(known, np.array([1, 0, *range(40, 10, -1)]), 4, 6)
    numbers, classes, sizes, others = s.numbers([b"w0 w3 w4 w29 other", b""])
    assert classes.tolist() == [2, 5, s.class_of(b"w4"), s.class_of(b"w29"), s.class_of(b"other"), 0, 0]
    assert numbers.tolist() == [2, 5, 6, 31, 1, 0, 0] and sizes.tolist() == [6, 1] and others == [b"other"]
    assert {s.class_at(k) for k in range(6)} == {1, 6, 7, 8, 9, 10}


def test_words_are_cut_and_counted_as_python_does():
    import pyarrow as pa

    from heliograph.llm.common import cut_words

    texts = ["A b", "", None, "b", " \t", "c\x0bC\x0cé\u00a0é\x1cx", "É\r\nb ", "ab", "c", "\x00 \x00"] * 3
    raw = [(t or "").encode() for t in texts]
    at, each, n = cut_words(b"".join(raw), np.cumsum([0, *map(len, raw)]))
    assert [each[k] for k in at] == [w for t in raw for w in t.split()] and n.tolist() == [len(t.split()) for t in raw]
    assert len(set(each)) == len(each) and cut_words(b"", np.zeros(3, int))[2].tolist() == [0, 0]
    got = Counter()
    for out in lm.count_words([pa.RecordBatch.from_arrays([pa.array(texts[:7])], ["text"]), pa.RecordBatch.from_arrays([pa.array(texts[7:])], ["text"])]):
        got.update(dict(zip(out["word"].to_pylist(), out["n"].to_pylist(), strict=True)))
    assert got == Counter(w for t in raw for w in [*t.lower().split(), None])


def test_short_ways_give_the_same_sums_and_logs():
    rng = np.random.default_rng(3)
    heads, order = np.array([0, 1, 5, 300]), rng.permutation(400)
    for width in (1, 3, 24):
        g = rng.normal(size=(400, width)).astype(np.float32)
        assert np.allclose(lm.sums(g, order, heads), np.add.reduceat(g.take(order, axis=0).astype(float), heads, axis=0), atol=1e-4)
    for scale in (1, 100):  # scores within the bound, and far over it
        r, target = np.ones((50, 5), np.float32), rng.normal(0, scale, (7, 5)).astype(np.float32)
        r[:, :4] = rng.normal(size=(50, 4))
        scores, at = r @ target.T, rng.integers(0, 7, 50)
        assert np.abs(scores).max() <= lm.furthest(r, target) * 1.001 and (lm.furthest(r, target) > 60) == (scale > 1)
        exact = scores.astype(float) - scores.max(1, keepdims=True)
        exact = exact[np.arange(50), at] - np.log(np.exp(exact).sum(1))
        assert np.allclose(lm.log_softmax(scores.copy(), at, lm.furthest(r, target)), exact, rtol=1e-3, atol=1e-3)
