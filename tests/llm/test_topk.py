import random

import numpy as np

from heliograph.llm import topk


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], "vec_id long, embedding array<float>, score double, key string")


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in ok if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for own, q in ok if own == i for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def run(spark, rows, **options):
    v = topk.quantised(table(spark, rows))
    found = topk.top_k(v, v.filter(v["key"] % 50 == 0), **options)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) * (1 + i % 4) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(400, 450)]  # ties
    rows += [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (650, [0.0] * 8), (700, [1.0] * 3), (701, [2.0] * 3), (None, [1.0] * 8), (750, []), (800, [-1.0] * 8)]
    rows += [(50, [0.3] * 8), (50, rows[50][1]), (100, [0.5] * 3), (7, rows[7][1])]  # repeated queries and candidates
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert run(spark, rows, block=3) == expected


def test_every_way_of_pruning(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [x + rng.gauss(0, 0.05) for x in ([1.0] * 4 if i % 2 else [1.0, -1.0, 0.5, 0.0])]) for i in range(200)]
    for start in (-2.0, 2.0):
        monkeypatch.setattr(topk, "COORDINATES_FROM", start)
        assert run(spark, rows) == brute(rows)


def test_large_numbers_and_nothing(spark):
    rows = [(0, [3e5, 2e5]), (1, [3e5, 2e5]), (2, [-3e5, 1e5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()
