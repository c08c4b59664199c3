import hashlib
import random

import numpy as np
import pytest

from heliograph.llm import substrings
from tests.llm.cases import documents, empty, frame


def brute(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, b in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = []
    for i, b in texts:
        mask = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - 49):
                if first[b[s : s + 50]] < i:
                    mask[s : s + 50] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((i, len(b), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    out = substrings.repeats(frame(spark, rows)).drop("kept_text").collect()
    return sorted((tuple(r) for r in out), key=str)


def test_against_brute_force(spark):
    rows = documents()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_every_length(spark, seed):
    rng = random.Random(seed)
    pool = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(340)
            parts.append(pool[a : a + rng.randrange(20, 60)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(12))))
        rows.append((rng.randrange(30), "".join(parts), None))  # numbers repeat
    rows += [(50, "a" * 300, None), (51, "a" * 49, None), (52, "a" * 50, None), (53, "b" * 120, None), (None, "a" * 300, None)]
    assert got(spark, rows) == brute(rows)


def test_small_slots_and_runs(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST", 500)
    monkeypatch.setattr(substrings, "BLOB", 100)
    rows = documents(3)
    assert got(spark, rows) == brute(rows)


def test_nothing_and_texts(spark):
    assert substrings.repeats(empty(spark)).collect() == []
    rows = [(1, "x" * 60, None), (2, "y" + "x" * 60 + "z", None)]
    assert {r.doc_id: r.kept_text for r in substrings.repeats(frame(spark, rows), with_text=True).collect()} == {1: "x" * 60, 2: "yz"}


def test_packed_arrays():
    a, b = np.array([1, 2**40, 5], np.uint64), np.zeros(0, np.uint16)
    x, y = substrings.unpack(substrings.pack(a, b))
    assert x.tolist() == a.tolist() and len(y) == 0


def test_suffix_order_of_phrases():
    rng = np.random.default_rng(3)
    for letters in (2, 250):
        phrases = [rng.integers(0, letters, rng.integers(50, 81)).astype(np.uint8) for _ in range(60)]
        phrases += [np.concatenate([rng.integers(0, letters, 9).astype(np.uint8), p[:60]])[:80] for p in phrases[:20]] + phrases[20:25]
        sizes = np.array([len(p) for p in phrases])
        rank, phrase, offset = substrings.equal_prefixes(np.concatenate(phrases), sizes)
        windows = {}
        for i, p in enumerate(phrases):
            for k in range(len(p) - 49):
                windows.setdefault(p[k : k + 50].tobytes(), []).append((i, k))
        shared = sorted(w for w, where in windows.items() if len(where) > 1)
        got = {}
        for r, i, k in zip(rank.tolist(), phrase.tolist(), offset.tolist()):
            got.setdefault(r, []).append((i, k))
        assert [sorted(got[r]) for r in sorted(got)] == [windows[w] for w in shared] and shared


@pytest.mark.parametrize("sorted_bytes", [1, 200, 1 << 22])
def test_triggers_in_parts(spark, monkeypatch, sorted_bytes):
    monkeypatch.setattr(substrings, "SORTED", sorted_bytes)
    step = substrings.prefixes(1)
    rng = np.random.default_rng(5)
    phrases, triggers = [], []
    for t in range(6):
        core = rng.integers(0, 256, 60).astype(np.uint8)
        for _ in range(5):
            phrases.append(np.concatenate([core, rng.integers(0, 256, 10).astype(np.uint8)]))
            triggers.append(t)
    n = len(phrases)
    doc = np.arange(n) % 7 + 10
    rows = substrings.spelled(np.zeros(n, np.int64), np.array(triggers, np.uint32), np.arange(n) * 100, np.array([len(p) for p in phrases]), doc, np.concatenate(phrases))
    out = [x for b in step([substrings.batch_of(rows)]) for x in zip(b["kind"].to_pylist(), b["blob"].to_pylist())]
    got = sorted((int(d), int(p)) for _, blob in out for d, p in zip(*substrings.columns([blob])))
    expected = []
    for i in range(n):
        if any(doc[j] < doc[i] for j in range(n) if triggers[j] == triggers[i]):
            expected += [(int(doc[i]), i * 100 + k) for k in range(11)]
    assert got == sorted(expected) and {k for k, _ in out} == {substrings.GONE}
