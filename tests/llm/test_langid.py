import zlib

import numpy as np

from heliograph.llm import langid
from tests.llm.cases import documents, empty, frame


def test_held_out_accuracy(spark, sf):
    out = langid.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_code_lengths_are_exact(spark):
    """The flattened table gives what a direct walk through the trees gives."""
    texts = {"a": b"abracadabra abc", "b": b"xyzzy xyx abc"}
    counts = {}
    for lang, raw in texts.items():
        b = np.frombuffer(b"\n\n\n" + raw, np.uint8).astype(np.int64)
        counts[lang] = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
    model = langid.flatten(counts)
    def bits(lang, raw):
        padded, total = b"\n\n\n" + raw, 0.0
        train = b"\n\n\n" + texts[lang]
        for i in range(3, len(padded)):
            x, p = padded[i], 1.0
            for order in (3, 2, 1, 0):
                context = padded[i - order : i]
                after = [train[j] for j in range(3, len(train)) if train[j - order : j] == context]
                if not after:
                    continue
                n, d = len(after), len(set(after))
                if x in after:
                    p *= after.count(x) / (n + d)
                    break
                p *= d / (n + d)
            else:
                p /= 256
            total -= np.log2(p)
        return total

    for raw in (b"abc abra", b"xyz", b"a", b"never seen: \xff\x00", b"abrabc xyzzy" * 200_000):
        data = np.frombuffer(raw, np.uint8)
        got = langid.code_lengths(model, data, np.array([0, len(raw)]))[0]
        if len(raw) > 1 << 20:  # over two parts: as short texts in a row, but for the first bytes of each
            raw, got = raw[:3000], langid.code_lengths(model, data[:3000], np.array([0, 3000]))[0]
            whole = langid.code_lengths(model, data, np.array([0, len(data)]))[0]
            each = langid.code_lengths(model, data[:1212], np.array([0, 1212]))[0] - langid.code_lengths(model, data[:1200], np.array([0, 1200]))[0]
            assert np.allclose(whole, got + each * (len(data) - 3000) / 12, rtol=1e-5)
        assert np.allclose(got, [bits("a", raw), bits("b", raw)], rtol=1e-5)


def test_texts_do_not_touch(spark):
    counts = {"a": (np.array([0x61626364, 0x0A0A0A61]), np.array([5, 5]))}
    model = langid.flatten(counts)
    raw = [b"abcd", b"a", b"", b"dcba"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    together = langid.code_lengths(model, data, offsets)
    alone = [langid.code_lengths(model, np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(together, alone)


def test_edges(spark):
    df = frame(spark, documents())
    out = langid.identify(df, langid.trained_on(df))
    rows = {r.doc_id: r for r in out.collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {1000, 1001, 1002, 1008}
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[None].key == "k" and rows[1004].n == 1
    assert langid.identify(df, None).filter("lang_pred <> 'und'").isEmpty()
    assert langid.trained_on(empty(spark)) is None
    assert langid.identify(empty(spark), langid.trained_on(df)).collect() == []
