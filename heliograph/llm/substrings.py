"""Repeated-substring removal by prefix-free parsing, judged at every byte.

Each SPAN-byte window has a trigger: the leftmost GRAM-byte string in it whose rolling hash is least. The
windows of one trigger lie side by side; the bytes they cover are a phrase. Neighbouring phrases overlap by
SPAN - 1 bytes, so every window lies in exactly one phrase, and equal windows have equal triggers at equal
places. The distinct phrases are the dictionary, far smaller than the text where it repeats itself.

1. Parse: each document is the sequence of its phrases. Equal phrases are put together by their hashes; the
   first of them in corpus order is the dictionary's, and those of larger documents go as a whole. No window
   spans two phrases, so the parse needs no order of its own: what repeats in it is found phrase by phrase.
2. Dictionary: the phrases that share a trigger with a different phrase of another document are sent as bytes,
   dealt by their trigger. The suffixes of a slot's phrases are sorted by their first SPAN bytes: ranks of
   8-byte words, extended word by word, with a suffix left out once nothing else begins as it does. Equal
   prefixes are neighbours in that order, compared byte for byte, and all but the smallest document's go.
3. Each document takes what both steps found and writes its remaining bytes.

Rows travel packed: sorted hash parts, phrases and document numbers as bytes, one row for each slot and flush of
text. Both the text of a slot and that of a flush are the root of what the corpus holds times BLOB, within
bounds, so packed rows keep about that size at any scale. Copies within a flush are settled before the
shuffle, so a passage that a third of all documents hold comes to its slot once for each flush.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import byte_view, durable, lean, read, release, runs, slots
from heliograph.llm.shingles import _BASE, _BYTE, _INVERSE, _U, mix, powers

SPAN, GRAM = 50, 20
#: Bytes of the words whose ranks are extended to SPAN, and where the words of a prefix begin after the first (they may overlap).
WORD, NEXT = 8, (8, 16, 24, 32, 40, 42)
#: Bytes of dictionary whose suffixes are sorted at a time, in whole triggers.
SORTED = 1 << 22
#: Bytes hashed at a time, bytes of a packed row that are aimed at, least and most bytes of text of a slot.
RUN, BLOB, LEAST, MOST = 1 << 20, 40_000, 1 << 20, 1 << 27
PLACE = _U((1 << 28) - 1)
TEXT, PHRASE, SPANS, DUPLICATE, OPEN, SPELLED, GONE = range(7)
SCHEMA = "slot int, kind int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, each array as planes of its bytes, the highest first."""
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)[:, ::-1].T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as unsigned integers of their sizes."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    number = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * number, 8).reshape(-1, 2)
    at, out = 8 + 16 * number, []
    for n, width in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)[::-1].T
        out.append(np.ascontiguousarray(planes).view(f"<u{width}").reshape(n))
        at += n * width
    return out


def narrow(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """40- to 56-bit numbers as their low 32 bits and the top bits in one or two arrays' width."""
    return (values & _U(0xFFFFFFFF)).astype(np.uint32), (values >> _U(32)).astype(np.uint32 if top > 16 else np.uint16 if top > 8 else np.uint8)


def documents_in(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of the distinct sorted numbers, and each row's place among them."""
    distinct, place = np.unique(docs, return_inverse=True)
    return np.diff(distinct, prepend=np.int64(0)).astype(np.int64), place.astype(np.uint16 if len(distinct) < 65536 else np.uint32)


def numbers(differences: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.view(np.int64))[place.astype(np.int64)]


class Trail:
    """Hashes of any stretch of bytes from running sums; keeps its tables of powers."""

    def __init__(self):
        self.up, self.down = powers(_BASE, RUN), powers(_INVERSE, RUN)

    def over(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = powers(_BASE, len(data) + 1), powers(_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def windows_of(offsets: np.ndarray) -> np.ndarray:
    """Starts of all windows that lie within one document."""
    n = int(offsets[-1])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    return np.flatnonzero(left >= SPAN)


def phrases(trail: Trail, data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, first window, last window, document) of each phrase."""
    m = len(data) - GRAM + 1
    starts = windows_of(offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    h = mix((sums[GRAM:] - sums[:m]) * trail.down[:m])
    least, reach, width = (h & ~PLACE) | np.arange(m, dtype=np.uint64), 1, SPAN - GRAM + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    trigger = (least[starts] & PLACE).astype(np.int64)
    head = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    lo, hi = starts[head], starts[np.r_[head[1:], len(starts)] - 1]
    return h[trigger[head]], trail.stretch(sums, lo, hi + SPAN), lo, hi, np.searchsorted(offsets, lo, "right") - 1


def identity(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    """64 bits for a phrase: 40 of its own hash, 24 of its trigger's."""
    return (f & _U((1 << 40) - 1)) << _U(24) | (h & _U((1 << 24) - 1))


def with_document(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(doc.astype(np.int64).view(np.uint64) + _U(_BASE)))


def within(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == values


def home(doc: np.ndarray, number: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % _U(number)).astype(np.int64)


def batch_of(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    slot, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["slot", "kind", "blob"])


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    return list(zip(heads, [*heads[1:], len(values)], strict=True))


def dealt(slot: np.ndarray, kind: int, *columns: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Packed rows of the columns and document numbers by slot; order within a slot is kept."""
    order = np.argsort(slot, kind="stable")
    out = []
    for a, b in stretches(slot[order]):
        rows = order[a:b]
        out.append((int(slot[rows[0]]), kind, pack(*documents_in(doc[rows]), *[c[rows] for c in columns])))
    return out


def smaller_first(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, then document; for each place in it, whether it begins a key and the key's smallest document."""
    order = np.lexsort((doc, key))
    begins = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(begins)
    least = np.repeat(doc[order][heads], np.diff(np.r_[heads, len(order)]))
    return order, begins, least


def flushes(batches, size: int):
    """(doc ids, bases, data, offsets) of about `size` bytes of text each, from Arrow batches of doc_id, base and text."""
    for batch in batches:
        data, offsets = byte_view(batch["text"])
        docs, bases = (batch[c].to_numpy().astype(np.int64) for c in ("doc_id", "base"))
        for a, b in runs(offsets, size):
            yield docs[a:b], bases[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def places(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64)


def parse(number: int, size: int):
    """Documents to phrase rows by trigger; what copies within the flush settle goes to the documents' slots."""

    def part(batches):
        trail = Trail()
        for docs, bases, data, offsets in flushes(batches, size):
            found = []
            for a, b in runs(offsets, RUN):
                o = offsets[a : b + 1] - offsets[a]
                some = data[offsets[a] : offsets[b]]
                h, f, lo, hi, d = phrases(trail, some, o, trail.over(some))
                shift = bases[a + d] - o[d]
                found.append((h, f, lo + shift, hi + shift, docs[a + d]))
            h, f, lo, hi, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            order, begins, least = smaller_first(identity(h, f), doc)
            late = order[doc[order] > least]
            rows = dealt(home(doc[late], number), SPANS, places(lo[late]), (hi - lo)[late].astype(np.uint8), doc=doc[late])
            first = order[begins]
            by_trigger = first[np.argsort(h[first] & _U(0xFFFFFFFF), kind="stable")]
            slot = ((h[by_trigger] >> _U(32)) % _U(number)).astype(np.int64)
            low, high = narrow(f[by_trigger] & _U((1 << 40) - 1), 8)
            rows += dealt(slot, PHRASE, (h[by_trigger] & _U(0xFFFFFFFF)).astype(np.uint32), low, high, doc=doc[by_trigger])
            yield batch_of(rows)

    return part


def by_slot(batches):
    """(slot, {kind: [blobs]}, text blobs or none) of rows sorted by slot and falling kind.

    Yields the small kinds of a slot once, then each of its text blobs with them.
    """
    current, small = None, {}
    for batch in batches:
        for slot, kind, blob in zip(batch["slot"].to_pylist(), batch["kind"].to_pylist(), batch["blob"], strict=True):
            if slot != current:
                if current is not None:
                    yield current, small, None
                current, small = slot, {}
            if kind == TEXT:
                yield current, small, blob.as_py()
            else:
                small.setdefault(kind, []).append(blob.as_py())
    if current is not None:
        yield current, small, None


def columns(blobs: list[bytes]) -> list[np.ndarray]:
    """Document numbers and the further columns of packed rows."""
    parts = []
    for blob in blobs:
        differences, place, *rest = unpack(blob)
        parts.append((numbers(differences, place), *rest))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def dictionary(number: int):
    """Phrase rows of a slot to duplicates and open phrases, by document; other rows pass."""

    def part(batches):
        for _, small, _ in by_slot(batches):
            rows = []
            if PHRASE in small:
                doc, h, low, high = columns(small[PHRASE])
                h, f = h.astype(np.uint64), low.astype(np.uint64) | high.astype(np.uint64) << _U(32)
                order = np.lexsort((doc, f, h))
                doc, h, f = doc[order], h[order], f[order]
                new_h = np.r_[True, h[1:] != h[:-1]]
                new_f = new_h | np.r_[True, f[1:] != f[:-1]]
                heads = np.flatnonzero(new_f)
                least = np.repeat(doc[heads], np.diff(np.r_[heads, len(doc)]))
                late = doc > least
                groups = np.cumsum(new_h) - 1
                own = groups[heads]
                lowest, highest = np.full(own[-1] + 1, np.iinfo(np.int64).max), np.full(own[-1] + 1, np.iinfo(np.int64).min)
                np.minimum.at(lowest, own, doc[heads])
                np.maximum.at(highest, own, doc[heads])
                open_ = heads[lowest[own] < highest[own]]
                key = identity(h, f)
                rows += dealt(home(doc[late], number), DUPLICATE, key[late], doc=doc[late])
                rows += dealt(home(doc[open_], number), OPEN, key[open_], doc=doc[open_])
            if rows:
                yield batch_of(rows)

    return part


def text_rows(number: int, size: int):
    """Documents packed by their home slots."""

    def part(batches):
        for docs, bases, data, offsets in flushes(batches, size):
            slot = home(docs, number)
            order = np.argsort(slot, kind="stable")
            rows = []
            for a, b in stretches(slot[order]):
                mine = order[a:b]
                text = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in mine])
                rows.append((int(slot[mine[0]]), TEXT, pack(docs[mine], bases[mine], np.diff(offsets)[mine], text)))
            if rows:
                yield batch_of(rows)

    return part


def texts(blob: bytes):
    """(docs, bases, data, offsets) of a text row, about RUN bytes at a time."""
    docs, bases, sizes, data = unpack(blob)
    docs, bases, offsets = docs.view(np.int64), bases.view(np.int64), np.r_[0, np.cumsum(sizes.view(np.int64))]
    for a, b in runs(offsets, RUN):
        yield docs[a:b], bases[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def taken(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of data, joined."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def spelled(to: np.ndarray, trigger: np.ndarray, place: np.ndarray, sizes: np.ndarray, doc: np.ndarray, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Packed rows of phrases with their bytes, by slot and trigger."""
    order = np.lexsort((trigger, to))
    data = taken(data, (np.cumsum(sizes) - sizes)[order], sizes[order])
    ends, out = np.r_[0, np.cumsum(sizes[order])], []
    for a, b in stretches(to[order]):
        rows = order[a:b]
        out.append((int(to[rows[0]]), SPELLED, pack(*documents_in(doc[rows]), trigger[rows], places(place[rows]), sizes[rows].astype(np.uint8), data[ends[a] : ends[b]])))
    return out


def suffixes(number: int, size: int):
    """Home slots to rows of open phrases by their triggers, and to spans of duplicate phrases.

    What a slot's texts give is gathered until it comes from `size` bytes of text or the slot ends.
    """

    def settled(spans: list, opened: list):
        rows = []
        if spans:
            lo, more, doc = (np.concatenate(x) for x in zip(*spans, strict=True))
            rows += dealt(home(doc, number), SPANS, places(lo), more, doc=doc)
        if opened:
            rows += spelled(*(np.concatenate(x) for x in zip(*opened, strict=True)))
        if rows:
            yield batch_of(rows)

    def part(batches):
        trail = Trail()
        last, spans, opened, seen = None, [], [], 0
        for slot, small, blob in by_slot(batches):
            if blob is None or seen > size:
                yield from settled(spans, opened)
                spans, opened, seen = [], [], 0
            if blob is None:
                continue
            if slot != last:
                last, flags = slot, {}
                for kind in (DUPLICATE, OPEN):
                    doc, key = columns(small[kind]) if kind in small else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    flags[kind] = np.sort(with_document(key, doc))
                flagged = np.unique(np.concatenate([columns(small[k])[0] for k in (DUPLICATE, OPEN) if k in small] or [np.zeros(0, np.int64)]))
            for docs, bases, data, offsets in texts(blob):
                seen += len(data)
                if not within(docs, flagged).any():
                    continue
                sums = trail.over(data)
                h, f, lo, hi, d = phrases(trail, data, offsets, sums)
                doc, shift = docs[d], bases[d] - offsets[d]
                key = with_document(identity(h & _U(0xFFFFFFFF), f), doc)
                late = within(key, flags[DUPLICATE])
                spans.append(((lo + shift)[late], (hi - lo)[late].astype(np.uint8), doc[late]))
                open_ = np.flatnonzero(within(key, flags[OPEN]) & ~late)
                sizes = (hi - lo + SPAN)[open_]
                opened.append((((h[open_] >> _U(32)) % _U(number)).astype(np.int64), (h[open_] & _U(0xFFFFFFFF)).astype(np.uint32), (lo + shift)[open_], sizes, doc[open_], taken(data, lo[open_], sizes)))
        yield from settled(spans, opened)

    return part


def equal_prefixes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, phrase, offset) of the suffixes of at least SPAN bytes whose first SPAN bytes others have too, ranks in the order of the bytes.

    data: the phrases of these sizes in a row. Of a suffix that nothing else begins like, the rank is not worked out.
    """
    words = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    for k in range(WORD):
        words = words << _U(8) | padded[k : k + len(data)]
    rank_of = np.unique(words, return_inverse=True)[1]
    starts, many = np.cumsum(sizes) - sizes, sizes - SPAN + 1
    phrase = np.repeat(np.arange(len(sizes)), many)
    place = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
    rank = rank_of[place]
    for step in (0, *NEXT):
        key = rank.astype(np.uint64) << _U(32) | rank_of[place + step].astype(np.uint64)
        _, rank, counts = np.unique(key, return_inverse=True, return_counts=True)
        several = counts[rank] > 1
        rank, place, phrase = rank[several], place[several], phrase[several]
    return rank, phrase, place - starts[phrase]


def prefixes(number: int):
    """Open phrases of a slot to the windows in them that a smaller document has, by document."""

    def part(batches):
        for _, small, _ in by_slot(batches):
            if SPELLED not in small:
                continue
            doc, trigger, place, sizes, data = columns(small[SPELLED])
            sizes = sizes.astype(np.int64)
            order = np.argsort(trigger, kind="stable")
            starts = np.cumsum(sizes) - sizes
            trigger, ends = trigger[order], np.cumsum(sizes[order])
            heads = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
            rows, a = [], 0
            while a < len(order):  # whole triggers, SORTED bytes of phrases at a time
                full = np.searchsorted(ends, (ends[a - 1] if a else 0) + SORTED, "right")
                b = int(heads[np.searchsorted(heads, full, "right") - 1]) if full < len(order) else len(order)
                if b <= a:  # a trigger that is larger goes at once
                    after = np.searchsorted(heads, a, "right")
                    b = int(heads[after]) if after < len(heads) else len(order)
                some, a = order[a:b], b
                rank, phrase, offset = equal_prefixes(taken(data, starts[some], sizes[some]), sizes[some])
                own, at = doc[some][phrase], place[some][phrase].astype(np.int64) + offset
                by, _, least = smaller_first(rank, own)
                late = by[own[by] > least]
                rows += dealt(home(own[late], number), GONE, places(at[late]), doc=own[late])
            if rows:
                yield batch_of(rows)

    return part


def removal(with_text: bool):
    """Home slots to one row a document; with_text: its remaining text as well (bytes that are no UTF-8 are replaced)."""

    def part(batches):
        import pyarrow as pa

        last = None
        for slot, small, blob in by_slot(batches):
            if blob is None:
                continue
            if slot != last:
                last = slot
                doc, lo, more = columns(small[SPANS]) if SPANS in small else [np.zeros(0, np.int64)] * 3
                gone, place = columns(small[GONE]) if GONE in small else [np.zeros(0, np.int64)] * 2
                doc, lo = np.concatenate([doc, gone]), np.concatenate([lo, place]).astype(np.int64)
                hi = lo + np.concatenate([more, np.zeros(len(gone), more.dtype)]).astype(np.int64)
                order = np.lexsort((lo, doc))
                doc, lo, hi = doc[order], lo[order], hi[order]
            for docs, bases, data, offsets in texts(blob):
                change = np.zeros(len(data) + 1, np.int64)
                begin, end = np.searchsorted(doc, docs), np.searchsorted(doc, docs, "right")
                for i in np.flatnonzero(end > begin):
                    a, b = begin[i], end[i]
                    a, b = a + np.searchsorted(lo[a:b], bases[i]), a + np.searchsorted(lo[a:b], bases[i] + offsets[i + 1] - offsets[i])
                    shift = offsets[i] - bases[i]
                    np.add.at(change, lo[a:b] + shift, 1)
                    np.add.at(change, hi[a:b] + shift + SPAN, -1)
                covered = np.cumsum(change[:-1]) > 0
                rows = [], [], [], [], []
                for i in range(len(docs)):
                    own, mask = data[offsets[i] : offsets[i + 1]], covered[offsets[i] : offsets[i + 1]]
                    kept = own[~mask].tobytes() if mask.any() else own.tobytes()
                    rows[0].append(len(own))
                    rows[1].append(len(own) - len(kept))
                    rows[2].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    rows[3].append(hashlib.sha256(kept).hexdigest())
                    rows[4].append(kept.decode(errors="replace") if with_text else None)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(docs), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], RESULT)

    return part


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def gathered(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "slot").sortWithinPartitions("slot", F.col("kind").desc())


def repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of each row of docs (doc_id, text).

    Removed is each byte covered by a SPAN-byte string that also starts in a document with a smaller doc_id.
    A null text counts as empty. A null doc_id is no document's smaller or larger one: the row keeps all it
    has. Rows that repeat a doc_id are not smaller than one another.
    """
    spark = docs.sparkSession
    partitions = slots(spark)
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("n")).first()
    distinct = docs.select("doc_id").distinct().filter(F.col("doc_id").isNotNull()).count()
    size = int(min(MOST, max(LEAST, ((facts["bytes"] or 0) * BLOB) ** 0.5)))
    number = -(-(facts["bytes"] or 1) // size)
    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("base"), "text")
    if distinct < facts["n"]:  # rows that repeat a number get places one after the other
        before = Window.partitionBy("doc_id").orderBy("text", "_row").rowsBetween(Window.unboundedPreceding, -1)
        known = known.withColumn("_row", F.monotonically_increasing_id())
        known = durable(known.withColumn("base", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long")).drop("_row"))
    parsed = gathered(known.mapInArrow(lean(parse(number, size)), SCHEMA), partitions)
    settled = parsed.mapInArrow(lean(both_kinds(dictionary(number), SPANS)), SCHEMA)
    settled = durable(settled)
    release(spark)
    at_home = known.mapInArrow(lean(text_rows(number, size)), SCHEMA)
    opened = gathered(at_home.unionByName(settled.filter(F.col("kind").isin(DUPLICATE, OPEN))), partitions).mapInArrow(lean(suffixes(number, size)), SCHEMA)
    found = durable(gathered(opened, partitions).mapInArrow(lean(both_kinds(prefixes(number), SPANS, GONE)), SCHEMA))
    release(spark)
    last = at_home.unionByName(settled.filter(F.col("kind") == SPANS)).unionByName(found)
    out = gathered(last, partitions).mapInArrow(lean(removal(with_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    whole = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    rest = docs.filter(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("long"), F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), F.when(F.lit(with_text), whole).alias("kept_text")
    )
    return out.unionByName(rest)


def both_kinds(step, *passing: int):
    """step over the sorted rows, with the rows of the passing kinds, which already go to their documents' slots, let through."""

    def part(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        through = []

        def others():
            for batch in batches:
                passes = pc.is_in(batch["kind"], pa.array(passing, pa.int32()))
                if pc.any(passes).as_py():
                    through.append(batch.filter(passes))
                    batch = batch.filter(pc.invert(passes))
                yield batch

        for out in step(others()):
            yield from through
            through.clear()
            yield out
        yield from through

    return part


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings over every whole text of `documents`."""
    return repeats(read(spark, sf_dir, "documents")).drop("kept_text")


OP6_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS MATERIALIZED (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS i FROM h)
), own AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (g) WHERE d < doc_id)
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS DISTINCT FROM p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(x, 2 * p + 1, 2), '' ORDER BY p) AS k
  FROM (SELECT doc_id, x, unnest(range(0, n)) AS p FROM h) b ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM h LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
