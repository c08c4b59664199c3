"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Every kind has a pattern, a validator and words that make it likelier when they stand near. The base kinds
(email, ip, card, phone) are kept whenever their validator passes; the added kinds (iban, ssn) also need a
score of `KEEP`, so that a bare group of digits is no find unless its surroundings speak for it. Positions
are code points, ends exclusive. Scans are linear in the text, whatever its runs of letters or digits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import lean, modest, read, sha256_hex

#: Kinds in the order of the contract, then the added ones (fixed values).
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Whole words that support a kind when they stand within WINDOW characters (fixed values).
CONTEXT = {
    "email": ("mail", "e-mail", "email", "mailto", "contact", "write to"),
    "ip": ("ip", "ipv4", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "security number"),
}
#: Characters of an IBAN by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Score of a bare match, gain of a passed checksum, gain of a context word; least score of an added kind.
BARE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CHECKED, NEAR, KEEP, WINDOW = 0.4, 0.3, 0.55, 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = {n: re.compile(r"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}
NEARBY = {name: re.compile(r"(?<![^\W_])(?:%s)(?![^\W_])" % "|".join(map(re.escape, words)), re.IGNORECASE) for name, words in CONTEXT.items()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost matches of [A-Za-z0-9._%+-]+@ and a domain: one can only start in the run before its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            end = match.end()
        at = text.find("@", max(at + 1, end))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost and non-overlapping within each kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return found


def added_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if DIGIT.search(text):
        last = 0
        for m in IBAN.finditer(text):
            rest = IBAN_REST[IBAN_LENGTHS[m[1]]].match(text, m.end()) if m[1] in IBAN_LENGTHS and m.start() >= last else None
            if rest and mod97((m[0] + rest[0]).replace(" ", "")):
                last = rest.end()
                found.append((m.start(), 4, last))
        if "-" in text:
            found += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    return found


def score(text: str, start: int, kind: int, end: int) -> float:
    """0 to 1: the pattern's own weight, more for a passed checksum, more for a context word close by."""
    name = KINDS[kind]

    def near(begin: int, stop: int) -> bool:  # a word must end by stop; what follows it is seen, so that parts of words do not count
        return any(m.end() <= stop for m in NEARBY[name].finditer(text, max(0, begin), stop + 1))

    value = BARE[name] + CHECKED * (name in ("card", "iban")) + NEAR * (near(start - WINDOW, start) or near(end, min(len(text), end + WINDOW)))
    return min(1.0, value)


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) in order of start, then kind; a null text has none.

    Added spans that overlap a base span are left out, as are those with a score under KEEP.
    """
    if not text:
        return []
    base = base_spans(text)
    spans = [(*s, score(text, *s)) for s in base]
    for s in added_spans(text):
        value = score(text, *s)
        if value >= KEEP and not any(a < s[2] and s[0] < b for a, _, b in base):
            spans.append((*s, value))
    return sorted(spans)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first to start wins.

    Where several start together the longest wins. What an overlapped span has beyond the first is replaced too.
    """
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for a, k, b, _ in sorted(spans, key=lambda s: (s[0], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of each row's whole text; a null text counts as empty, repeated rows are scanned each."""

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [[], [], [], [], [], [], []]
            for value in batch["text"]:
                spans = find(value.as_py())
                base = [s for s in spans if s[1] < 4]
                for i in range(4):
                    rows[i].append(sum(s[1] == i for s in base))
                rows[4].append(sha256_hex(joined(base)))
                rows[5].append(joined(spans))
                rows[6].append(",".join(f"{s[3]:.2f}" for s in spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], ["key", *names])

    modest(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(part), schema).withColumnRenamed("key", key)


def redacted(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with each text's spans replaced and, where df has that column, its length in characters brought up to date.

    Null texts stay null, with a null length. Rows pass one by one, however often they come, and other columns
    pass unchanged whatever their names.
    """
    names = df.columns

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            clean = [redact(value.as_py()) for value in batch[text]]
            columns = {n: batch[n] for n in names}
            columns[text] = pa.array(clean, pa.string())
            if length in columns:
                columns[length] = pa.array([None if c is None else len(c) for c in clean], columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    modest(df.sparkSession)
    return df.mapInArrow(lean(part), df.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    return scan(read(spark, sf_dir, "documents"))
