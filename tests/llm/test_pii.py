import hashlib
import re

from heliograph.llm import pii
from tests.llm.cases import documents, empty, frame

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if k == 0 or k == 1 and max(map(int, m[0].split("."))) <= 255 or k == 2 and 14 <= len(digits) <= 19 and total % 10 == 0 or k == 3 and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


TEXTS = [
    "write a.b+c@d-e.fr.uk, x@y, @z.com, a@b.c@d.e.f", "1.2.3.4.5.6.7.8 999.1.1.1 010.020.030.255 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111 1111 11115", "+1 (555) 010-9999 +33 6 12 34 56 78. +1 2 +999999999999999999",
    "é😀 me@x.org", "0" * 5000, "@" * 500 + "a@b.cc", "1." * 3000, "+1" + " " * 500 + "2", "a" * 3000 + "@", "9 " * 2000, "iban GB82 WEST 1234 5698 7654 32 here", "GB82WEST12345698765432", "my ssn is 123-45-6789", "no 123-45-6789", "iban GB82WEST12345698765433",
]


def test_spans(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + documents()
    for r, (_, text, _) in zip(pii.scan(frame(spark, rows)).collect(), rows, strict=True):
        base = brute(text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in pii.KINDS[:4])
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.scan(empty(spark)).collect() == []


def test_checksums_and_context():
    kinds = lambda text: [pii.KINDS[s[1]] for s in pii.find(text)]
    assert "iban" in kinds(TEXTS[11]) and "iban" in kinds(TEXTS[12]) and "iban" not in kinds(TEXTS[15])
    assert kinds(TEXTS[13]) == ["ssn"] and kinds(TEXTS[14]) == []
    assert pii.find("call +1 555 010 9999")[0][3] > pii.find("code +1 555 010 9999")[0][3]


def test_iban_ends_where_its_country_says():
    cut = lambda text: [text[a:b] for a, k, b, _ in pii.find(text) if pii.KINDS[k] == "iban"]
    assert cut("IBAN GB82 WEST 1234 5698 7654 32 IS MINE") == ["GB82 WEST 1234 5698 7654 32"]
    assert cut("GB82WEST12345698765432 OK") == ["GB82WEST12345698765432"]
    assert cut("DE89 3704 0044 0532 0130 00 EUR 500, NO93 8601 1117 947.") == ["DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    assert cut("GB82WEST12345698765432OK ZZ82WEST12345698765432 GB82") == []


def test_context_is_whole_words():
    value = lambda text: next(s[3] for s in pii.find(text))
    assert value("the ship sailed 10.0.0.1") == value("the sailed 10.0.0.1") < value("the ip is 10.0.0.1") == value("10.0.0.1 (IP)")
    assert value("ship" + " " * 38 + "10.0.0.1") == value("10.0.0.1")  # the window begins inside a word
    assert value("10.0.0.1 " + "x" * 36 + " hosting") == value("10.0.0.1")  # and ends inside one
    assert value("ip_address 10.0.0.1") > value("10.0.0.1")


def test_redaction(spark):
    rows = [(1, "mail a@b.cc now", "en"), (2, None, "en"), (3, "clean", None), (4, "+4111 1111 1111 1111 x", None)]
    out = {r.doc_id: r for r in pii.redacted(frame(spark, rows)).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[1].n_chars == len(out[1].text) and out[2].text is None and out[3].text == "clean"
    assert not re.search(r"\d", out[4].text)
