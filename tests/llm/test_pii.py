from __future__ import annotations

import hashlib
import random
import re
import time

import duckdb
import pyarrow as pa

from modlytics.llm import pii as P
from modlytics.llm.queries import ORACLES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain(text: str | None) -> list[tuple[str, int, int]]:
    """The kinds that always stay, straight from their patterns."""
    text = text or ""
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(part) <= 255 for part in m[0].split("."))]
    for match in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", match[0])
        if 13 <= len(digits) <= 19 and plain_luhn(digits):
            spans.append(("card", *match.span()))
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def texts() -> list[str | None]:
    rng = random.Random(5)
    pieces = ["a", "@", ".", "b.c", "é", "-", " ", "\n", "0", "1", "255", "256", "0007", "1.2.3.4", "10.0.0.1.", "4111111111111111",
              "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (212) 555-0100", "+49", "漢", "iban", " card ", "order ", "x@y.zz",
              "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR7630006000011234567890189", " dni ", "12345678Z", "ssn ",
              "078-05-1120", " ssn 219-09-9999 ", " dni 12345678Z ", "2 69 05 49 588 157 80", "000-12-3456", "%", "+"]
    return [None, ""] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(600)]


def test_base_spans_equal_plain_patterns_and_all_spans_their_sql(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in P.digests(P.find_pii(docs)).collect()}
    assert len(out) == len(rows)
    for key, text in rows:
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in plain(text))
        assert out[key].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert out[key].spans.startswith(joined)
    assert sum("iban" in r.spans for r in out.values()) > 20 and sum("ssn" in r.spans for r in out.values()) > 3
    con = duckdb.connect()
    documents = pa.table({"doc_id": [key for key, _ in rows], "text": [text for _, text in rows]})
    con.register("documents", documents)
    answer = con.execute(ORACLES["op13_pii"])
    names = [column[0] for column in answer.description]
    for row in answer.fetchall():
        want = dict(zip(names, row, strict=True))
        assert out[want["doc_id"]].asDict() == want, rows[want["doc_id"]]


def kinds(text: str) -> list[tuple[str, str]]:
    return [(span.kind, text[span.start : span.end]) for span in P.spans_of(text)]


def test_checks_confirm_and_words_nearby_decide():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 NOW") == []
    assert kinds("my DNI is 12345678Z.") == [("dni", "12345678Z")]
    assert kinds("part 12345678Z.") == [] and kinds("my dni is 12345678A.") == []
    assert kinds("SSN: 078-05-1120") == [("ssn", "078-05-1120")]
    assert kinds("order 078-05-1120 ssn") == [] and kinds("ssn 666-05-1120") == []
    (email,) = P.spans_of("order a@b.cc")
    assert email.score == P.START["email"] - P.LOWER
    assert kinds("1.2.3.256 001.002.003.0004 1.2.3.4.5.6.7.8") == [("ip", "001.002.003.0004"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8")]
    assert P.small_parts("0" * 9000 + "7.1.1.1") and not P.small_parts("9" * 9000 + ".1.1.1")
    assert kinds("1" * 30) == [] and P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_very_long_texts_take_linear_time():
    hard = ["a" * 1_000_000, "1" * 1_000_000, "a@" * 300_000, "1." * 500_000, "+1 " * 200_000, "x@y.zz " * 50_000, "AB12" + "C" * 500_000]
    start = time.time()
    found = [len(P.spans_of(text)) for text in hard]
    assert found[5] == 50_000 and time.time() - start < 60


def test_redact(spark):
    text = "é mail a@b.cc card 4111 1111 1111 1111 end"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    found = P.find_pii(docs).select("doc_id", P.redact("text").alias("t"))
    assert {r.doc_id: r.t for r in found.collect()} == {1: "é mail [email] card [card] end", 2: None}


def test_awkward_rows(awkward, empty):
    found = P.find_pii(awkward)
    assert found.columns == [*(name for name in awkward.columns if name != "spans"), "spans"]
    assert found.count() == 8 and found.filter("size(spans) > 0").count() == 0
    assert P.digests(P.find_pii(empty)).count() == 0
