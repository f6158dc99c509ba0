"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices

#: Kinds whose spans always stay, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that stay where nothing of the kinds above overlaps them and their score is high enough.
MORE = ("iban", "insee", "dni", "ssn")
#: The least score of an added span.
ENOUGH = 50
#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 16

# What a confirmed span of each kind scores without words around it.
START = {"email": 95, "ip": 60, "card": 70, "phone": 65, "iban": 85, "insee": 60, "dni": 40, "ssn": 30}
RAISE, LOWER = 25, 40
# Words near a span that speak for its kind, and words that speak against all kinds.
FOR = {
    "email": r"\b(e-?mail|mailto|contact|kontakt|correo|courriel)\b",
    "ip": r"\b(ip|host|server|login|address|adresse)\b",
    "card": r"\b(card|credit|visa|mastercard|karte|kreditkarte|carte|tarjeta)\b",
    "phone": r"\b(phone|tel|mobile|call|fax|telefon|handy|movil)\b",
    "iban": r"\b(iban|bank|account|konto|compte|cuenta)\b",
    "insee": r"\b(insee|nir|securite|sociale)\b",
    "dni": r"\b(dni|nif|documento|identidad)\b",
    "ssn": r"\b(ssn|social|security)\b",
}
AGAINST = r"\b(version|build|isbn|issn|order|invoice|serial|sku|example|sample)\b"
# Characters of an account number by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20,
    "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# Fixed value: check letters of eight digits, by their remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

DIGITS = frozenset(string.digits)
ALNUM = DIGITS | frozenset(string.ascii_letters)
LOCAL = ALNUM | frozenset("._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs are taken whole and a run of digits is entered at its start only, so no text takes more than linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
INSEE = re.compile(r"[12](?: ?[0-9]){14}")
DNI = re.compile(r"[0-9]{8}-?[A-Z]")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
NO_DIGIT = re.compile("[^0-9]+")
FOR_BYTES = {kind: re.compile(words.encode()) for kind, words in FOR.items()}
AGAINST_BYTES = re.compile(AGAINST.encode())


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: int


def luhn(digits: str) -> bool:
    """The sum of all digits, every second from the right doubled and added up, ends in 0."""
    doubled = (sum(divmod(2 * int(digit), 10)) for digit in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def mod_97(account: str) -> bool:
    """An account number without blanks: country and check digits last, letters as 10 to 35, leave 1."""
    return int("".join(str(int(sign, 36)) for sign in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @, so a long run of letters without one is never tried."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def small_parts(address: str) -> bool:
    """Every part of an address is at most 255, however many zeros lead it."""
    parts = [part.lstrip("0") or "0" for part in address.split(".")]
    return all(len(part) <= 3 and int(part) <= 255 for part in parts)


def apart(text: str, start: int, end: int, signs: frozenset[str]) -> bool:
    """Neither neighbour of a span is one of these signs."""
    return signs.isdisjoint(text[max(0, start - 1) : start] + text[end : end + 1])


def confirmed_more(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the added kinds that their checks confirm."""
    for match in IBAN.finditer(text):
        size, count = IBAN_LENGTHS.get(match[0][:2], 0), 0
        for place, sign in enumerate(match[0], 1):
            count += sign != " "
            if count == size and sign != " ":
                end = match.start() + place
                if mod_97(match[0][:place].replace(" ", "")) and apart(text, match.start(), end, ALNUM):
                    yield "iban", match.start(), end
    for match in INSEE.finditer(text):
        digits = match[0].replace(" ", "")
        if "01" <= digits[3:5] <= "12" and 97 - int(digits[:13]) % 97 == int(digits[13:]) and apart(text, *match.span(), DIGITS):
            yield "insee", *match.span()
    for match in DNI.finditer(text):
        if DNI_LETTERS[int(match[0][:8]) % 23] == match[0][-1] and apart(text, *match.span(), ALNUM):
            yield "dni", *match.span()
    for match in SSN.finditer(text):
        area, group, serial = match[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and apart(text, *match.span(), ALNUM):
            yield "ssn", *match.span()


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the kinds that always stay, leftmost first; a match that fails its check is dropped."""
    for start, end in emails(text):
        yield "email", start, end
    for match in IP.finditer(text):
        if small_parts(match[0]):
            yield "ip", *match.span()
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = NO_DIGIT.sub("", match[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *match.span()
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", match[0])) <= 15:
                yield "phone", *match.span()


def score_of(text: str, kind: str, start: int, end: int) -> int:
    """0 to 100: the kind's own score, moved by words before and after the span, ASCII capitals as small letters."""
    near = (text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]).encode("utf-8", "replace").lower()
    score = START[kind]
    if FOR_BYTES[kind].search(near):
        score += RAISE
    if AGAINST_BYTES.search(near):
        score -= LOWER
    return min(100, max(0, score))


def spans_of(text: str) -> list[Span]:
    """All spans of a text, by kind and then by start."""
    base = [Span(*span, score_of(text, *span)) for span in confirmed(text)]
    more = sorted(confirmed_more(text), key=lambda span: span[1])
    free, ends = [], sorted((span.start, span.end) for span in base)
    place, reach = 0, 0
    for kind, start, end in more:
        # ``reach``: the farthest end of the base spans that start before this one does.
        while place < len(ends) and ends[place][0] <= start:
            reach, place = max(reach, ends[place][1]), place + 1
        if reach <= start and (place == len(ends) or ends[place][0] >= end):
            score = score_of(text, kind, start, end)
            if score >= ENOUGH:
                free.append(Span(kind, start, end, score))
    return base + sorted(free, key=lambda span: (MORE.index(span.kind), span.start))


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())]))


def scan(text: str) -> Column:
    """A column with the spans of ``text``; null counts as empty."""

    @F.arrow_udf(SPAN_TYPE)
    def find(values: pa.Array) -> pa.Array:
        found = []
        for part in slices(pa.RecordBatch.from_arrays([values], ["text"])):
            found += [[span._asdict() for span in spans_of(value or "")] for value in part["text"]]
        return pa.array(found, ARROW_SPANS)

    return find(F.coalesce(F.col(text).cast("string"), F.lit("")))


def find_pii(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``spans``: kind, start and end (code points, end exclusive) and score of personal data.

    E-mail addresses, IP addresses, card numbers (Luhn) and international phone numbers always stay.  Account numbers
    (the country's length, mod 97), French (mod 97), Spanish (mod 23) and US identity numbers are added where
    no such span overlaps them and their score is at least ENOUGH; words nearby raise or lower every score.
    Added spans may overlap one another.

    The columns in ``carry`` stay (all, if None); one named ``spans`` is replaced.  Null and empty texts have
    no spans, repeated rows keep their own, an empty table stays empty.  Nothing is shuffled: texts are
    read whole where they are scanned, in time linear in their length.
    """
    names = [name for name in (docs.columns if carry is None else carry) if name != "spans"]
    return docs.select(*names, scan(text).alias("spans"))


def redact(text: str, spans: str = "spans") -> Column:
    """``text`` with every span replaced by its kind in brackets; of spans that overlap, the first one's kind stands."""

    @F.arrow_udf("string")
    def cut(values: pa.Array, found: pa.Array) -> pa.Array:
        done = []
        for value, own in zip(values.to_pylist(), found.to_pylist(), strict=True):
            if value is None:
                done.append(None)
                continue
            pieces, at = [], 0
            for span in sorted(own or [], key=lambda span: (span["start"], -span["end"])):
                if span["start"] >= at:
                    pieces += [value[at : span["start"]], f"[{span['kind']}]"]
                at = max(at, span["end"])
            done.append("".join([*pieces, value[at:]]))
        return pa.array(done, pa.string())

    return cut(F.col(text), F.col(spans))


def listed(spans: Column, fields: tuple[str, ...] = ("kind", "start", "end")) -> Column:
    """The spans as they come, their fields joined by colons, the spans by commas."""
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", *(span[field].cast("string") for field in fields))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the kinds that always stay, a digest of their spans, all spans as text, and with their scores."""
    base = F.filter("spans", lambda span: span["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("bigint")
    return found.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        listed(F.col("spans"), ("kind", "start", "score")).alias("scores"),
    )
