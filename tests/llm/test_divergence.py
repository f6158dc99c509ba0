from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from modlytics.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(term: str) -> str:
    return "".join(chr(ord(sign) + 32) if "A" <= sign <= "Z" else sign for sign in term)


def brute(docs: list[tuple]) -> list[tuple]:
    """Every kept term of every group, one after the other."""
    rows = [(lang or "", source or "", [low(term) for term in TERM.findall(text or "")]) for text, lang, source in docs]
    held, uses, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        held[lang].update(set(terms))
        uses[lang].update(terms)
        own[lang, source].update(terms)
    out = []
    for lang in {lang for lang, *_ in rows}:
        kept = [term for term, n in held[lang].items() if n >= 3]
        shares = {}
        for key, counts in [(None, uses[lang]), *((k[1], c) for k, c in own.items() if k[0] == lang)]:
            total = sum(counts[term] for term in kept)
            shares[key] = {term: 1 + 10**9 * (counts[term] + 1) // (total + len(kept)) for term in kept}
        for key in shares:
            if key is None:
                continue
            f = lambda term, q: (shares[key][term] - q[term]) ** 2 // q[term]  # noqa: B023, E731
            pairs = [(other, sum(f(term, q) for term in kept)) for other, q in shares.items() if other not in (None, key)]
            terms = [(term, f(term, shares[None])) for term in kept if own[lang, key][term] and shares[key][term] > shares[None][term]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                ranked = sorted(found, key=lambda item: (-item[1], item[0].encode()))[:top]
                out += [(lang, key, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made(size: int = 400) -> list[tuple]:
    rng = random.Random(4)
    words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(500)] + ["É", "é", "漢字", "Straße", "ÀB", "àb", "\U0001f600x", "K"]
    docs = []
    for _ in range(size):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "é", None])
        text = rng.choice([" ", "-", "1", "\x00", "\x7f"]).join(
            rng.choice([str.upper, str.lower, str.title])(rng.choice(words)) if rng.random() < 0.3 else rng.choice(words[:80])
            for _ in range(rng.randint(0, 60))
        )
        docs.append((text, lang, source))
    docs += [(None, "fr", "lonely"), ("", "fr", "also"), ("one two", "it", "x"), ("one", "it", "y")]
    return docs + docs[:5] * 3


def rows(frame) -> list[tuple]:
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("bits", [64, 6])
def test_every_share_equals_plain_counting(spark, monkeypatch, bits):
    """Also with digests so short that most terms share theirs, and with many tiles and buckets."""
    if bits < 64:
        monkeypatch.setattr(D, "TILE", 2)
        monkeypatch.setattr(D, "BUCKET", 50)
    docs = made()
    frame = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert rows(D.divergence(frame, bits=bits)) == brute(docs)


def test_only_the_first_terms_are_reported_and_ties_follow_utf_8(spark):
    words = [f"t{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(300)] + ["é", "￮", "\U0001f600"]
    docs = [(" ".join(words), "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    out = rows(D.divergence(frame))
    assert out == brute(docs)
    assert sum(row[2] == "term" and row[1] == "a" for row in out) == 200


def test_long_texts_are_cut_where_terms_end(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 10)
    text = ("Abc déf " * 20 + "x" * 50 + " end").encode()
    assert [term for part in D.terms_of(text) for term in part] == text.lower().split()
    assert list(D.terms_of(b"")) == []


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 10)
    docs = made(100)
    frame = spark.createDataFrame(docs, "text string, lang string, source string").coalesce(1)
    assert rows(D.divergence(frame)) == brute(docs)


def test_awkward_rows(awkward, empty):
    out = D.divergence(awkward)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(out) == brute([(r.text, r.lang, r.source) for r in awkward.collect()])
    assert D.divergence(empty).count() == 0
