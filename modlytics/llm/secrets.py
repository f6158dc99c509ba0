"""Secrets in texts: fixed patterns, and key-like strings that only their owner's documents hold."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, stored, text_bytes

#: Kinds of the fixed patterns, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
#: Kind of the spans that the ownership counts add.
OWNED = "owned"
#: A string that more owners than this hold is an example that people copy.
MAX_OWNERS = 2
MASK = "[secret]"

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LIKELY = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
KEY_BLOCK = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)


def classes(chars: bytes) -> bytes:
    """A table for bytes.translate() that maps ``chars`` to x and all else to a blank."""
    return bytes(ord("x") if value in chars else ord(" ") for value in range(256))


DIGITS = b"0123456789"
HEX_TABLE = classes(DIGITS + b"abcdef")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
TOKEN_TABLE = classes(DIGITS + LETTERS + b"+/_-")
DIGIT_TABLE = classes(DIGITS)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    digest: str


def entropy(value: bytes) -> float:
    total = len(value)
    return -sum(n / total * math.log2(n / total) for n in Counter(value).values())


def looks_random(value: bytes) -> bool:
    """Letters and digits mixed, with at least 3.5 bits to a character."""
    return any(c in DIGITS for c in value) and any(c in LETTERS for c in value) and entropy(value) >= 3.5


def byte_spans(text: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the fixed patterns and other key-like strings, in bytes; the latter overlap none of the former.

    The searches of single classes decide in one pass over the bytes whether a pattern is tried at all.
    """
    base: list[tuple[str, int, int]] = []
    if b"=" in text or b":" in text:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text.lower()) if len(m[2]) >= 8]
    if b"AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.translate(HEX_TABLE):
        base += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    base.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    more: list[tuple[str, int, int]] = []
    if b"-----BEGIN " in text:
        more += [(OWNED, *m.span()) for m in KEY_BLOCK.finditer(text)]
    if b"x" in text.translate(DIGIT_TABLE) and b"x" * 20 in text.translate(TOKEN_TABLE):
        more += [(OWNED, *m.span()) for m in LIKELY.finditer(text) if looks_random(m[0])]
    return base, apart_from(base, more)


def apart_from(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of ``more``, by start and the longer first, those that overlap neither ``base`` nor one taken before; one sorted sweep."""
    edges = sorted((start, end) for _, start, end in base)
    starts, ends = [start for start, _ in edges], list(accumulate((end for _, end in edges), max))
    free, last = [], 0
    for span in sorted(more, key=lambda span: (span[1], -span[2])):
        before = bisect_left(starts, span[2])
        if span[1] >= last and (not before or ends[before - 1] <= span[1]):
            free.append(span)
            last = span[2]
    return free


def spans_of(text: bytes) -> list[Span]:
    """All spans of a text in code points, each with a digest of the characters that make the key."""
    base, more = byte_spans(text)
    found, at, points = [], 0, 0
    wanted = sorted({edge for _, *edges in base + more for edge in edges})
    places = {}
    for edge in wanted:
        points += sum((byte & 0xC0) != 0x80 for byte in text[at:edge]) if not text[at:edge].isascii() else edge - at
        places[edge], at = points, edge
    for kind, start, end in base + more:
        key = ASSIGN.match(text[start:end].lower()).start(2) if kind == "assign" else 0
        found.append(Span(kind, places[start], places[end], hashlib.sha256(text[start + key : end]).hexdigest()))
    return found


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,digest:string>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string())])
)


def scan(text: str) -> Column:
    """A column with the spans of ``text``: the fixed patterns and all candidates."""

    @F.arrow_udf(SPAN_TYPE)
    def find(values: pa.Array) -> pa.Array:
        found = []
        for part in slices(pa.RecordBatch.from_arrays([values], ["text"])):
            found += [[span._asdict() for span in spans_of(value)] for value in part["text"]]
        return pa.array(found, ARROW_SPANS)

    return find(text_bytes(F.col(text)))


def ownership(spans: DataFrame) -> DataFrame:
    """Each ``digest`` with its owners, repositories and uses over all rows of ``spans``.

    Three counts in a row, each added up inside the tasks before it is shuffled, so that a key that
    a third of all rows hold arrives as one row per task.  A null owner or repository counts as one.
    """
    keys = spans.select(F.explode("spans.digest").alias("digest"), "owner", "repository")
    pairs = keys.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = pairs.groupBy("digest", "owner").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses")
    )


def judged(scanned: DataFrame, max_owners: int) -> DataFrame:
    """``row`` and ``spans`` with each span's owners and verdict, for the rows that have spans.

    Few rows have a span, so only they are joined; a hot key makes a skewed join, which Spark splits.
    """
    hits = scanned.filter(F.size("spans") > 0)
    counts = ownership(hits)
    single = hits.select("row", F.posexplode("spans").alias("place", "span"))
    return (
        single.withColumn("digest", F.col("span.digest"))
        .join(counts, "digest")
        .select(
            "row",
            F.struct(
                "place", "span.kind", "span.start", "span.end", "digest", "owners", "repositories",
                F.when(F.col("owners") > max_owners, "example").otherwise("live").alias("verdict"),
            ).alias("span"),
        )
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("span")).alias("spans"))
    )


JUDGED_TYPE = (
    "array<struct<place:int,kind:string,start:bigint,end:bigint,digest:string,owners:bigint,repositories:bigint,verdict:string>>"
)


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "lang",
    max_owners: int = MAX_OWNERS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``spans``: kind, start, end (code points), digest, owners, repositories, verdict.

    Spans of the fixed patterns always stay.  Other key-like strings (long, mixed, close to random,
    or a private key block) are candidates.  A digest of each key is counted over the whole corpus
    by distinct owners and repositories: what more than ``max_owners`` owners hold is an example
    that was copied, and such a candidate goes; one that few owners hold looks live and is kept as
    kind ``owned``.  A repository is an (owner, ``repository``) pair.

    The columns in ``carry`` stay (all, if None); one named ``spans`` is replaced.  Null and empty
    texts have no spans, a null owner counts as one owner, repeated rows keep their own spans, and
    an empty table stays empty.  The carried columns are written once into the shared folder, so
    leave the text out where it is not needed.
    """
    names = [name for name in (docs.columns if carry is None else carry) if name != "spans"]
    inner = {f"c{place}": name for place, name in enumerate(names)}
    scanned = stored(
        docs.select(
            *(F.col(name).alias(short) for short, name in inner.items()),
            F.col(owner).alias("owner"),
            F.col(repository).alias("repository"),
            F.monotonically_increasing_id().alias("row"),
            scan(text).alias("spans"),
        )
    )
    verdicts = judged(scanned, max_owners)
    wanted = F.filter("spans", lambda span: (span["kind"] != OWNED) | (span["verdict"] == "live"))
    clean = scanned.filter(F.size("spans") == 0).withColumn("spans", F.array().cast(JUDGED_TYPE))
    found = scanned.filter(F.size("spans") > 0).drop("spans").join(verdicts, "row").withColumn("spans", wanted)
    return clean.unionByName(found).select(*(F.col(short).alias(name) for short, name in inner.items()), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, in the order of start and then of the kinds, joined by commas."""
    order = {kind: place for place, kind in enumerate((*KINDS, OWNED))}
    rank = F.create_map(*(F.lit(part) for pair in order.items() for part in pair))
    keyed = F.transform(
        spans,
        lambda span: F.struct(span["start"], rank[span["kind"]].alias("rank"), span["end"], span["kind"].alias("kind")),
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))),
        ",",
    )


def matching(field: str, value: str) -> Column:
    """How many spans have this value in a field."""
    return F.size(F.filter("spans", lambda span: span[field] == value)).cast("bigint")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, a digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda span: span["kind"] != OWNED)
    return found.select(
        key,
        *(matching("kind", kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        matching("verdict", "example").alias("n_examples"),
    )


def mask(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by a mask; spans that touch or overlap share one."""
    ordered = F.array_sort(F.transform(spans, lambda span: F.struct(span["start"].cast("int").alias("start"), span["end"].cast("int").alias("end"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = (span["start"] > state["at"]) | (state["at"] == 0)
        return F.struct(
            F.when(fresh, F.concat(state["done"], between, F.lit(MASK))).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    return F.aggregate(ordered, start, step, lambda state: F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text))))
