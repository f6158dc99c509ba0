"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, text_bytes

#: Texts longer than this are cut into chunks of so many characters, which tasks share.
CHUNK = 32_768
#: Characters that a chunk sees of the next one.
OVERLAP = 512
#: Pre-tokens whose ids a worker remembers, twice: the present generation and the one before.
REMEMBERED = 150_000
#: Stands for no rank, above all ranks.
NONE = 1 << 60
#: The encoders of this worker process, which outlive a task.
ENCODERS: dict[int, Encoder] = {}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id; its size is bounded by the vocabulary."""
    tokens: dict[int, bytes] = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            tokens[int(rank)] = base64.b64decode(token)
    return [tokens.get(rank, b"") for rank in range(max(tokens, default=-1) + 1)]


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, leftmost first, until no two have a rank.

    ``pairs`` holds the rank of each two neighbours, of which a merge changes two.
    """
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == NONE:
            break
        i = pairs.index(best)
        parts[i] = merged = parts[i] + parts[i + 1]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(merged + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + merged, NONE)
    return [ranks[part] for part in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for pre-tokens of any length."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(piece[left : end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[right]))

    for left in range(n - 1):
        offer(left)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left] if alive[left] else n
        if right >= n or end[right] != stop:
            continue  # one of the two parts has been merged since
        alive[right] = False
        end[left], after[left] = stop, after[right]
        if after[left] < n:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = after[at]
    return ids


class Encoder(dict):
    """Pre-token -> its ids as int32 bytes, remembering the latest ones."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        super().__init__()
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token}
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                ids = [rank]
            elif len(raw) <= 48:
                ids = merge_short(raw, self.ranks)
            else:
                ids = merge_long(raw, self.ranks)
            found = np.array(ids, "<i4").tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def encoder_of(shared: Broadcast) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    tokens, pattern = shared.value
    name = hash((pattern, len(tokens), hash(tuple(tokens))))
    if name not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[name] = Encoder(tokens, pattern)
    return ENCODERS[name]


def cuts(encoder: Encoder, text: str, start: int, last: bool) -> list[int]:
    """Where pre-tokens begin in a chunk that starts at ``start``, and where its last sure one ends.

    A match that ends at the edge of a chunk may go on behind it, so it is sure only in the last chunk.
    """
    found, stop = [start], len(text)
    for match in encoder.pattern.finditer(text):
        if match.end() < stop or last:
            found.append(start + match.end())
    return found


def stitch(chunks: list[tuple[int, str, list[int]]]) -> list[int] | None:
    """One row of pre-token starts from the chunks of a text, or None.

    What the pattern matches depends only on the characters behind a match's start.  So once two
    neighbouring chunks have a start in common, they agree from there on, and the later one
    takes over.  A pre-token that covers a whole overlap leaves no common start: None.
    """
    whole = chunks[0][2]
    for _, _, following in chunks[1:]:
        held = set(whole)
        meet = next((i for i, cut in enumerate(following) if cut in held), None)
        if meet is None:
            return None
        while whole[-1] > following[meet]:
            whole.pop()
        whole += following[meet + 1 :]
    return whole


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row of ``docs``.

    ``tokens`` are the tokens by rank, ``pattern`` cuts a text into pre-tokens.  A text of up to
    ``CHUNK`` characters is encoded where it is scanned.  Longer ones are cut into overlapping chunks
    that are spread over the tasks and pre-tokenised there; the chunks of a text then meet again,
    are stitched where their pre-token boundaries coincide, and the pre-tokens are encoded.  Where a
    single pre-token covers an overlap, that text is pre-tokenised as a whole instead.

    Null and empty texts give empty arrays.  Repeated rows are encoded row by row, null keys stay,
    other columns are left out, an empty table gives no rows.  Bytes that are no UTF-8 become U+FFFD.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tokens, pattern))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > CHUNK

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            found = []
            for part in slices(batch.select([1])):
                found += [encoder.ids(encoder.pieces(value.decode("utf-8", "replace"))) for value in part["text"]]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(ids) // 4 for ids in found], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["key", "ids"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            found = []
            for part in slices(batch.select(["start", "chars", "text"]), 16):
                for start, chars, value in zip(part["start"], part["chars"], part["text"], strict=True):
                    found.append(cuts(encoder, value, start, start + len(value) >= chars))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("row", "key", "start", "text")), pa.array(found, pa.list_(pa.int64()))],
                ["row", "key", "start", "text", "cuts"],
            )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        encoder = encoder_of(shared)
        group = group.sort_values("start")
        starts = group["start"].tolist()
        ends = starts[1:]
        text = "".join(
            value[: ends[i] - starts[i]] if i < len(ends) else value for i, value in enumerate(group["text"])
        )
        at = stitch([(start, value, list(cut)) for start, value, cut in zip(starts, group["text"], group["cuts"], strict=True)])
        pieces = encoder.pieces(text) if at is None else [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        return pd.DataFrame({"key": group["key"].iloc[:1], "ids": [np.frombuffer(encoder.ids(pieces), "<i4")]})

    short = rows.filter(~long).select("key", text_bytes(F.col("text")).alias("text")).mapInArrow(whole, f"key {kind}, ids array<int>")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("chars") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = (
        rows.filter(long)
        .select(F.monotonically_increasing_id().alias("row"), "key", "text", F.length("text").cast("bigint").alias("chars"))
        .select("row", "key", "text", "chars", F.explode(starts).alias("start"))
        .select("row", "key", "start", "chars", F.substring("text", F.col("start").cast("int") + 1, F.lit(CHUNK + OVERLAP)).alias("text"))
        .repartition("row", "start")
        .mapInArrow(chunk, f"row bigint, key {kind}, start bigint, text string, cuts array<bigint>")
        .groupBy("row")
        .applyInPandas(join, f"key {kind}, ids array<int>")
    )
    return short.unionByName(chunks).withColumnRenamed("key", key)


def joined(ids: pa.ListArray, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each row's tokens, one after the other; a null row stays null.

    Arrow lays the tokens' bytes out in a single buffer, of which the rows are neighbouring parts.
    """
    bounds = ids.offsets.to_numpy()
    laid = tokens.take(ids.values.slice(bounds[0], bounds[-1] - bounds[0]))
    ends = np.frombuffer(laid.buffers()[1], np.int32)[bounds - bounds[0] + laid.offset] if len(laid) else np.zeros(len(bounds), np.int32)
    known = pa.py_buffer(np.packbits(~np.asarray(ids.is_null()), bitorder="little").tobytes()) if ids.null_count else None
    data = laid.buffers()[2] or pa.py_buffer(b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [known, pa.py_buffer(ends.tobytes()), data])


def decode(encoded: DataFrame, tokens: list[bytes], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``raw``: the bytes of the tokens, one after the other; null ids give null bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for batch in batches:
            raw = joined(batch.column(1), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], ["key", "ids", "raw"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, raw binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of its ids, and digests of the ids and of the bytes they decode to."""
    return decode(encode(docs, tokens, pattern, key, text), tokens, key).select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
