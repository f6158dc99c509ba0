"""Quality rules on repetition: how many characters of a text lie inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, text_bytes

#: An odd multiplier has an inverse modulo 2**64, which lets windows be read off one running sum.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    ``gram_shares``: n-gram length -> largest share of a text's word characters inside n-grams of
    that length that occur twice or more.  ``line_share``: the same for lines equal to an earlier
    line.  ``symbols_per_word``: symbols against words.
    """

    gram_shares: dict[int, float] = field(default_factory=lambda: {3: 0.40, 5: 0.30, 8: 0.30, 10: 0.30})
    line_share: float = 0.30
    symbols_per_word: float = 0.10
    symbols: bytes = b"#*$%&|<>"
    base_gram: int = 8
    min_words: int = 20
    base_percent: int = 30


class Powers:
    """Powers of the multiplier and of its inverse, kept for the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))

            def powers(base: int) -> np.ndarray:
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            self.up, self.down = powers(STEP), powers(BACK)
        return self.up[:n], self.down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, lengths: list[int], powers: Powers) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the 64-bit hash of every window of so many words."""
    up, down = powers.get(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    for n in lengths:
        windows = len(hashes) - n + 1
        yield n, (sums[n:] - sums[:windows]) * down[:windows] if windows > 0 else np.empty(0, np.uint64)


def inside_repeats(windows: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Which words lie in a window found twice or more; None if no window is."""
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return None
    twice = np.unique(twice)
    at = np.searchsorted(twice, windows)
    at[at == len(twice)] = 0
    starts = np.flatnonzero(twice[at] == windows)
    edges = np.zeros(words + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + n, 1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: bytes, rules: Rules, powers: Powers) -> tuple:
    """The counts and the verdict for one text."""
    words = text.split()
    count = len(words)
    symbols = len(text) - len(text.translate(None, rules.symbols))
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen: set[bytes] = set()
    again = []
    for line in lines:
        if line in seen:
            again.append(line)
        else:
            seen.add(line)
    if not count:
        return 0, 0, symbols, 0, 0, 0.0, 0.0, True, False
    joined = b"".join(words)
    sizes = np.fromiter(map(len, words), np.int64, count)
    if len(joined) == len(joined.decode("utf-8", "replace")):
        chars = sizes
    else:
        first = (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80
        chars = np.add.reduceat(first, np.cumsum(sizes) - sizes, dtype=np.int64)
    total = int(chars.sum())
    repeated, worst, failed = 0, 0.0, False
    lengths = sorted({rules.base_gram, *rules.gram_shares})
    for n, windows in rolling(word_hashes(words), lengths, powers):
        inside = inside_repeats(windows, n, count)
        if inside is None:
            break  # no repeated window of n words, so none of more
        if n == rules.base_gram:
            repeated = int(inside.sum())
        if n in rules.gram_shares:
            share = float(chars[inside].sum()) / total
            worst = max(worst, share)
            failed |= share > rules.gram_shares[n]
    copied = sum(len(b"".join(line.split()).decode("utf-8", "replace")) for line in again) / total
    failed |= copied > rules.line_share or symbols > rules.symbols_per_word * count
    base = count < rules.min_words or 100 * repeated > rules.base_percent * count
    return count, total, symbols, len(again), repeated, worst, copied, base, not (base or failed)


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "gram_share double, line_share double, base_failed boolean, kept boolean"
)


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Counts, repetition shares and a verdict for every row of ``docs``.

    Each text is read whole, inside the task that scans it; nothing is shuffled.  Words are hashed
    once, windows of several lengths are read off one running sum of those hashes modulo 2**64, and
    the characters of all words inside windows found twice or more are added up.

    Null and empty texts have no words: all counts 0, ``base_failed`` true and ``kept`` false.
    Repeated rows are measured row by row, a null key stays null, other columns are left out, and
    an empty table gives no rows.  Two different windows share a 64-bit hash with a probability of
    about the square of the text's words over 2**65.
    """
    rules = rules or Rules()
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {SCHEMA}"
    names = [key, *(part.split()[0] for part in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            found = []
            for part in slices(batch.select([1])):
                found += [measure(value, rules, powers) for value in part["text"]]
            columns = list(zip(*found, strict=True)) if found else [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return docs.select(F.col(key), text_bytes(F.col(text)).alias("text")).mapInArrow(run, out)


def kept_rows(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns and nothing else.

    The verdict is taken row by row as an Arrow-batched column, so no join puts it back to the rows.
    """
    rules = rules or Rules()

    @F.pandas_udf("boolean")
    def passes(values):
        powers = Powers()
        return values.map(lambda value: measure(bytes(value), rules, powers)[-1]).astype(bool)

    verdict: Column = passes(text_bytes(F.col(text)))
    return docs.filter(verdict)
