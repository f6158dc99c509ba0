from __future__ import annotations

import random
from collections import Counter

import pytest

from modlytics.llm import repetition as R

WHITE = " \t\n\x0b\x0c\r"


def plain(text: str | None) -> tuple:
    """The base counts, word by word."""
    text = text or ""
    words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    earlier, dup = set(), 0
    for line in lines:
        dup += line in earlier
        earlier.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    pieces = ["a", "bé", "漢", " x", "#", "|", "\n", "\n\n", "  ", "\x1c", "word", "tail\t", "\U0001f600"]
    found = [None, "", "\n", " ".join("abc" for _ in range(50))]
    found += ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))
    return [*found, base, base + "\n" + base, base + " x y z " + base]


def test_base_counts_equal_a_plain_version(spark):
    rows = list(enumerate(texts(1)))
    out = R.repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {key: plain(text) for key, text in rows}
    assert all(not (r.kept and r.base_failed) for r in out)


@pytest.mark.parametrize("n", [3, 5, 10])
def test_repeated_windows_equal_a_plain_version(n):
    rng = random.Random(n)
    words = [b"%d" % rng.randint(0, 3) for _ in range(200)]
    counts = Counter(tuple(words[i : i + n]) for i in range(200 - n + 1))
    want = [any(counts[tuple(words[i : i + n])] > 1 for i in range(max(0, at - n + 1), min(at, 200 - n) + 1)) for at in range(200)]
    windows = next(R.rolling(R.word_hashes(words), [n], R.Powers()))[1]
    got = R.inside_repeats(windows, n, 200)
    assert (got.tolist() if got is not None else [False] * 200) == want


def test_verdict_keeps_clean_and_drops_repetition(spark):
    rng = random.Random(9)
    clean = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    line = " ".join(f"v{i}" for i in range(12))
    rows = [(1, clean), (2, "\n".join([line] * 10 + [clean[:200]])), (3, " ".join(["on and on"] * 40)), (4, clean.replace(" ", "*** ", 200))]
    verdict = {r.doc_id: r.kept for r in R.repetition(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert verdict == {1: True, 2: False, 3: False, 4: False}


def test_awkward_rows(awkward, empty):
    out = R.repetition(awkward).collect()
    assert len(out) == 8 and sum(r.doc_id is None for r in out) == 1
    assert all(r.n_words == 0 and not r.kept for r in out if r.doc_id in (2, 3, 4))
    assert R.repetition(empty).count() == 0
    kept = R.kept_rows(awkward)
    assert kept.columns == awkward.columns and [r.doc_id for r in kept.collect()] == [5]
    assert R.kept_rows(empty).count() == 0
