from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from modlytics.llm import bpe

TOKENS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding(
    "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks={token: rank for rank, token in enumerate(TOKENS)}, special_tokens={}
)


def texts() -> list[str | None]:
    rng = random.Random(4)
    pieces = ["ab", "C", " ", "  ", "'re", "'", "\n", "12", "é", "漢", "!", "\U0001f600", "tion", "　", "<|endoftext|>"]
    found = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    # Longer than a chunk: mixed, one run of letters, runs of white space longer than the overlap.
    found.append("".join(rng.choice(pieces) for _ in range(40_000)))
    return [None, "", *found, "a" * 70_000, (" " * 700 + "x") * 100, ("word " * 5 + "b" * 600) * 60]


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    rows = list(enumerate(texts()))
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENS, public_tokenizers.PATTERN)
    out = {r.doc_id: r for r in bpe.decode(encoded, TOKENS).collect()}
    assert len(out) == len(rows)
    for key, text in rows:
        assert list(out[key].ids) == LIBRARY.encode_ordinary(text or ""), key
        assert bytes(out[key].raw) == (text or "").encode()


def test_digests(spark):
    text = "the quick brown fox"
    row = bpe.digests(spark.createDataFrame([(1, text)], "doc_id int, text string"), TOKENS, public_tokenizers.PATTERN).first()
    ids = LIBRARY.encode_ordinary(text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_both_merges_agree(seed):
    rng = random.Random(seed)
    ranks = {token: rank for rank, token in enumerate(TOKENS)}
    for _ in range(40):
        piece = "".join(rng.choice("abinterstion ") for _ in range(rng.randint(1, 90))).encode()
        assert bpe.merge_short(piece, ranks) == bpe.merge_long(piece, ranks)


def test_stitching_needs_a_common_start():
    assert bpe.stitch([(0, "", [0, 2, 5]), (4, "", [4, 5, 9])]) == [0, 2, 5, 9]
    assert bpe.stitch([(0, "", [0, 2]), (4, "", [4, 6])]) is None


def test_awkward_rows(awkward, empty):
    out = bpe.digests(awkward, TOKENS, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens == 0 for r in out.collect()) == [False] * 6 + [True] * 2
    assert bpe.digests(empty, TOKENS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(awkward.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), TOKENS).filter("raw is null").count() == 8


def test_rows_are_joined_without_a_list_of_tokens():
    tokens = pa.array([b"a", b"", b"\xff\x00", b"word"], pa.binary())
    rows = [[3, 0], None, [], [2, 1, 2], [0], None, [3] * 5]
    want = [None if row is None else b"".join(tokens[i].as_py() for i in row) for row in rows]
    ids = pa.array(rows, pa.list_(pa.int32()))
    for low in range(len(rows) + 1):
        for high in range(low, len(rows) + 1):
            assert bpe.joined(ids[low:high], tokens).to_pylist() == want[low:high]
