from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from modlytics.llm import bagminhash as B
from modlytics.llm.graph import components
from modlytics.llm.repetition import Powers

SETTINGS = B.Settings()


def plain_similarity(left: str, right: str) -> float:
    bags = []
    for text in (left, right):
        words = text.split()
        n = min(5, len(words))
        bags.append(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter())
    total = sum((bags[0] | bags[1]).values())
    return sum((bags[0] & bags[1]).values()) / total if total else 0.0


def plain_classes(rows: list) -> list:
    up = list(range(len(rows)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, left) in enumerate(rows):
        for j in range(i):
            if left and rows[j][1] and plain_similarity(left, rows[j][1]) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for place, (key, _) in enumerate(rows):
        members[top(place)].append(key)
    return sorted(str((key, min((k for k in keys if k is not None), default=None), len(keys))) for keys in members.values() for key in keys)


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocab) for _ in range(120)]
    # One group of copies with very different noise, pairs, copies, and texts that share a passage.
    rows = [(k, " ".join(w if rng.random() > noise else rng.choice(vocab) for w in base)) for k in range(150) for noise in [rng.random() * 0.08]]
    rows += [(k, " ".join(base[:60] + [rng.choice(vocab) for _ in range(60)])) for k in range(200, 240)]
    rows += [(k, " ".join(rng.choice(vocab) for _ in range(40))) for k in range(300, 340)]
    rows += [(500, rows[0][1]), (None, rows[1][1]), (501, "a b"), (502, "a b"), (503, "a b c"), (504, "spam ham eggs " * 40), (505, "spam ham eggs " * 42)]
    out = B.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in out) == plain_classes(rows)
    firsts = Counter(r.class_id for r in out if r.first_of_class)
    assert set(firsts.values()) == {1} and len(firsts) == len({r.class_id for r in out})


def test_signatures_estimate_weighted_similarity():
    rng, powers, errors = random.Random(3), Powers(), []
    for trial in range(30):
        left = [f"w{rng.randint(0, 40)}" for _ in range(250)]
        right = [w if rng.random() > 0.02 else "new" for w in left] * (1 + trial % 3)
        texts = [" ".join(part).encode() for part in (left, right)]
        marks, _, _ = B.sign(texts, SETTINGS, powers)
        true = plain_similarity(texts[0].decode(), texts[1].decode())
        assert abs(B.overlap(B.bag(texts[0], 5, powers), B.bag(texts[1], 5, powers)) - true) < 1e-12
        errors.append(float(B.estimated(marks[0], marks[1])) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_block_search_joins_all_that_is_linked():
    powers, rng = Powers(), random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(30)).encode() for _ in range(90)]
    bags = B.Bags(texts, 5, powers)
    other = B.bag(texts[0], 5, powers)
    few, all_places = np.arange(10), np.arange(90)
    want = [B.overlap(B.bag(text, 5, powers), other) for text in texts]
    assert np.allclose(bags.overlaps(other, few), want[:10]) and np.allclose(bags.overlaps(other, all_places), want)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1), (20, 10), (20, 30), (30, 40)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7, 10: 10, 20: 10, 30: 10, 40: 10}


def test_awkward_rows(awkward, empty):
    out = B.classes(awkward)
    assert out.columns == [*(n for n in awkward.columns if n != "class_id"), "class_id", "class_size", "first_of_class"]
    rows = out.collect()
    assert len(rows) == 8 and sum(r.class_size == 2 for r in rows) == 2
    first = B.first_rows(awkward)
    assert first.columns == awkward.columns and first.count() == 7
    assert B.classes(empty).count() == 0
