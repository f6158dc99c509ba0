from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from modlytics.llm import interaction as I

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """Every order run over the documents one after the other."""
    good = {key for key, quality, _ in labels if quality == 1 and key is not None}
    toxic = {key for key, _, flag in labels if flag == 1 and key is not None}
    least: dict[str, int] = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    rows = []
    for key, text, part in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": key is not None and key > least[text],
        }
        rows.append((key, part or "", {name for name, fails in failed.items() if fails}))
    out: dict[tuple, list[int]] = {}
    shapley: Counter = Counter()
    for part in {part for _, part, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [row for row in rows if row[1] == part]
            gone: list = []
            for step, name in enumerate(order, 1):
                lost = [row for row in left if name in row[2]]
                again = sum(name in row[2] for row in gone)
                left = [row for row in left if name not in row[2]]
                gone += lost
                alone = sum(row[2] == {name} for row in rows if row[1] == part)
                out[part, order, step] = [
                    len(left), len(lost), again, alone,
                    sum(row[0] in good for row in lost), sum(row[0] in toxic for row in lost),
                ]
                shapley[part, name] += len(lost)
    return {key: (*counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in out.items()}


def made() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(rng.choice(words[:rng.choice([20, 400])]) for _ in range(rng.choice([5, 199, 200, 260]))) for _ in range(25)]
    texts += [text.upper() for text in texts[:6]] + [f"{text} #" for text in texts[6:12]] + ["", None, " \n", "é" * 300]
    docs = [(n, rng.choice(texts), rng.choice(["a", "b", "", None])) for n in range(160)]
    docs += [(None, texts[0], "a"), (None, "", "b"), (3, texts[0], "a"), (3, texts[0], "a")]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1])) for n in range(0, 160, 2)] + [(4, 1, 0), (None, 1, 1)]
    return docs, labels


def test_every_order_equals_running_it(spark):
    docs, labels = made()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(7)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = {(r.part, r.filter_order, r.step): tuple(r[name] for name in I.COUNTS) for r in I.audit(frame, known).collect()}
    assert out == brute(docs, labels)


def test_a_table_is_contracted_on_its_axes():
    cell = {"code": 0b10001, "n": 5, "good": 2, "toxic": 1}
    tables = I.Tables([[cell, {"code": 0, "n": 7, "good": 0, "toxic": 0}]])
    assert tables.chosen("", "A").tolist() == [[5, 2, 1]] and tables.chosen("A", "E").tolist() == [[0, 0, 0]]
    assert tables.chosen().tolist() == [[12, 2, 1]]


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = I.audit(awkward, labels)
    assert out.count() == 600 * 4
    first = {r.part: r for r in out.filter("filter_order = 'EABCD' and step = 1").collect()}
    # The null and the empty text are the same text; the repeated least row passes.
    assert {part: (row.kept, row.removed) for part, row in first.items()} == {"a": (3, 0), "b": (2, 0), "c": (1, 0), "": (1, 1)}
    assert I.audit(empty, labels).count() == 0
    assert I.audit(awkward, labels.limit(0)).count() == 600 * 4
