"""Language-model scores of whole documents: corpus counts, a recurrent network, and exact shares of rare words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm import gru
from modlytics.llm.common import stored, text_bytes

#: Stands for the end of a text; no word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    """``words`` have an output of their own; the ``known`` most frequent ones are broadcast with their counts.

    Other words fall into ``tails`` classes by their last three bytes.  Learners take one segment of
    ``segment`` tokens in ``every``, by default every token of all training texts; ``warm`` texts, of each
    the first ``warm_tokens`` tokens, give the weights from which they start.
    """

    words: int = 2048
    known: int = 131_072
    tails: int = 64
    width: int = 32
    segment: int = 128
    window: int = 32
    every: int = 1
    batch: int = 256
    warm: int = 800
    warm_tokens: int = 2048
    rounds: int = 4
    rate: float = 3e-3
    learners: int = 24
    texts: int = 2048
    seed: int = 5


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between the white space of each text with a blank on both sides, in one array, and each text's places.

    The first of a text is empty and no token; then come its words in lower-case A-Z, and the end.
    """
    spaced = pc.binary_join_element_wise(" ", pc.ascii_lower(texts.view(pa.string())), " ", "")
    lists = pc.ascii_split_whitespace(spaced)
    ends = lists.offsets.to_numpy()
    return lists.flatten(), ends - ends[0]


def parts(column: pa.Array, most: int = 16 << 20) -> Iterator[pa.Array]:
    """The texts in pieces of about ``most`` bytes, one text at least."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield column.slice(start, end - start)
        start = end


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all tokens of the column ``text``; tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column("text")):
                words, counts = pc.value_counts(tokens(part)[0]).flatten()
                # Of the two empty ones of a text, one is its end.
                counts = pc.if_else(pc.equal(words, ""), pc.subtract(counts, len(part)), counts)
                yield pa.RecordBatch.from_arrays([words.view(pa.binary()), counts], ["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words with their counts, the classes of all others, and the totals.

    ``listed`` holds the words, the arrays beside it what belongs to each.  ``ids`` are the network's: a word's rank, or behind the words the class of a rare word.  ``share``
    is log10 of a rare word's share in its class, 0 for words with an output of their own.
    """

    listed: pa.Array
    ids: np.ndarray
    more: np.ndarray
    share: np.ndarray
    endings: dict[bytes, int]
    class_totals: np.ndarray
    shape: gru.Shape
    total: int
    distinct: int

    def tail(self, word: bytes) -> int:
        return self.endings.get(word[-3:], len(self.class_totals) - 1)

    def read(self, texts: pa.Array) -> Read:
        """All texts as ids, without a look-up in Python of each word."""
        words, ends = tokens(texts)
        places = pc.fill_null(pc.index_in(words, value_set=self.listed.view(pa.string())), -1).to_numpy()
        other = np.flatnonzero(places < 0)
        rare = words.take(pa.array(other)).dictionary_encode()
        kinds = rare.indices.to_numpy()
        distinct = rare.dictionary.view(pa.binary())
        ids = self.ids[places]
        tails = np.array([self.tail(word) for word in distinct.to_pylist()], np.int64)
        ids[other] = self.shape.words + tails[kinds]
        # The first of each text is none of its tokens, and never rare.
        firsts = ends[:-1]
        return Read(np.delete(ids, firsts), np.delete(places, firsts), ends - np.arange(len(ends)), np.searchsorted(firsts, other, "right") - 1, kinds, distinct)


@dataclass
class Read:
    """Texts as the network's ``ids`` and the ``places`` of listed words (-1 for others), text after text; ``ends`` bound the texts.

    Of the other words, ``owners`` are their texts and ``kinds`` their places in ``distinct``.
    """

    ids: np.ndarray
    places: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    kinds: np.ndarray
    distinct: pa.Array

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of one value a token, the sum of each text."""
        return np.add.reduceat(values, self.ends[:-1]) if len(values) else values

    def texts(self) -> list[np.ndarray]:
        return [self.ids[start:end] for start, end in zip(self.ends, self.ends[1:])]

    def rare(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct other words of each text, how often each, and where those of each text end."""
        keys, times = np.unique(self.owners * max(1, len(self.distinct)) + self.kinds, return_counts=True)
        owners, kinds = np.divmod(keys, max(1, len(self.distinct)))
        return self.distinct.take(pa.array(kinds)), times, np.searchsorted(owners, np.arange(len(self.ends)))


def ending(word: Column) -> Column:
    return F.when(F.length(word) <= 3, word).otherwise(F.substring(word, F.length(word) - 2, F.lit(3)))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words of the larger counts, at most ``most``.

    Where they end is found from a histogram of at most some thousand steps of the counts' logarithm, so
    neither a sort nor each task's own top words come to the driver.  Of the step that does not fit whole, words
    are taken in the order of their hash, in slices: what stays free is less than one of 65,536 slices of that step.
    """
    level, slot = F.floor(F.log2("c") * 64), F.pmod(F.xxhash64("word"), F.lit(1 << 16))
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    total, wanted = 0, F.lit(False)
    for step in steps:
        if total + step["n"] > most:
            last = level == step["level"]
            slots = counts.filter(last).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).orderBy("slot").collect()
            end = 0
            for part in slots:
                total += part["n"]
                if total > most:
                    break
                end = part["slot"] + 1
            wanted = (level > step["level"]) | (last & (slot < end))
            break
        total += step["n"]
        wanted = level >= step["level"]
    return [(bytes(row["word"]), row["c"]) for row in counts.filter(wanted).collect()]


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """What the driver and the tasks hold: at most ``known`` words, and sums over all others."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    listed = sorted(frequent(counts, settings.known), key=lambda pair: (-pair[1], pair[0]))
    # The end always has an output of its own.
    head = [pair for pair in listed if pair[0] == END] or [(END, 0)]
    listed = head + [pair for pair in listed if pair[0] != END]
    words = min(settings.words, len(listed))
    own = {word for word, _ in listed[:words]}
    last = listed[words - 1] if words > 1 else (END, 0)
    # Everything behind the last word with an output of its own, in the order of counts.
    rare = counts.filter((F.col("c") < last[1]) | ((F.col("c") == last[1]) & (F.col("word") > F.lit(last[0]))) if words > 1 else F.col("word") != F.lit(END))
    rare = rare.filter(F.col("word") != F.lit(END))
    classes = rare.groupBy(ending(F.col("word")).alias("ending")).agg(F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("mass"))
    top = classes.orderBy(F.desc("c"), "ending").limit(settings.tails - 1).collect()
    masses = classes.agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("mass"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    endings = {bytes(row["ending"]): place for place, row in enumerate(top)}
    totals = np.array([row["mass"] for row in top] + [masses["mass"] - sum(row["mass"] for row in top)], np.float64) + 1
    tail_counts = [row["c"] for row in top] + [masses["c"] - sum(row["c"] for row in top)]
    shape = gru.Shape(words, len(totals), width=settings.width)
    found = Vocabulary(pa.array([word for word, _ in listed], pa.binary()), np.zeros(0), np.zeros(0), np.zeros(0), endings, totals, shape, sums["total"], sums["distinct"])
    kinds = np.array([0 if word in own else found.tail(word) for word, _ in listed])
    place = np.arange(len(listed))
    found.ids = np.where(place < words, place, words + kinds)
    found.more = np.log10(np.array([c for _, c in listed], np.float64) + 1)
    found.share = np.where(place < words, 0.0, found.more - np.log10(totals[kinds]))
    found.frequencies = np.array([c for _, c in listed[:words]] + tail_counts, np.float64)
    return found


def segments(stream: np.ndarray, settings: Settings) -> np.ndarray:
    count = len(stream) // settings.segment
    return stream[: count * settings.segment].reshape(count, settings.segment)


def drawn(texts: DataFrame, number: float, settings: Settings) -> DataFrame:
    """(text, draw): about ``warm`` of the ``number`` rows, each drawn by itself, so copies of a text come in their share."""
    chance = F.pmod("draw", F.lit(1 << 30)) < int(min(1.0, settings.warm / max(1, number)) * (1 << 30))
    return texts.select("text", F.xxhash64("text", F.monotonically_increasing_id(), F.lit(settings.seed)).alias("draw")).filter(chance)


def warm_up(texts: DataFrame, known: Vocabulary, shared, settings: Settings) -> gru.Weights:
    """Weights from a bounded sample of the training texts, from which the learners start."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in parts(batch.column("text")):
                found += [ids[: settings.warm_tokens].astype("<i4").tobytes() for ids in shared.value.read(part).texts()]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(found, pa.binary())], ["draw", "ids"])

    rows = sorted(drawn(texts, known.frequencies[0], settings).mapInArrow(read, "draw bigint, ids binary").collect(), key=lambda row: (row["draw"], row["ids"]))
    learn = [np.frombuffer(row["ids"], "<i4").astype(np.int64) for row in rows]
    weights = gru.fresh(known.shape, known.frequencies, settings.seed)
    trainer, rng = gru.Trainer(weights, known.shape, settings.rate), np.random.default_rng(settings.seed)
    for _ in range(settings.rounds):
        order = rng.permutation(len(learn))
        ready = segments(np.concatenate([learn[i] for i in order]), settings) if len(learn) else np.empty((0, settings.segment), np.int64)
        for low in range(0, len(ready), 64):
            trainer.learn(ready[low : low + 64], 0, settings.window)
    return weights


def averaged(rows: DataFrame, shape: gru.Shape) -> bytes | None:
    """The mean of the learners' weights by the tokens they saw, in two levels of groups."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        seen, total = int(group["seen"].sum()), None
        for count, raw in zip(group["seen"], group["weights"], strict=True):
            part = np.frombuffer(raw, np.float32).astype(np.float64) * (count / max(seen, 1))
            total = part if total is None else total + part
        return pd.DataFrame({"part": [0], "seen": [seen], "weights": [total.astype(np.float32).tobytes()]})

    kind = "part bigint, seen bigint, weights binary"
    first = rows.groupBy("part").applyInPandas(mean, kind).groupBy("part").applyInPandas(mean, kind).first()
    return bytes(first["weights"]) if first else None


def passes(texts: DataFrame, shared, begin, settings: Settings) -> DataFrame:
    """(part, seen, weights) of each learner after its pass; ``seen`` is how many tokens it learnt from."""
    learners = max(settings.learners, texts.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, int(learners**0.5))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        mine = gru.unpacked(begin.value, known.shape)
        trainer = gru.Trainer(mine, known.shape, settings.rate / 3)
        rest, ready, held, seen, number = np.empty(0, np.int64), [], 0, 0, 0
        part = 0
        for batch in batches:
            for piece in parts(batch.column("text")):
                stream = np.concatenate([rest, known.read(piece).ids])
                cut = segments(stream, settings)
                rest = stream[cut.size :]
                part = part or int(stream[: 64].sum())
                ready.append(cut[(-number) % settings.every :: settings.every])
                number += len(cut)
                held += len(ready[-1])
                if held >= settings.batch:
                    whole, full = np.concatenate(ready), held // settings.batch * settings.batch
                    for low in range(0, full, settings.batch):
                        trainer.learn(whole[low : low + settings.batch], 0, settings.window)
                    ready, held, seen = [whole[full:].copy()], held - full, seen + full * settings.segment
        if held:
            trainer.learn(np.concatenate(ready), 0, settings.window)
            seen += held * settings.segment
        # What is left is a shorter segment.
        if len(rest) and number % settings.every == 0:
            trainer.learn(rest[None], 0, settings.window)
            seen += len(rest)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part % groups]), pa.array([seen]), pa.array([gru.packed(mine, known.shape)], pa.binary())], ["part", "seen", "weights"]
            )

    return texts.select("text").coalesce(learners).mapInArrow(learn, "part bigint, seen bigint, weights binary")


def train(texts: DataFrame, known: Vocabulary, shared, settings: Settings) -> gru.Weights:
    """Learners start from common weights, pass over all training texts, each over its own, and are averaged."""
    weights = warm_up(texts, known, shared, settings)
    begin = texts.sparkSession.sparkContext.broadcast(gru.packed(weights, known.shape))
    mean = averaged(passes(texts, shared, begin, settings), known.shape)
    return weights if mean is None else gru.unpacked(mean, known.shape)


def score_texts(docs: DataFrame, learn: Column, carry: list[str], text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The columns in ``carry`` with n_tokens, n_known, train_tokens, base_score and score, for every row of ``docs``.

    Counts cover all texts where ``learn`` holds.  ``base_score`` is the sum of log10 of the tokens' shares in
    the training tokens, with one added to each count.  ``score`` is log10 of the network's
    probability of the whole text, its state carried from the first token to the end: of each token's class,
    times the word in the class; a rare word counts by its training count in its class, plus one.

    Words outside the broadcast vocabulary are joined to the counts, so every count is exact.  Null
    texts count as empty, which is one token, the end.  Repeated rows are scored row by row, null
    keys stay, an empty table gives no rows; without training texts the network keeps its first weights.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    ready = docs.withColumn("_learn", learn).select(*(F.col(name).alias(f"c{place}") for place, name in enumerate(carry)), "_learn", text_bytes(F.col(text)).alias("text"))
    training = ready.filter("_learn").select("text")
    counts = stored(count_words(training))
    known = vocabulary(counts, settings)
    shared = spark.sparkContext.broadcast(known)
    weights = train(training, known, shared, settings)
    final = spark.sparkContext.broadcast(gru.packed(weights, known.shape))
    kinds = ", ".join(f"c{place} {docs.schema[name].dataType.simpleString()}" for place, name in enumerate(carry))
    own = "row bigint, n_tokens bigint, n_common bigint, base double, score double, rare array<struct<word:binary,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        mine = gru.unpacked(final.value, known.shape)
        log_totals = np.log10(known.class_totals)
        for batch in batches:
            sizes, common, base, scores, rares, ids = [], [], [], [], [], []
            for start in range(0, batch.num_rows, settings.texts):
                read = known.read(batch.column("text").slice(start, settings.texts))
                there = read.places >= 0
                more = np.where(there, known.more[read.places], 0.0)
                shares = np.where(there, known.share[read.places], 0.0)
                shares[~there] -= log_totals[read.ids[~there] - known.shape.words]
                sizes.append(np.diff(read.ends))
                common.append(read.sums((more > 0).astype(np.int64)))
                base.append(read.sums(more))
                scores.append(read.sums(shares))
                ids += read.texts()
                words, times, ends = read.rare()
                pairs = pa.StructArray.from_arrays([words, pa.array(times, pa.int32())], ["word", "n"])
                rares.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
            if not sizes:
                continue
            sizes, common, base, scores, rares = *(np.concatenate(found) for found in (sizes, common, base, scores)), pa.concat_arrays(rares)
            scores += gru.score(ids, 0, mine, known.shape) / np.log(10)
            keep = [batch.column(place) for place in range(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*keep, batch.column("row"), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), rares],
                [*(f"c{place}" for place in range(len(carry))), "row", "n_tokens", "n_common", "base", "score", "rare"],
            )

    scored = stored(
        ready.drop("_learn").withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"{kinds}, {own}" if kinds else own)
    )
    words = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.n")
    c = F.coalesce("c", F.lit(0).cast("bigint"))
    rest = (
        words.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(c + 1)).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("found"))
    )
    floor = float(np.log10(known.total + known.distinct + 1))
    return scored.drop("rare").join(rest, "row", "left").select(
        *(F.col(f"c{place}").alias(name) for place, name in enumerate(carry)),
        "n_tokens",
        (F.col("n_common") + F.coalesce("found", F.lit(0).cast("bigint"))).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
