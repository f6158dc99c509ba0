"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, stored, text_bytes

WORDS = re.compile(r"[^\W\d_]+")
#: Words that address someone, for the pattern voters; the first of several languages.
ADDRESS = frozenset("you your u are du dich bist ihr tu te toi es vous eres usted".split())
PATTERNS = ("two hit words", "three hit words", "hit near address", "shouted hit", "exclaimed", "nothing found", "long and nothing found")


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled texts to learn from, for each label, at most about that many.

    ``units``: words and word beginnings that the lexicon may hold; ``stems``: lengths of the latter.
    ``lift``: how much more frequent a lexicon unit is in toxic texts; ``support``: in how many at least.
    """

    sample: int = 5000
    units: int = 400
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    lift: float = 20.0
    support: int = 6
    rounds: int = 30
    steps: int = 400
    seed: int = 11


#: How many words in a thousand have a beginning at least, for each of its units.
RATES = (4, 8, 14)


def stem_units(words: Counter[str], n: int, wanted: frozenset[str] | None = None) -> Iterator[str]:
    """The units of the beginnings of n letters that a text has: ``stem*4`` means four words in a thousand or more."""
    stems: Counter[str] = Counter()
    for word, count in words.items():
        if len(word) > n and (wanted is None or word[:n] in wanted):
            stems[word[:n]] += count
    total = words.total()
    for stem, count in stems.items():
        for rate in RATES:
            if 1000 * count >= rate * total:
                yield f"{stem}*{rate}"


def units_of(words: Counter[str], settings: Settings) -> set[str]:
    """Words, and their beginnings by how frequent they are."""
    found = set(words)
    for n in settings.stems:
        found.update(stem_units(words, n))
    return found


@dataclass
class Lexicon:
    """The units whose presence votes for toxic, by their place."""

    units: dict[str, int]
    settings: Settings

    def __post_init__(self) -> None:
        self.whole = frozenset(unit for unit in self.units if "*" not in unit)
        stems = {unit.split("*")[0] for unit in self.units if "*" in unit}
        self.begin = {n: found for n in self.settings.stems if (found := frozenset(stem for stem in stems if len(stem) == n))}

    def features(self, text: str) -> tuple[list[int], list[int]]:
        """The units that a text has, and the votes of the pattern voters: 1, 0 (abstains) or -1."""
        distinct = Counter(WORDS.findall(text.lower()))
        names = self.whole & distinct.keys()
        for n, begin in self.begin.items():
            names |= {name for name in stem_units(distinct, n, begin) if name in self.units}
        found = [self.units[name] for name in names]
        votes = [0] * len(PATTERNS)
        if not found:
            votes[5] = -1
            votes[6] = -1 if len(distinct) >= 50 else 0
            return [], votes
        words = WORDS.findall(text)
        starts = tuple({name.split("*")[0] for name in names if "*" in name})
        at = [place for place, word in enumerate(words) if (low := word.lower()) in names or low.startswith(starts)]
        kinds = {words[place].lower() for place in at}
        votes[0] = int(len(kinds) > 1)
        votes[1] = int(len(kinds) > 2)
        votes[2] = int(any(word.lower() in ADDRESS for place in at for word in words[max(0, place - 4) : place + 3]))
        votes[3] = int(any(len(words[place]) > 2 and words[place].isupper() for place in at))
        votes[4] = int("!" in text)
        return sorted(found), votes


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, text: str, key: str, label: str, settings: Settings) -> DataFrame:
    """Labelled texts to learn from: about ``sample`` of each label, drawn by a hash of the key, in a table.

    Keys are drawn before any text is read, and only theirs are joined: a table of at most three times ``sample``
    rows, so it is broadcast and no text is shuffled but the sample's own.  Of repeated rows one counts.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    rows = docs.filter(learn).select(F.col(key).alias("key")).distinct().join(known, "key")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    draw = F.xxhash64("key", F.lit(settings.seed))
    chance = F.pmod(draw, F.lit(1 << 30)) * F.col("n") < F.lit(settings.sample * (1 << 30))
    drawn = stored(rows.join(counts, "label").filter(chance).select("key", "label", draw.alias("draw")).limit(3 * settings.sample))
    texts = docs.filter(learn).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(drawn), "key").groupBy("key", "label", "draw").agg(F.min("text").alias("text")))


def mine(sample: DataFrame, settings: Settings) -> Lexicon:
    """The lexicon: units far more frequent in toxic texts, in how many texts they are counted by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            names = sorted(toxic.keys() | clean.keys())
            arrays = [pa.array(names, pa.string())]
            arrays += [pa.array([counts[name] for name in names], pa.int64()) for counts in (toxic, clean)]
            toxic.clear()
            clean.clear()
            return pa.RecordBatch.from_arrays(arrays, ["unit", "toxic", "clean"])

        for batch in batches:
            for part in slices(batch, 64):
                for value, label in zip(part["text"], part["label"], strict=True):
                    words = Counter(WORDS.findall(value.lower()))
                    (toxic if label else clean).update(units_of(words, settings))
                if len(toxic) + len(clean) > 400_000:
                    yield flush()
        yield flush()

    texts = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = texts.get(1, 0), texts.get(0, 0)
    counts = (
        sample.select("text", "label").mapInArrow(count, "unit string, toxic bigint, clean bigint")
        .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    lift = (F.col("toxic") / max(bad, 1)) / ((F.col("clean") + 0.5) / max(good, 1))
    support = min(settings.support, max(2, bad // 20))
    top = counts.filter(F.col("toxic") >= support).withColumn("lift", lift).filter(F.col("lift") >= settings.lift)
    best = top.orderBy(F.desc("toxic"), F.desc("lift"), "unit").limit(10 * settings.units).collect()
    # Beginnings of one word have its counts; the longest of them says the same as all.
    longest: dict[tuple, str] = {}
    for row in best:
        stem, _, rate = row["unit"].partition("*")
        family = (row["toxic"], row["clean"], stem[: min(settings.stems)])
        if family not in longest or len(stem) > len(longest[family].partition("*")[0]):
            longest[family] = row["unit"]
    return Lexicon({unit: place for place, unit in enumerate(list(longest.values())[: settings.units])}, settings)


@dataclass
class LabelModel:
    """P(vote | label) of every voter, and how much of its evidence is its own."""

    prior: float
    chances: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes); a vote's log-odds counts for the share that correlated voters leave it."""
        place = votes + 1
        gain = np.log(self.chances[:, 1]) - np.log(self.chances[:, 0])
        odds = np.log(self.prior / (1 - self.prior)) + (gain[np.arange(votes.shape[1]), place] * self.share).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(votes: np.ndarray, labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Posterior labels of a generative model, fitted by expectation maximisation, begun at the labels.

    A voter's accuracy is its distribution of votes under each label.  Voters are correlated when
    their votes still go together among texts of one label (expected label, weighted by the posterior).  A
    voter that goes along with others shares its evidence with them.
    """
    n, voters = votes.shape
    belief = np.where(labels > 0, 0.98, 0.02)
    one_hot = np.stack([votes == value for value in (-1, 0, 1)], axis=2).astype(float)
    model = LabelModel(0.5, np.full((voters, 2, 3), 1 / 3), np.ones(voters))
    for _ in range(settings.rounds):
        weight = np.stack([1 - belief, belief])
        chances = (np.einsum("yn,nvk->vyk", weight, one_hot) + 0.1) / (weight.sum(axis=1)[None, :, None] + 0.3)
        signal = votes.astype(float)
        joint = np.zeros((voters, voters))
        for y in range(2):
            total = max(weight[y].sum(), 1e-9)
            centred = (signal - weight[y] @ signal / total) * np.sqrt(weight[y] / total)[:, None]
            joint += weight[y].sum() / n * (centred.T @ centred)
        spread = np.sqrt(np.maximum(np.diag(joint), 1e-9))
        together = np.abs(joint / spread[:, None] / spread[None, :])
        np.fill_diagonal(together, 1.0)
        share = 1 / np.where(together > 0.2, together, 0).sum(axis=1)
        model = LabelModel(float(np.clip(belief.mean(), 0.02, 0.98)), chances, share)
        before, belief = belief, model.posterior(votes)
        # What is known of a text's label counts as one more voter, right 95 times in 100.
        odds = np.log(belief / (1 - belief)) + np.where(labels > 0, 1, -1) * np.log(19)
        belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(belief - before).max() < 1e-4:
            break
    return belief


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found, votes = self.lexicon.features(text)
        odds = self.bias + sum(self.weights[place] for place in found)
        odds += sum(vote * self.weights[len(self.lexicon.units) + place] for place, vote in enumerate(votes) if vote)
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    settings: Settings | None = None,
) -> Model:
    """Mine voters from a bounded sample of labelled texts, model their votes, fit the classifier.

    The driver receives the lexicon and, for each sampled text, the places of its units and seven votes.
    """
    settings = settings or Settings()
    sample = sampled(docs, labels, learn, text, key, label, settings)
    lexicon = mine(sample, settings)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = []
            for part in slices(batch, 64):
                found += [known.features(value) for value in part["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    batch.column("draw"),
                    pa.array([units for units, _ in found], pa.list_(pa.int32())),
                    pa.array([votes for _, votes in found], pa.list_(pa.int32())),
                ],
                ["label", "draw", "units", "votes"],
            )

    rows = sample.select("text", "label", "draw").mapInArrow(vote, "label int, draw bigint, units array<int>, votes array<int>").collect()
    rows.sort(key=lambda row: (row["draw"], row["label"]))
    width = len(lexicon.units) + len(PATTERNS)
    votes = np.zeros((len(rows), width), np.int8)
    for place, row in enumerate(rows):
        votes[place, row["units"]] = 1
        votes[place, len(lexicon.units) :] = row["votes"]
    truth = np.array([row["label"] for row in rows], np.int8)
    if not len(rows) or truth.min() == truth.max():
        constant = 0.0 if not len(rows) or truth.max() == 0 else 1.0
        return Model(Lexicon({}, settings), np.zeros(len(PATTERNS)), 10.0 * (2 * constant - 1))
    belief = label_model(votes, truth, settings)
    weights, bias = logistic(votes.astype(float), belief, settings)
    return Model(lexicon, weights, bias)


def logistic(inputs: np.ndarray, belief: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """A linear classifier on posterior labels, by full-batch gradient steps with momentum and a small penalty."""
    weights, bias = np.zeros(inputs.shape[1]), 0.0
    speed, lean = np.zeros_like(weights), 0.0
    for _ in range(settings.steps):
        error = 1 / (1 + np.exp(-np.clip(inputs @ weights + bias, -30, 30))) - belief
        # Rare units share in the step by the root of their frequency.
        pull = inputs.T @ error / np.sqrt(len(inputs) * np.maximum(np.abs(inputs).sum(axis=0), 1)) + 1e-4 * weights
        speed, lean = 0.9 * speed - 0.3 * pull, 0.9 * lean - 0.3 * float(error.mean())
        weights, bias = weights + speed, bias + lean
    return weights, bias


def score_texts(docs: DataFrame, model: Model, carry: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns in ``carry`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), for every row.

    Every text is read whole where it is scanned.  Null and empty texts have no unit and get the score
    of such texts.  Repeated rows give equal scores, null keys stay, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        known = shared.value
        found: list[float] = []
        for part in slices(pa.RecordBatch.from_arrays([values], ["text"])):
            found += [known.score(value.decode("utf-8", "replace")) for value in part["text"]]
        return pa.array(found, pa.float64())

    names = [name for name in carry if name not in ("score", "predicted")]
    scored = docs.select(*names, score(text_bytes(F.col(text))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
