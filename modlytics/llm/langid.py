"""Language identification by averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled texts to learn from, for each language, at most about that many.

    ``accuracy``: what predictions that are not rejected should reach, on texts kept back from learning.
    """

    sample: int = 600
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (2, 3, 4)
    width: int = 16
    epochs: int = 6
    rate: float = 0.5
    batch: int = 32
    accuracy: float = 0.995
    chunk: int = 1 << 17
    seed: int = 7


#: Bytes by class: small letters and bytes of other scripts stay, capitals become small, the rest is a word edge.
FOLD = bytes(
    value if value >= 128 or 97 <= value <= 122 else value + 32 if 65 <= value <= 90 else 32 for value in range(256)
)


def subwords(text: bytes, settings: Settings) -> Iterator[np.ndarray]:
    """The buckets of all subwords of a text, chunk by chunk.

    A subword is a run of bytes inside a word; it may begin or end with a word's edge.
    """
    longest = max(settings.grams)
    folded = b" " + text.translate(FOLD) + b" "
    for start in range(0, max(len(folded) - 1, 1), settings.chunk):
        part = np.frombuffer(folded[start : start + settings.chunk + longest - 1], np.uint8).astype(np.uint32)
        last = start + settings.chunk >= len(folded) - 1
        edge = part == 32
        for n in settings.grams:
            count = len(part) - n + 1 if last else min(settings.chunk, len(part) - n + 1)
            if count <= 0:
                continue
            code = np.full(count, n, np.uint32)
            wrong = np.zeros(count, bool)
            for place in range(n):
                code = code * np.uint32(0x01000193) ^ part[place : place + count]
                if 0 < place < n - 1:
                    wrong |= edge[place : place + count]
            if n == 2:
                wrong |= edge[:count] & edge[1 : count + 1]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield ((code ^ (code >> np.uint32(13))) % np.uint32(settings.buckets))[~wrong].astype(np.int64)


@dataclass
class Model:
    """Scores of each bucket for each language (embedding times softmax weights), and the calibration."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: bytes, settings: Settings) -> np.ndarray:
        total, count = np.zeros(len(self.langs)), 0
        for buckets in subwords(text, settings):
            total += self.table[buckets].sum(axis=0, dtype=np.float64)
            count += len(buckets)
        return total / max(count, 1) + self.bias

    def predict(self, text: bytes, settings: Settings) -> tuple[str, float]:
        chances = softmax(self.logits(text, settings) / self.temperature)
        best = int(chances.argmax())
        return self.langs[best], float(min(1.0, chances[best]))


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def labelled(docs: DataFrame, text: str, lang: str, learn: Column, key: str, settings: Settings) -> DataFrame:
    """A sample of the rows to learn from: buckets, their counts and the language.

    A language's rows are counted first; each is then taken with the chance ``sample`` over that
    count, by a hash of key and text, so the sample's expected size is bounded and reruns repeat it.
    Texts become bucket counts where they lie; the driver sees no text.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), text_bytes(F.col(text)).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("draw")
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.col("draw"), F.lit(1 << 30)) * F.col("n") < F.lit(settings.sample * (1 << 30))
    # One row per language, as the model has one column for each; so no text is shuffled by language.
    drawn = rows.join(F.broadcast(counts), "lang").filter(chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, langs, draws = [], [], [], []
            for part in slices(batch, 64):
                for value, lang, draw in zip(part["text"], part["lang"], part["draw"], strict=True):
                    each = list(subwords(value, settings))
                    found, number = np.unique(np.concatenate(each), return_counts=True)
                    ids.append(found.astype(np.int32).tobytes())
                    counts.append(number.astype(np.float32).tobytes())
                    langs.append(lang)
                    draws.append(draw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(draws, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                ["lang", "draw", "ids", "counts"],
            )

    return drawn.select("text", "lang", "draw").mapInArrow(run, "lang string, draw bigint, ids binary, counts binary")


def fit(rows: list, settings: Settings) -> Model | None:
    """Stochastic gradient descent on the sample, then the temperature and the rejection threshold."""
    rows = sorted(rows, key=lambda row: (row["draw"], row["lang"]))
    langs = sorted({row["lang"] for row in rows})
    if not langs:
        return None
    rng = np.random.default_rng(settings.seed)
    ids = [np.frombuffer(row["ids"], np.int32) for row in rows]
    shares = [(part := np.frombuffer(row["counts"], np.float32)) / max(part.sum(), 1) for row in rows]
    target = np.array([langs.index(row["lang"]) for row in rows])
    back = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~back)
    embedding = rng.normal(0, 0.1, (settings.buckets, settings.width)).astype(np.float32)
    weights = rng.normal(0, 0.1, (settings.width, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps = settings.epochs * max(1, -(-len(learn) // settings.batch))
    step = 0
    for _ in range(settings.epochs):
        for part in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // settings.batch))):
            if not len(part):
                continue
            rate = settings.rate * (1 - step / steps)
            step += 1
            hidden = np.stack([shares[i] @ embedding[ids[i]] for i in part])
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(part)), target[part]] -= 1
            pull = error @ weights.T
            weights -= rate * hidden.T @ error / len(part)
            bias -= rate * 0.1 * error.mean(axis=0)
            for place, i in enumerate(part):
                # A bucket's share of a text is small; the embedding's step is scaled up for it.
                embedding[ids[i]] -= rate * 20 * np.minimum(shares[i] * 50, 1.0)[:, None] * pull[place] / len(part)
    model = Model(langs, (embedding @ weights).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    kept = np.flatnonzero(back) if back.any() else learn
    logits = np.stack([shares[i] @ model.table[ids[i]] for i in kept]) + model.bias
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(kept)), target[kept]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    chances = softmax(logits / model.temperature)
    best, right = chances.max(axis=1), chances.argmax(axis=1) == target[kept]
    # The least threshold above which the predictions are accurate enough.
    order = np.argsort(-best, kind="stable")
    running = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(running >= settings.accuracy)
    model.threshold = float(best[order[good[-1]]]) if len(good) else 1.0
    if len(good) == len(order):
        model.threshold = min(model.threshold, 1.0 / len(langs) + 0.1)
    return model


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Model | None:
    """A model from the rows where ``learn`` holds; None if none has a language and a letter."""
    settings = settings or Settings()
    return fit(labelled(docs, text, lang, learn, key, settings).collect(), settings)


def identify(docs: DataFrame, model: Model | None, carry: list[str], text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The columns in ``carry`` with ``lang_pred``, ``score`` and ``rejected``, for every row.

    ``score`` is the calibrated probability of the prediction; ``rejected`` marks scores below the
    model's threshold, and texts that are null or have no letter, which get ``und`` and 0.0.
    Without a model all texts do.  The whole text is read, in chunks, where it is scanned.
    Repeated rows give equal results, null keys stay, an empty table gives no rows.  Columns in
    ``carry`` that are named like a result make way for it; all other names are kept as they are.
    """
    settings = settings or Settings()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(values: pa.Array) -> pa.Array:
        known = shared.value
        found = []
        for part in slices(pa.RecordBatch.from_arrays([values], ["text"])):
            for value in part["text"]:
                if value is None or known is None:
                    found.append((UNKNOWN, 0.0, True))
                else:
                    lang, score = known.predict(value, settings)
                    found.append((lang, score, score < known.threshold))
        langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary"))
    names = [name for name in carry if name not in ("lang_pred", "score", "rejected")]
    held = "found"
    while held in {name.lower() for name in names}:
        held += "_"
    return docs.select(*names, predict(lettered).alias(held)).select(*names, f"{held}.*")
