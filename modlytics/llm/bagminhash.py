"""Near-duplicate classes by BagMinHash signatures of word-shingle bags."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import slices, stored, text_bytes
from modlytics.llm.graph import components
from modlytics.llm.repetition import Powers, rolling, word_hashes

GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """How bags are made, signed, banded and compared.

    With 25 bands of 5 components, a pair at the similarity of 0.8 shares no band with a
    probability of 5e-5, at 0.85 of 4e-7.  ``slack`` is how far below the similarity the share of
    equal components may lie before a pair is not verified (4.5 standard deviations at 0.8).
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    slack: float = 0.16
    small: int = 8

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def waiting(values: np.ndarray) -> np.ndarray:
    """Exponential waiting times from 64-bit values."""
    return -np.log(((values >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def shingles(text: bytes, n: int, powers: Powers) -> np.ndarray:
    """Hashes of all n-word windows; a shorter text is one window, a text without words has none."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    n = min(n, len(words))
    return next(rolling(hashes, [n], powers))[1] + np.uint64(n)


def bag(text: bytes, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text, n, powers), return_counts=True)


def overlap(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0.0 if both are empty."""
    _, at, to = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(left[1][at], right[1][to]).sum())
    total = int(left[1].sum()) + int(right[1].sum()) - shared
    return shared / total if total else 0.0


def signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash of several bags at once: a matrix with a row of ``size`` components for each text.

    ``owner`` says which text an element belongs to.  The weights are whole numbers, so the weight
    axis falls into unit steps, kept as a ladder of intervals (0,1], (1,2], (2,4], (4,8] and so on.
    Every interval below an element's weight has a Poisson process, of a rate as its length.
    Only its first point is drawn at first.  When that point comes before the latest time that a
    component still holds, the interval is split: the half in which the point lies inherits it, the
    other waits on from there, and halves above the weight are dropped.  Intervals of unit length
    hand their points to a component drawn evenly, and go on to the next point.  A component keeps
    its earliest point.  All randomness comes from the element's hash, so equal elements and steps
    give equal points in every text.
    """
    best = np.full(texts * size, np.inf)
    mark = np.zeros(texts * size, np.uint32)
    # The ladder: interval 0 is (0,1], interval i is (2**(i-1), 2**i].
    rungs = np.zeros(len(weights), np.int64)
    rungs[weights > 1] = np.ceil(np.log2(weights[weights > 1])).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), rungs + 1)
    rung = np.arange(len(at)) - np.repeat(np.cumsum(rungs + 1) - rungs - 1, rungs + 1)
    low = np.where(rung > 0, np.left_shift(1, np.maximum(rung - 1, 0)), 0)
    length = np.maximum(low, 1)
    text, weight = owner[at], weights[at]
    seed = mix(keys[at] + mix((low * 2 + length).astype(np.uint64) * GOLD))
    time = waiting(seed) / length
    limit = np.full(texts, np.inf)
    while len(text):
        wide = length > 1
        if wide.any():
            half = length[wide] // 2
            down = mix(seed[wide] ^ GOLD)
            first = (down >> np.uint64(63)).astype(bool)
            other = time[wide] + waiting(mix(down)) / half
            left = (text[wide], weight[wide], low[wide], half, mix(down + np.uint64(1)), np.where(first, time[wide], other))
            right = (text[wide], weight[wide], low[wide] + half, half, mix(down + np.uint64(2)), np.where(first, other, time[wide]))
        unit = ~wide
        text_u, seed_u, time_u = text[unit], seed[unit], time[unit]
        draw = mix(seed_u + GOLD)
        slot = text_u * size + ((draw >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, time_u)
        won = best[slot] == time_u
        mark[slot[won]] = (draw[won] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        after = mix(draw)
        going = (text_u, weight[unit], low[unit], length[unit], after, time_u + waiting(mix(after ^ GOLD)))
        parts = [going, left, right] if wide.any() else [going]
        text, weight, low, length, seed, time = (np.concatenate(column) for column in zip(*parts, strict=True))
        limit = best.reshape(texts, size).max(axis=1)
        keep = (low < weight) & (time < limit[text])
        text, weight, low, length, seed, time = (column[keep] for column in (text, weight, low, length, seed, time))
    return mark.reshape(texts, size)


def sign(values: list[bytes], settings: Settings, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and band keys of some texts, and which of them have words."""
    parts = [shingles(value, settings.words, powers) for value in values]
    counts = np.array([len(part) for part in parts], np.int64)
    owner = np.repeat(np.arange(len(values)), counts)
    keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    order = np.lexsort((keys, owner)) if len(keys) else np.empty(0, np.int64)
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    weights = np.diff(np.append(starts, len(keys)))
    found = signatures(owner[starts], mix(keys[starts]), weights, len(values), settings.size)
    keyed = found.reshape(len(values), settings.bands, settings.rows).astype(np.uint64)
    bands = np.tile(np.arange(1, settings.bands + 1, dtype=np.uint64) * GOLD, (len(values), 1))
    for place in range(settings.rows):
        bands = mix(bands + keyed[:, :, place] * GOLD + np.uint64(place))
    return found, bands.view(np.int64), counts > 0


def signed_rows(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """The rows with a row number, a digest of the text, its signature and its band keys, in a table.

    Columns of ``docs`` are kept as c0, c1, ... so that none clashes.
    """

    @F.arrow_udf("struct<signature:binary,bands:array<bigint>>")
    def signature(values: pa.Array) -> pa.Array:
        powers = Powers()
        signs, bands = [], []
        for part in slices(pa.RecordBatch.from_arrays([values], ["text"])):
            marks, keys, full = sign(part["text"], settings, powers)
            signs += [mark.tobytes() if has else None for mark, has in zip(marks, full, strict=True)]
            bands += [key if has else None for key, has in zip(keys, full, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["signature", "bands"]
        )

    columns = [F.col(name).alias(f"c{place}") for place, name in enumerate(docs.columns)]
    rows = docs.select(
        *columns,
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_bytes(F.col(text)), 256)).alias("digest"),
        signature(text_bytes(F.col(text))).alias("signed"),
    )
    return stored(rows.select("*", "signed.*").drop("signed"))


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=-1)


def verified(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough, from the whole texts of both.

    Signatures come first, so that only pairs that look alike bring their texts along.
    """
    size, least = settings.size, settings.similarity - settings.slack

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = [np.frombuffer(b"".join(side.to_pylist()), np.uint32).reshape(-1, size) for side in (left, right)]
        return pa.array(estimated(*rows) >= least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, held = Powers(), [None, None], [None, None]
        for batch in batches:
            same = []
            for part in slices(batch):
                for *ends, left, right in zip(part["a"], part["b"], part["left"], part["right"], strict=True):
                    for side, value in enumerate((left, right)):
                        if ends[side] != last[side]:  # rows of one end follow each other
                            last[side], held[side] = ends[side], bag(value, settings.words, powers)
                    same.append(overlap(*held) >= settings.similarity)
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    def side(end: str, column: str, name: str) -> DataFrame:
        return nodes.select(F.col("row").alias(end), F.col(column).alias(name))

    close = stored(
        pairs.join(side("a", "signature", "left"), "a")
        .join(side("b", "signature", "right"), "b")
        .filter(alike("left", "right"))
        .select("a", "b"),
        "none",
    )
    return (
        close.join(side("a", "raw", "left"), "a")
        .join(side("b", "raw", "right"), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(compare, "a bigint, b bigint")
    )


class Bags:
    """The bags of a block's texts, made when first needed, one by one or laid end to end."""

    def __init__(self, texts: list[bytes], words: int, powers: Powers) -> None:
        self.texts, self.words, self.powers = texts, words, powers
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.flat: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getitem__(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        if place not in self.made:
            self.made[place] = bag(self.texts[place], self.words, self.powers)
        return self.made[place]

    def overlaps(self, other: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
        """The similarity of another bag to those at some places."""
        if len(places) < 64:
            return np.array([overlap(self[place], other) for place in places])
        if self.flat is None:
            bags = [self[place] for place in range(len(self.texts))]
            sizes = np.array([len(keys) for keys, _ in bags])
            totals = np.array([counts.sum() for _, counts in bags])
            self.flat = (np.concatenate([keys for keys, _ in bags]), np.concatenate([n for _, n in bags]), np.cumsum(sizes) - sizes, totals)
        keys, counts, starts, totals = self.flat
        at = np.minimum(np.searchsorted(other[0], keys), len(other[0]) - 1)
        shared = np.where(other[0][at] == keys, np.minimum(other[1][at], counts), 0)
        both = np.add.reduceat(shared, starts)[places]
        return both / (totals[places] + other[1].sum() - both)


def blocks(crowd: DataFrame, settings: Settings, rows: int = 512, size: int = 2 << 20) -> DataFrame:
    """Links that join different roots in crowds (crowd, row, root, signature, raw), block against block.

    A crowd is cut into blocks of about ``rows`` rows or ``size`` bytes by hash.  A task holds two
    blocks, compares signatures, verifies the bags of those that look alike, and returns only links
    that join what is not yet joined inside it: fewer than it has rows, never a list of pairs.
    """
    width, least = settings.size, settings.similarity - settings.slack

    def compare(group):
        powers = Powers()
        sides = [group[group["block"] == group[end]] for end in ("low", "high")]
        same = len(group) > 0 and group["low"].iat[0] == group["high"].iat[0]
        marks = [np.frombuffer(b"".join(side["signature"]), np.uint32).reshape(-1, width) for side in sides]
        names = [side["row"].to_numpy() for side in sides]
        bags = [Bags(side["raw"].tolist(), settings.words, powers) for side in sides]
        joined: dict[int, int] = {}

        def top(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        roots = [side["root"].to_numpy().copy() for side in sides]
        found = []
        for place in range(len(names[0])):
            mine = top(int(roots[0][place]))
            near = estimated(marks[0][place], marks[1]) >= least
            if same:
                near[: place + 1] = False
            places = np.array([at for at in np.flatnonzero(near) if top(int(roots[1][at])) != mine], np.int64)
            if not len(places):
                continue
            alike = bags[1].overlaps(bags[0][place], places) >= settings.similarity
            for at in places[alike]:
                mine, other = top(mine), top(int(roots[1][at]))
                if mine != other:
                    joined[other] = mine
                    found.append((int(names[0][place]), int(names[1][at])))
        return type(group)(found, columns=["a", "b"], dtype="int64")

    sizes = crowd.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("bytes"))
    count = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / size)).cast("int")
    placed = crowd.join(sizes.select("crowd", count.alias("count")), "crowd").withColumn("block", F.pmod(F.xxhash64("row"), "count").cast("int"))
    return (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .select("crowd", "row", "root", "signature", "raw", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .groupBy("crowd", "low", "high")
        .applyInPandas(compare, "a bigint, b bigint")
    )


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, row) of buckets in which more than one root is left, with root and n."""
    rooted = members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"))
    return rooted.join(mixed.filter("least <> most").select("key", "n"), "key")


def remaining(members: DataFrame, nodes: DataFrame, roots: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """What is left of pairs with different roots in one bucket: pairs to verify, and verified links.

    Small buckets give all their pairs.  Larger ones that have a row in common form a crowd, which is
    searched as a whole, once, block against block.
    """
    still = stored(open_buckets(members, roots), "none")
    few, many = still.filter(F.col("n") <= settings.small), still.filter(F.col("n") > settings.small)
    other = few.select("key", F.col("row").alias("b"), F.col("root").alias("b_root"))
    pairs = (
        few.select("key", F.col("row").alias("a"), F.col("root").alias("a_root"))
        .join(other, "key")
        .filter("a > b and a_root <> b_root")
        .select("a", "b")
        .distinct()
    )
    heads = many.groupBy("key").agg(F.min("row").alias("b"))
    crowds = components(many.join(heads, "key").select(F.col("row").alias("a"), "b"))
    crowd = (
        crowds.select(F.col("node").alias("row"), F.col("root").alias("crowd"))
        .join(many.select("row", "root").distinct(), "row")
        .join(nodes.select("row", "signature", "raw"), "row")
    )
    return pairs, blocks(crowd, settings)


def linked(signed: DataFrame, text: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Texts (digest, node) and the roots of those nodes that have a link.

    Copies of a text are one node.  First, each member of a band's bucket is paired with one row
    of it only, the one that meets most others in all its buckets, and the verified links are joined to
    components.  Then the buckets that still hold different components are searched completely, so a
    link that the first pass did not pair is found as well.  Buckets whose members are all in one
    component cost nothing in the second pass.
    """
    texts = stored(signed.filter("bands is not null").groupBy("digest").agg(F.min("row").alias("node")), "none")
    single = signed.select("row", "bands").join(texts.select(F.col("node").alias("row")), "row", "left_semi")
    bands = single.select("row", F.explode("bands").alias("key"))
    counted = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(bands.join(counted, "key"), "none")
    meets = members.groupBy("row").agg(F.sum("n").alias("meets"))
    nodes = stored(
        signed.select("row", "signature", text_bytes(F.col(text)).alias("raw")).hint("merge").join(meets.select("row"), "row", "left_semi")
    )
    ranked = members.select("key", "row").join(meets, "row")
    heads = ranked.groupBy("key").agg(F.max(F.struct("meets", "row")).alias("head")).select("key", F.col("head.row").alias("head"))
    stars = (
        members.select("key", "row").join(heads, "key").filter("row <> head")
        .select(F.greatest("row", "head").alias("a"), F.least("row", "head").alias("b")).distinct()
    )
    links = stored(verified(stars, nodes, settings), "none")
    roots = components(links)
    pairs, more = remaining(members.select("key", "row"), nodes, roots, settings)
    rest = verified(pairs.join(stars, ["a", "b"], "left_anti"), nodes, settings)
    more = stored(rest.unionAll(more), "none")
    return texts, components(links.unionAll(more))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """All columns of ``docs`` with ``class_id``, ``class_size`` and ``first_of_class``.

    A class is a connected component of the links between texts whose bags of five-word shingles have
    a weighted Jaccard similarity of 0.8 or more; exact copies are in one class.  ``class_id``
    is the least key of the class; ``first_of_class`` marks one row of it, one with that key.

    A text of one to four words is a single shingle.  Null and empty texts, and texts of white space,
    have no shingle: each such row is a class by itself.  Repeated rows are copies of each other.  A null
    key sorts last and is the class id only of a class without other keys.  Columns of the three
    names are replaced.  An empty table stays empty.
    """
    settings = settings or Settings()
    names = [name for name in docs.columns if name not in ("class_id", "class_size", "first_of_class")]
    plain = docs.select(*names)
    signed = signed_rows(plain, text, settings)
    texts, roots = linked(signed, f"c{names.index(text)}", settings)
    groups = texts.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    id_column = f"c{names.index(key)}"
    ranked = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "row")
    rows = signed.select("row", "digest", ranked.alias("ranked"), F.col("bands").isNotNull().alias("has"))
    byroot = stored(rows.filter("has").join(groups, "digest").select("row", "root", "ranked"))
    heads = byroot.groupBy("root").agg(F.min("ranked").alias("head"), F.count(F.lit(1)).alias("class_size"))
    outcome = (
        byroot.join(heads, "root")
        .select("row", F.col("head.id").alias("class_id"), "class_size", (F.col("head.row") == F.col("row")).alias("first_of_class"))
    )
    return signed.drop("digest", "signature", "bands").join(outcome, "row", "left").select(
        *(F.col(f"c{place}").alias(name) for place, name in enumerate(names)),
        F.when(F.col("class_size").isNull(), F.col(id_column)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        F.coalesce("first_of_class", F.lit(True)).alias("first_of_class"),
    )


def first_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that classes() marks as the first of their class, with their own columns."""
    return classes(docs, key, text, settings).filter("first_of_class").select(*docs.columns)
