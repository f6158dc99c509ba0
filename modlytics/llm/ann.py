"""Nearest neighbours by inner product: stable projections in a kd-tree, verified until a chi-square test stops."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """``width``: projected dimensions, even.  ``chance``: with which a true neighbour lies before the stop.

    ``leaf``: points of a kd-tree leaf and of a block.  The tree has a leaf for so many rows, up to ``leaves``,
    and is fitted on about ``sample`` points or eight a leaf; larger leaves have more blocks.  ``queries``: of a
    pack.  ``step``: candidates before the first test of a block, four times as many before each next one.
    ``rounds``: how many of a query's nearest leaves are searched before its bound is renewed; the rest follows.
    """

    width: int = 24
    chance: float = 0.9
    leaf: int = 2048
    leaves: int = 16_384
    sample: int = 32_768
    queries: int = 256
    step: int = 256
    rounds: tuple[int, ...] = (1, 8)
    seed: int = 23


def chi_square_cdf(x: float, width: int) -> float:
    """The chi-square distribution with an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, width // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(chance: float, width: int) -> float:
    low, high = 0.0, 10.0 * width + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, width) < chance else (low, middle)
    return high


@dataclass
class Tree:
    """A kd-tree over projected points as nested splits: (axis, value, left, right), or a leaf's number."""

    root: object
    leaves: int

    def place(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                found[rows] = node
            else:
                axis, value, left, right = node
                under = points[rows, axis] <= value
                todo += [(left, rows[under]), (right, rows[~under])]
        return found


def grow(points: np.ndarray, leaves: int) -> Tree:
    """Split at the median of the widest axis until there are enough leaves."""
    count = 0

    def build(part: np.ndarray, wanted: int) -> object:
        nonlocal count
        if wanted > 1 and len(part) > 1:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value = float(np.median(part[:, axis]))
            under = part[:, axis] <= value
            if under.any() and not under.all():
                return axis, value, build(part[under], wanted // 2), build(part[~under], wanted - wanted // 2)
        count += 1
        return count - 1

    root = build(points, leaves)
    return Tree(root, count)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares would vanish or overflow."""
    largest = np.abs(vectors).max(axis=1)
    return largest * np.sqrt(((vectors / largest[:, None]) ** 2).sum(axis=1))


@dataclass
class Space:
    """How vectors become points: inner products as distances, then stable projections.

    Candidates are divided by ``longest``, the greatest length, and get one more coordinate that makes their length
    1; queries are divided by their own length and get 0.  The nearest candidate then is the one of the
    largest inner product.
    """

    matrix: np.ndarray
    longest: float

    def points(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        return scaled @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def asks(self, vectors: np.ndarray) -> np.ndarray:
        largest = np.abs(vectors).max(axis=1)
        scaled = vectors / largest[:, None]
        return scaled / np.sqrt((scaled**2).sum(axis=1))[:, None] @ self.matrix[:-1]

    def reach(self, norms: np.ndarray, bounds: np.ndarray, stop: float) -> np.ndarray:
        """The squared projected distance up to which candidates are verified: the quantile times the k-th best's squared distance."""
        distance = np.clip(2 - 2 * (bounds / norms) / self.longest, 0, 4)
        return np.where(np.isfinite(bounds), stop * distance + 1e-9, np.inf)


def matrix_of(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, width)


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest; -inf in rows of fewer."""
    size = scores.shape[1]
    return np.full(len(scores), -np.inf) if size < k else np.partition(scores, size - k, axis=1)[:, size - k]


def search(
    space: Space,
    stop: float,
    settings: Settings,
    k: int,
    asks: tuple[np.ndarray, np.ndarray, np.ndarray],
    block: tuple[np.ndarray, np.ndarray, np.ndarray],
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the best ids and scores of a block, and how many candidates were verified.

    Candidates come in the order of their projected distance.  Their inner products are taken until
    the next one's squared projected distance exceeds the chi-square quantile times the squared
    distance of the k-th best: then any that is left is closer than that only with the small remaining chance.
    The products of all queries with the candidates that any of them can reach are made at once; the best are
    then added up anew, each in the same order, so that equal vectors have equal scores.
    """
    rows, vectors, bounds = asks
    names, ids, candidates = block
    points, near = space.asks(vectors), space.points(candidates)
    apart = (points**2).sum(axis=1)[:, None] + (near**2).sum(axis=1)[None, :] - 2 * points @ near.T
    # No comparison holds for a query's own row.
    apart[rows[:, None] == names[None, :]] = np.nan
    norms = lengths(vectors)
    reach = space.reach(norms, bounds, stop)
    columns = np.flatnonzero((apart <= reach[:, None]).any(axis=0))
    if not len(columns):
        return [(np.empty(0, np.int64), np.empty(0), 0)] * len(rows)
    apart, ids, candidates = apart[:, columns], ids[columns], candidates[columns]
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        products = vectors @ candidates.T
        products[np.isnan(products)] = -np.inf
        slack = 1e-14 * vectors.shape[1] * norms * lengths(candidates).max()
    steps = []
    step = settings.step
    while step < len(columns):
        steps.append(step - 1)
        step *= 4
    cuts = np.partition(apart, steps, axis=1)[:, steps].T if steps else []
    best = bounds
    for cut in cuts:
        taken = apart <= np.fmin(cut, reach)[:, None]
        best = np.fmax(best, kth_best(np.where(taken, products, -np.inf), k))
        reach = np.fmin(reach, space.reach(norms, best, stop))
    taken = apart <= reach[:, None]
    seen = taken.sum(axis=1)
    least = np.fmax(bounds, kth_best(np.where(taken, products, -np.inf), k))
    with np.errstate(invalid="ignore"):
        least = np.where(np.isfinite(least), least - slack, -np.inf)
    likely = taken & ~(products < least[:, None])
    found = []
    for at in range(len(rows)):
        chosen = np.flatnonzero(likely[at])
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            scores = (candidates[chosen] * vectors[at]).sum(axis=1)
        keep = ~(scores < bounds[at])
        chosen, scores = chosen[keep], scores[keep]
        order = np.lexsort((ids[chosen], -scores))[:k]
        found.append((ids[chosen[order]], scores[order], int(seen[at])))
    return found


HITS = "array<struct<minus:double,id:bigint>>"


def valid(vector: Column) -> Column:
    """Vectors that take part: no null or non-finite component, and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    settings: Settings | None = None,
) -> DataFrame:
    """query_id, rank, ``key`` and score: the k best candidates found for each row whose key ``every`` divides.

    The tree's leaves hold all points, in blocks.  A query searches the leaves in the order in which their boxes lie
    from it in the projection, in a few rounds.  After each, the k-th score found so far renews the bound of
    the chi-square test: leaves whose box is farther off cannot pass it and are left out, all others are
    searched in the end.  Queries and points meet as blocks in one task, and a query's results are merged in two levels.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without a key, nor vectors of another length than most (the longer at a tie).  Very small and very large
    numbers take part; a score that is no number ranks last.  Equal scores go to the smaller key.  A
    repeated row is a candidate for its copy.  With fewer candidates, all are returned; an empty table gives
    no rows.  Other columns are left out, whatever their names.
    """
    settings = settings or Settings()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        valid(F.col("vector")) & F.col("id").isNotNull()
    )
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(x / F.col("largest"), 2))
    sized = rows.withColumn("largest", largest).select(F.size("vector").alias("size"), (F.col("largest") * F.sqrt(squares)).alias("norm"))
    shapes = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    shape = shapes.orderBy(F.desc("n"), F.desc("size")).first()
    result = f"query_id bigint, rank int, {key} bigint, score double, verified bigint"
    if shape is None:
        return spark.createDataFrame([], result)
    width, total = shape["size"], shape["n"]
    rng = np.random.default_rng(settings.seed)
    space = Space(rng.standard_normal((width + 1, settings.width)), min(shape["longest"], 1.7e308))
    stop = chi_square_quantile(settings.chance, settings.width)
    rows = rows.filter(F.size("vector") == width)

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([point.tobytes() for point in space.points(vectors_of(batch))], pa.binary())], ["point"])

    wanted = max(1, min(settings.leaves, -(-total // settings.leaf)))
    size = max(settings.sample, 8 * wanted)
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, size / total) * (1 << 30)))
    sample = drawn.select("vector").limit(2 * size).mapInArrow(projected, "point binary").collect()
    tree = grow(matrix_of([row["point"] for row in sample], settings.width), wanted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = vectors_of(batch)
            points = space.points(matrix)
            raw = pa.array([vector.tobytes() for vector in matrix], pa.binary())
            columns = [batch.column("row"), batch.column("id"), raw, pa.array(list(points), pa.list_(pa.float64())), pa.array(tree.place(points))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "raw", "point", "leaf"])

    placed = stored(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector").mapInArrow(
            project, "row bigint, id bigint, raw binary, point array<double>, leaf bigint"
        )
    )
    # One row per leaf, of which there are at most ``leaves``.
    axes = range(settings.width)
    boxes = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.min(F.col("point")[axis]).alias(f"low{axis}") for axis in axes),
        *(F.max(F.col("point")[axis]).alias(f"high{axis}") for axis in axes),
    ).orderBy("leaf").collect()
    leaves = np.array([box["leaf"] for box in boxes])
    lows = np.array([[box[f"low{axis}"] for axis in axes] for box in boxes])
    highs = np.array([[box[f"high{axis}"] for axis in axes] for box in boxes])
    sizes = spark.createDataFrame([(box["leaf"], -(-box["n"] // settings.leaf)) for box in boxes], "leaf bigint, blocks bigint")
    blocks = stored(
        placed.join(F.broadcast(sizes), "leaf")
        .groupBy("leaf", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("id", "row", "raw"))).alias("points"))
    )
    asked = placed.filter(F.col("id") % every == 0).select("row", "id", "raw")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def field(values: pa.StructArray, name: str) -> np.ndarray:
            return values.field(name).to_numpy(zero_copy_only=False)

        for batch in batches:
            for at in range(batch.num_rows):
                asks, points = batch.column("asks")[at].values, batch.column("points")[at].values
                names = field(asks, "row")
                found = search(
                    space, stop, settings, k,
                    (names, matrix_of(asks.field("raw").to_pylist(), width), field(asks, "bound")),
                    (field(points, "row"), field(points, "id"), matrix_of(points.field("raw").to_pylist(), width)),
                )
                ends = np.cumsum([0, *(len(ids) for ids, *_ in found)])
                hits = pa.StructArray.from_arrays(
                    [pa.array(-np.concatenate([scores for _, scores, _ in found])), pa.array(np.concatenate([ids for ids, *_ in found]))],
                    ["minus", "id"],
                )
                part = np.full(len(names), batch.column("leaf")[at].as_py() % 16)
                columns = [pa.array(names), pa.array(part), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits), pa.array([seen for *_, seen in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "part", "hits", "seen"])

    def merged(hits: DataFrame) -> DataFrame:
        def best() -> list[Column]:
            return [F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"), F.sum("seen").alias("seen")]

        first = hits.groupBy("row", "part").agg(*best())
        return first.groupBy("row").agg(*best())

    def searched(asks: DataFrame) -> DataFrame:
        """asks: row, raw, bound, leaf.  A leaf's packs hold about ``queries`` each and meet each of its blocks."""
        loads = asks.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / settings.queries).alias("packs"))
        packs = (
            asks.join(F.broadcast(loads), "leaf")
            .groupBy("leaf", F.pmod(F.xxhash64("row"), F.col("packs")).alias("pack"))
            .agg(F.collect_list(F.struct("row", "raw", "bound")).alias("asks"))
            .join(F.broadcast(sizes), "leaf")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        )
        pairs = packs.join(blocks, ["leaf", "block"]).select("leaf", "asks", "points")
        return pairs.mapInArrow(scan, f"row bigint, part bigint, hits {HITS}, seen bigint")

    def chooser(begin: int, end: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The leaves from place ``begin`` to ``end`` in a query's order of leaves that its bound does not rule out."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = matrix_of(batch.column("raw").to_pylist(), width)
                reaches = space.reach(lengths(matrix), batch.column("bound").to_numpy(zero_copy_only=False), stop)
                chosen = []
                for point, reach in zip(space.asks(matrix), reaches, strict=True):
                    off = (np.maximum(np.maximum(lows - point, point - highs), 0) ** 2).sum(axis=1)
                    order = np.argsort(off, kind="stable")[begin:end]
                    chosen.append(leaves[order[off[order] <= reach]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("raw"), batch.column("bound"), pa.array(chosen, pa.list_(pa.int64()))],
                    ["row", "raw", "bound", "leaves"],
                )

        return choose

    lowest = F.lit(float("-inf"))
    kth = F.when(F.size("hits") >= k, -F.element_at("hits", k)["minus"]).otherwise(lowest)
    hits = None
    begin = 0
    for end in [*(end for end in settings.rounds if end < len(leaves)), None]:
        bounded = asked.select("row", "raw", lowest.alias("bound")) if hits is None else asked.join(
            hits.select("row", F.when(F.isnan(kth), lowest).otherwise(kth).alias("kth")), "row", "left"
        ).select("row", "raw", F.coalesce("kth", lowest).alias("bound"))
        asks = bounded.mapInArrow(chooser(begin, end), "row bigint, raw binary, bound double, leaves array<bigint>")
        new = searched(asks.select("row", "raw", "bound", F.explode("leaves").alias("leaf")))
        hits = stored(merged(new if hits is None else new.unionByName(hits.withColumn("part", F.lit(0).cast("bigint")))))
        begin = end
    return (
        hits.join(asked.select("row", F.col("id").alias("query_id")), "row")
        .select("query_id", F.col("seen").alias("verified"), F.posexplode("hits").alias("place", "hit"))
        .select(
            "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias(key),
            (-F.col("hit.minus")).alias("score"), "verified",
        )
    )
