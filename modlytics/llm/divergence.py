"""How far sources of a language differ in their terms: digests are shuffled, strings come back only for what is kept."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlytics.llm.common import stored, text_bytes

#: Documents of a language that must hold a term.
MIN_DOCS = 3
#: Terms reported of a group.
TOP = 200
SCALE = 1_000_000_000
#: Entries of a bucket of terms, and sources of a tile; both bound what one task holds.
BUCKET, TILE = 65_536, 128
#: Distinct terms that a task counts before it hands them on, and bytes of a text that it cuts at a time.
HELD, CHUNK = 300_000, 1 << 20

#: Bytes of terms stay, A-Z as small letters; all other ASCII characters become blanks.
TERM_BYTES = bytes(
    value + 32 if 65 <= value <= 90 else value if 97 <= value <= 122 or value >= 128 else 32 for value in range(256)
)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends where a term does."""
    plain, start = text.translate(TERM_BYTES), 0
    while start < len(plain):
        end = len(plain) if len(plain) - start <= CHUNK else plain.find(b" ", start + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def digest(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


SCAN_TYPE = "lid bigint, gid bigint, digest bigint, docs bigint, n bigint, term string"


def counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts per group and term inside a task: documents, occurrences, and the ``bits`` lowest bits of the digest."""
    mask = (1 << bits) - 1

    def handed(groups: dict[tuple[int, int], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lid, gid), (uses, docs) in groups.items():
            terms = list(uses)
            keys = np.fromiter((digest(term) & mask for term in terms), np.uint64, len(terms)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(terms), lid, np.int64)),
                    pa.array(np.full(len(terms), gid, np.int64)),
                    pa.array(keys),
                    pa.array([docs[term] for term in terms], pa.int64()),
                    pa.array([uses[term] for term in terms], pa.int64()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                ],
                ["lid", "gid", "digest", "docs", "n", "term"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lid, gid, text in zip(*(batch.column(name) for name in ("lid", "gid", "text")), strict=True):
                uses, docs = groups[lid.as_py(), gid.as_py()]
                seen: set[bytes] = set()
                for words in terms_of(text.as_py()):
                    uses.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(uses) for uses, _ in groups.values()) > HELD:
                yield from handed(groups)
                groups.clear()
        yield from handed(groups)

    return run


def named_groups(read: DataFrame) -> tuple[DataFrame, int]:
    """Every (lang, source) with the numbers ``lid`` and ``gid``, and the seed under which no two share one."""
    groups = stored(read.select("lang", "source").distinct())
    for seed in count():
        named = groups.select("lang", "source", *group_numbers(seed))
        shared = named.groupBy("gid").count().filter("count > 1").select("gid").union(
            named.select("lid", "lang").distinct().groupBy("lid").count().filter("count > 1").select("lid")
        )
        if not shared.limit(1).count():
            return named, seed
    raise AssertionError


def group_numbers(seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid")


def kept_terms(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan with ``spell``, kept terms per language, their strings).

    Counts are added up by digest alone.  The least and the greatest string of each digest that could be
    kept tell whether several terms share it; only the rows of such digests are told apart by ``spell``,
    the term itself, and counted anew.  Everywhere else ``spell`` is empty.
    """
    enough = F.col("docs") >= MIN_DOCS
    both = [F.sum("docs").alias("docs"), F.sum("n").alias("n")]
    likely = stored(scanned.groupBy("lid", "digest").agg(*both).filter(enough))
    ends = [F.min("term").alias("low"), F.max("term").alias("high")]
    strings = stored(scanned.join(likely.select("digest"), "digest", "left_semi").groupBy("digest").agg(*ends))
    shared = strings.filter("low <> high").select("digest")
    if not shared.limit(1).count():
        spelt = scanned.withColumn("spell", F.lit(""))
        return spelt, likely.withColumn("spell", F.lit("")), strings
    marked = scanned.join(shared.withColumn("shared", F.lit(True)), "digest", "left")
    spelt = marked.withColumn("spell", F.when(F.col("shared"), F.col("term")).otherwise(""))
    apart = scanned.join(shared, "digest", "left_semi").withColumn("spell", F.col("term"))
    split = apart.groupBy("lid", "digest", "spell").agg(*both).filter(enough)
    whole = likely.join(shared, "digest", "left_anti").withColumn("spell", F.lit(""))
    return spelt, stored(whole.unionByName(split.select(*whole.columns))), strings


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly; null where there is no term."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1)


def quotient(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def tile_sums(key: tuple, entries: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """For the sources of two tiles: f summed over the terms of a bucket that either tile holds, and how many those are."""
    _, first, second, _ = key
    if entries.empty:
        return pd.DataFrame({"gid": [], "other": [], "value": [], "seen": []}, dtype=np.int64)
    terms = entries.groupby(["digest", "spell"], sort=False).ngroup().to_numpy()
    size = int(terms.max()) + 1
    shares = []
    for tile in (first, second):
        own = sources[sources["tile"] == tile].sort_values("gid")
        gids, default = own["gid"].to_numpy(), own["p0"].to_numpy(np.int64)
        here = (entries["tile"] == tile).to_numpy()
        table = np.repeat(default[:, None], size, axis=1)
        table[np.searchsorted(gids, entries["gid"].to_numpy()[here]), terms[here]] = entries["p"].to_numpy(np.int64)[here]
        shares.append((gids, table))
    (gids, mine), (others, theirs) = shares
    found = []
    for gid, row in zip(gids, mine, strict=True):
        squared = (theirs - row) ** 2
        found.append(pd.DataFrame({"gid": gid, "other": others, "value": (squared // theirs).sum(axis=1)}))
        if first != second:
            found.append(pd.DataFrame({"gid": others, "other": gid, "value": (squared // row).sum(axis=1)}))
    sums = pd.concat(found)
    return sums[sums["gid"] != sums["other"]].assign(seen=size)


def pair_part(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """f of every ordered pair of sources of a language, summed over all kept terms.

    Terms that neither source holds all have the same f, so only the others are laid out: buckets of
    terms by tiles of sources, whose sums are added up by Spark.
    """
    langs = facts.groupBy("lid").agg((F.floor(F.count(F.lit(1)) / TILE) + 1).cast("bigint").alias("tiles"))
    sizes = entries.groupBy("lid").agg((F.floor(F.count(F.lit(1)) / BUCKET) + 1).cast("bigint").alias("buckets"))
    layout = stored(langs.join(sizes, "lid"))
    tile = F.pmod(F.xxhash64("gid"), F.col("tiles"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)

    def spread(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of tiles that its own tile is part of."""
        return (
            rows.withColumn("tile", tile)
            .withColumn("with", F.explode(every))
            .withColumns({"a": F.least("tile", "with"), "b": F.greatest("tile", "with")})
        )

    held = spread(entries.join(layout, "lid")).withColumn("bucket", F.pmod(F.xxhash64("digest", "spell"), F.col("buckets")))
    known = spread(facts.join(layout, "lid")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)))
    keys = ["lid", "a", "b", "bucket"]
    sums = (
        held.select(*keys, "tile", "gid", "digest", "spell", "p").groupBy(*keys)
        .cogroup(known.select(*keys, "tile", "gid", "p0").groupBy(*keys))
        .applyInPandas(tile_sums, "gid bigint, other bigint, value bigint, seen bigint")
        .groupBy("gid", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    other = facts.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = facts.join(other, "lid").filter("gid <> other").join(sums, ["gid", "other"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * quotient(F.col("p0"), F.col("q0"))
    valued = pairs.withColumn("value", F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0))
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    return valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def term_part(entries: DataFrame, strings: DataFrame, facts: DataFrame) -> DataFrame:
    """The terms that a source holds more often than its language, the most telling first.

    The value that the last reported term of a group has is found from counts per value; strings are
    joined only to terms that reach it, which also settles ties.
    """
    valued = entries.filter("p > q").select("gid", "digest", "spell", quotient(F.col("p"), F.col("q")).alias("value"))
    falling = Window.partitionBy("gid").orderBy(F.desc("value"))
    values = valued.groupBy("gid", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(falling))
    running = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = values.filter(F.col("place") <= TOP).withColumn("above", F.sum("n").over(running) - F.col("n"))
    least = stored(reach.filter(F.col("above") < TOP).groupBy("gid").agg(F.min("value").alias("least")))
    likely = valued.join(least, "gid").filter("value >= least").drop("least")
    item = F.when(F.col("spell") == "", F.col("low")).otherwise(F.col("spell")).alias("item")
    named = likely.join(strings, "digest").select("gid", item, "value")
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.join(facts.select("gid", "lang", "source"), "gid").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank"
    )


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's shares of terms are from others' and its language's.

    Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z as small letters.  A language
    keeps the terms that at least MIN_DOCS of its documents hold.  A source's share of a term is
    p = 1 + floor(SCALE * (count + 1) / (all its kept terms + number of kept terms)), a divergence of p from q
    floor((p - q)^2 / q).  Part ``pair`` sums it over all kept terms for every other source of the language; part
    ``term`` lists the TOP terms that the source holds with p above the language's own share.

    Tasks count the terms of their texts and hand on digests of ``bits`` bits; Spark adds up and shuffles
    digests and numbers.  Strings are shuffled only of terms that may be kept, whose least and greatest string show
    digests that several terms share: those terms are told apart by themselves.  Strings are joined back to the
    reported terms only.  All sums are exact.

    A null text, language or source counts as empty.  Every occurring (lang, source) has its rows of
    part ``pair``, with 0 where its language keeps no term; repeated rows are documents of their own.  Texts of any
    length are cut piece by piece.  Equal values are ranked by item in the order of UTF-8.  An empty table
    gives no rows; other columns are left out.
    """
    named = lambda column, name: F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name)
    read = docs.select(named(lang, "lang"), named(source, "source"), text_bytes(F.col(text)).alias("text"))
    groups, seed = named_groups(read)
    scanned = stored(read.select(*group_numbers(seed), "text").mapInArrow(counter(bits), SCAN_TYPE))
    spelt, kept, strings = kept_terms(scanned)
    counted = stored(
        spelt.join(kept.select("lid", "digest", "spell"), ["lid", "digest", "spell"], "left_semi")
        .groupBy("lid", "gid", "digest", "spell").agg(F.sum("n").alias("n"))
    )
    langs = kept.groupBy("lid").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = counted.groupBy("gid").agg(F.sum("n").alias("total"))
    known = groups.join(langs, "lid", "left").join(totals, "gid", "left")
    filled = known.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("terms", "lang_total", "total")})
    facts = stored(filled.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    entries = stored(
        counted.join(kept.select("lid", "digest", "spell", F.col("n").alias("lang_n")), ["lid", "digest", "spell"])
        .join(facts.select("gid", "terms", "total", "lang_total"), "gid")
        .select("lid", "gid", "digest", "spell", p.alias("p"), q.alias("q"))
    )
    return pair_part(entries, facts).unionByName(term_part(entries, strings, facts))
