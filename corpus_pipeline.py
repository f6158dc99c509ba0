"""From raw documents to token digests: quality rules, near-duplicates, secrets, mixing, byte-level BPE."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.llm import bagminhash, bpe, mixing, secrets
from modlytics.llm.common import noted, release, stored, table
from modlytics.llm.repetition import kept_rows

#: The rank file of the last stage.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """A stage that deletes those of its own working tables that its result does not read.

    What the result reads stays as long as the shared folder does, as nobody knows which frames are made from
    it; the stages keep that small.  Results of several stages and of several calls can be held at a time.
    """

    @functools.wraps(function)
    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with noted() as made:
            result = function(spark, docs, sf_dir)
        release(result, made)
        return result

    return cleaned


def recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it and the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; null and empty texts do not."""
    return kept_rows(docs)


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with one more column, its name second, that says in which file and where in it a row lies.

    A row keeps its place at every reading, so a stage can keep places alone and take the texts from ``docs`` again.
    Rows that are not read straight from Parquet files are written first.
    """
    relation = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    written = docs if relation and docs.inputFiles() and docs.inputFiles()[0].endswith(".parquet") else stored(docs)
    taken, name = {column.lower() for column in docs.columns}, "place"
    while name in taken or f"{name}spans" in taken:
        name += "_"
    file = written.metadataColumn("_metadata")
    return written.withColumn(name, F.concat_ws(":", file["file_path"], file["row_index"])), name


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id; nulls sort last.

    Null and empty texts are classes by themselves and stay; of repeated rows one stays; an empty table stays empty.
    """
    rows, place = placed(docs)
    marked = bagminhash.classes(rows.select(place, "doc_id", "text"))
    gone = stored(marked.filter("NOT first_of_class").select(place), "none")
    return rows.join(gone, place, "left_anti").select(*docs.columns)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by a mask; key-like strings that many sources hold stay.

    Null and empty texts hold nothing, each repeated row is masked by itself, and an empty table stays empty.
    """
    rows, place = placed(docs)
    found = secrets.find_secrets(rows.select(place, "text", "source", "lang"), carry=[place])
    hits = stored(found.filter(F.size("spans") > 0).select(place, F.col("spans").alias(f"{place}spans")), "none")
    spans = F.col(f"{place}spans")
    masked = F.when(spans.isNotNull(), secrets.mask(F.col("text"), spans)).otherwise(F.col("text"))
    return recount(rows.join(hits, place, "left").withColumn("text", masked).select(*docs.columns))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shard by shard in shuffled order."""
    return recount(mixing.mix_rows(docs))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    return bpe.digests(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("secret_scan", mask_secrets),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can express neither the near-duplicate classes nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage reads what the one before has written.

    Tables that this run has written go as soon as its frame does not read them.
    """
    docs = table(spark, sf_dir, "documents")
    with noted() as made:
        for place, (_, apply) in enumerate(STAGES):
            docs = apply(spark, docs, sf_dir)
            if place < len(STAGES) - 1:
                docs = stored(docs)
            release(docs, made)
    return docs
