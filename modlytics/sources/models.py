"""Save and load a fitted model with one row of facts beside it, alone or as numbered versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.operators.training import score
from modlytics.schema import LABELS
from modlytics.sources.files import matching, put_once, read_small


def save_model(model: PipelineModel, facts: DataFrame, path: str) -> None:
    """Write the model and its metadata row, replacing an older version."""
    model.write().overwrite().save(f"{path}/model")
    facts.withColumn("target_columns", F.array(*(F.lit(label) for label in LABELS))).coalesce(
        1
    ).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/metadata")


def newest_model_version(spark: SparkSession, path: str) -> int:
    """The number of the version that readers follow; 0 where nothing was published."""
    found = matching(spark, f"{path}/versions/*.json")
    return max((int(name.rsplit("/", 1)[1].removesuffix(".json")) for name in found), default=0)


def publish_model(model: PipelineModel, facts: DataFrame, path: str) -> int:
    """Save a model beside the versions that are there and make it the newest; its number.

    The model is written whole under a name of its own before its version names it, so readers of older
    versions keep their files and nobody sees half a model.  Of two writers the later takes the next number.
    """
    spark = facts.sparkSession
    name = uuid.uuid4().hex
    save_model(model, facts, f"{path}/models/{name}")
    number = newest_model_version(spark, path) + 1
    while not put_once(spark, f"{path}/versions/{number}.json", json.dumps({"model": name})):
        number += 1
    return number


def load_version(spark: SparkSession, path: str, number: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """A published version, the newest unless told otherwise."""
    number = newest_model_version(spark, path) if number is None else number
    if not number:
        raise FileNotFoundError(f"{path} holds no published model")
    name = json.loads(read_small(spark, f"{path}/versions/{number}.json"))["model"]
    return load_model(spark, f"{path}/models/{name}")


class ModelFollower:
    """Scores frames with the newest version, looked up at each call: the ``score`` of a stream follows new versions.

    A frame keeps the version it was scored with.  ``version`` is the one last used.
    """

    def __init__(self, spark: SparkSession, path: str, apply: Callable[[DataFrame, PipelineModel], DataFrame] = score):
        self.spark, self.path, self.apply = spark, path, apply
        self.version, self.model = 0, None

    def __call__(self, df: DataFrame) -> DataFrame:
        newest = newest_model_version(self.spark, self.path)
        if self.model is None or newest != self.version:
            self.model, _ = load_version(self.spark, self.path, newest)
            self.version = newest
        return self.apply(df, self.model)
