"""Read labelled comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlytics.operators.profile import require_columns
from modlytics.schema import COMMENT_SCHEMA


def _csv(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )


def csv_schema(names: list[str]) -> T.StructType:
    """Types for a CSV header: labels are whole numbers, everything else stays text."""
    known = {field.name: field.dataType for field in COMMENT_SCHEMA}
    return T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in names])


def read_comments(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Comment table from CSV with a header, or from parquet.

    The header may list the columns in any order and hold more of them.  ``comment_id``
    is that column, else ``id``, else a hash of the row and its file, which every reading repeats;
    equal rows of one file then share an id.

    Quoted texts may span lines, so a CSV file is read by one task: deliver large data as
    many files, or convert it to parquet once.
    """
    if format == "csv":
        header = _csv(spark).csv(path)
        require_columns(header)
        # The header is checked against the names in every file; a broken row is an error.
        df = (
            _csv(spark)
            .schema(csv_schema(header.columns))
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .csv(path)
        )
    else:
        df = require_columns(spark.read.format(format).load(path))
    if "comment_id" in df.columns:
        return df
    if "id" in df.columns:
        return df.withColumnRenamed("id", "comment_id")
    whole = F.concat(F.to_json(F.struct(*df.columns)), F.lit("|"), F.input_file_name())
    return df.withColumn("comment_id", F.md5(whole))


def join_labels(documents: DataFrame, labels: DataFrame, key: str = "comment_id") -> DataFrame:
    """Comments out of a text table and a label table; texts without labels are left out."""
    return require_columns(documents.join(labels, key))


def write_comments(df: DataFrame, path: str) -> None:
    """CSV that ``read_comments`` gives back unchanged; nulls stay apart from empty texts."""
    columns = [F.col(field.name).cast(field.dataType) for field in COMMENT_SCHEMA]
    df.select(*columns).write.option("header", True).option("escape", '"').option(
        "quoteAll", False
    ).csv(path)
