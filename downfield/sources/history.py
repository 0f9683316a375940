"""Season files: delimited text with a header line per file."""

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from downfield.operators.clean import typed_history
from downfield.schema import HISTORY_COLUMNS


def _reader(spark: SparkSession) -> DataFrameReader:
    """Both an empty field and the files' "NA" are NULL from the scan on, so that the
    many missing values do not each fail a cast."""
    return spark.read.option("header", True).option("nullValue", "NA")


def scan_csv(spark: SparkSession, path: str | list[str], columns: list[str] = HISTORY_COLUMNS) -> DataFrame:
    """Season files that share one column layout, as text columns.

    No inference pass: types are applied later, value by value. The header is
    checked against ``columns``, because a given schema is matched by position.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return _reader(spark).schema(schema).option("enforceSchema", False).csv(path)


def scan_season(spark: SparkSession, path: str) -> DataFrame:
    """One season file in whatever layout its own header gives, typed."""
    raw = _reader(spark).csv(path)
    return typed_history(raw.select(*[c for c in HISTORY_COLUMNS if c in raw.columns]))


def union_seasons(seasons: list[DataFrame]) -> DataFrame:
    """All seasons by column name; a column some seasons lack is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seasons)


def load_seasons(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_seasons([scan_season(spark, p) for p in paths])
