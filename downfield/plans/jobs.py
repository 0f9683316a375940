"""Batch job: season files in, feature table and reports out."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from downfield.operators.features import play_features
from downfield.operators.summary import season_stats, team_rankings
from downfield.sources.history import load_seasons
from downfield.sources.sinks import write_features


def build_features(spark: SparkSession, paths: list[str], out: str, replace: bool = True,
                   ) -> tuple[dict, DataFrame, DataFrame]:
    """Write the feature table; return row counts, season statistics and team ranking.

    The table is replaced, so that counts and reports tell of the same plays; without ``replace`` seasons of earlier
    runs stay and are part of the reports. The text is parsed once: counts are observed during the write, and both
    reports read back only their columns of the written Parquet.
    """
    seen, made = Observation("seen"), Observation("made")
    plays = load_seasons(spark, paths).observe(
        seen, F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("play_type").isin("run", "pass")).alias("run_or_pass"))
    features = play_features(plays).observe(made, F.count(F.lit(1)).alias("features"))
    write_features(features, out, replace=replace)
    table = spark.read.parquet(out)
    return {**seen.get, **made.get}, season_stats(table), team_rankings(table)
