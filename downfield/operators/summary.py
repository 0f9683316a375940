"""Counts, averages, rankings and look-ups over plays.

All of them combine on the map side first, so a season, team or game that
holds much of the data costs one row per task in the shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.constants import TEAMS
from downfield.functions.text import team_logo


def _pass_share() -> Column:
    return F.round(F.avg("is_pass") * 100, 1)


def season_stats(features: DataFrame) -> DataFrame:
    return (features.groupBy("season")
            .agg(F.count("*").alias("plays"),
                 F.round(F.avg("ep"), 2).alias("avg_ep"),
                 F.round(F.avg("epa"), 3).alias("avg_epa"),
                 _pass_share().alias("pass_rate_pct"))
            .orderBy("season"))


def team_rankings(features: DataFrame) -> DataFrame:
    return (features.groupBy("posteam")
            .agg(F.count("*").alias("plays"),
                 F.round(F.avg("epa"), 3).alias("avg_epa"),
                 _pass_share().alias("pass_rate"))
            .orderBy(F.desc("avg_epa"), "posteam"))


def top_teams(features: DataFrame, n: int = 10) -> DataFrame:
    return team_rankings(features).limit(n)


def row_counts(plays: DataFrame) -> DataFrame:
    """Rows read, run and pass rows, and rows that become features, in one pass."""
    chosen = F.col("play_type").isin("run", "pass")
    complete = F.col("down").isNotNull() & F.col("ydstogo").isNotNull() & F.col("yardline_100").isNotNull()
    return plays.agg(F.count("*").alias("loaded"),
                     F.count_if(chosen).alias("run_or_pass"),
                     F.count_if(chosen & complete).alias("features"))


def first_plays(plays: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` plays in the given order."""
    return plays.orderBy(*order).limit(n)


def pressure_rate(prepared: DataFrame) -> DataFrame:
    return prepared.agg(F.count_if(F.col("pressure") == 0).alias("no_pressure"),
                        F.count_if(F.col("pressure") == 1).alias("pressure"),
                        F.round(F.avg("pressure") * 100, 1).alias("pressure_rate_pct"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
                  F.min(target).alias("min"), F.max(target).alias("max"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    negatives, positives = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(F.try_divide(negatives, positives).alias("weight"))


def unique_games(plays: DataFrame) -> DataFrame:
    return plays.select("game_id").distinct()


def latest(plays: DataFrame, *order: str, by: list[str] | None = None) -> DataFrame:
    """The newest row, or the newest row per ``by`` key.

    The maximum of one struct keeps a single candidate per key and task. Ties
    on ``order`` fall to the remaining columns, so the choice is repeatable.
    """
    rest = [c for c in plays.columns if c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("row")
    picked = plays.groupBy(*(by or [])).agg(newest)
    return picked.filter("row is not null").select(*[F.col("row")[c].alias(c) for c in plays.columns])


def teams(spark: SparkSession) -> DataFrame:
    """The team dimension: 32 rows."""
    rows = spark.createDataFrame(TEAMS, "abbr string, name string, color string")
    return rows.withColumn("logo", team_logo(F.col("abbr")))


def with_team(df: DataFrame, key: str, prefix: str = "team_") -> DataFrame:
    """Add a team's name, colour and logo. The dimension has 32 rows, so it is broadcast."""
    dimension = teams(df.sparkSession).select(
        F.col("abbr").alias(key), *[F.col(c).alias(prefix + c) for c in ("name", "color", "logo")])
    return df.join(F.broadcast(dimension), key, "left")
