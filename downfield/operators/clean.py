"""Cleaning, filtering and projection of plays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.constants import MODEL_FILLS, PLAY_DEFAULTS
from downfield.functions.clean import (coerce_zero, nan_to_null_deep, number, safe_int, text_or_empty,
                                       whole_or_zero)


def typed_history(df: DataFrame) -> DataFrame:
    """Season-file text columns as ints and doubles."""
    doubles = {"ep", "wp", "epa", "time_to_throw"}
    texts = {"game_id", "posteam", "defteam", "posteam_type", "offense_formation", "offense_personnel",
             "play_type", "run_gap", "run_location", "route", "pass_length"}

    def typed(name: str) -> Column:
        if name in texts:
            return F.col(name)
        if name in doubles or name.endswith("_prob"):
            return number(name).alias(name)
        if name == "play_id":
            # Whole first: a double would round ids beyond 53 bits. "1.0" is no whole number and takes the other way.
            return F.coalesce(F.col(name).try_cast("bigint"), number(name).try_cast("bigint")).alias(name)
        return safe_int(name).alias(name)

    return df.select(*[typed(name) for name in df.columns])


def run_or_pass(df: DataFrame) -> DataFrame:
    return df.filter(F.col("play_type").isin("run", "pass"))


def pass_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("play_type") == "pass")


def drop_scrambles(df: DataFrame) -> DataFrame:
    """Drop scrambles; plays that do not say whether they are one stay."""
    return df.filter(~F.col("qb_scramble").eqNullSafe(1))


def require(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def coerce_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that exist become doubles with 0 for missing values."""
    return df.withColumns({
        f.name: coerce_zero(f.name, f.dataType) for f in df.schema.fields if f.name in columns})


def fill_defaults(df: DataFrame, fills: dict[str, object] = MODEL_FILLS) -> DataFrame:
    return df.na.fill({c: v for c, v in fills.items() if c in df.columns})


def play_defaults(df: DataFrame) -> DataFrame:
    """Complete a play: a missing column, or a NULL in one, takes its default."""
    present = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in present else F.lit(v) for c, v in PLAY_DEFAULTS.items()})


def play_event(df: DataFrame, event_time: Column | None = None) -> DataFrame:
    """Plays in the event layout, with 0, 0.0 or "" for what is missing.

    Columns the source lacks count as missing too. The event time is the
    moment of the query unless given.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def source(name: str) -> Column:
        return F.col(name) if name in kinds else F.lit(None)

    def whole(name: str, out: str = "int") -> Column:
        return whole_or_zero(source(name), out, kinds.get(name))

    def ints(*names: str) -> list[Column]:
        return [whole(n).alias(n) for n in names]

    def texts(*names: str) -> list[Column]:
        return [text_or_empty(source(n)).alias(n) for n in names]

    if event_time is None:
        event_time = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        *texts("game_id"), whole("play_id", "bigint").alias("play_id"), whole("qtr").alias("quarter"), *ints("down", "ydstogo", "yardline_100"),
        *texts("posteam", "defteam", "play_type"), *ints("shotgun", "no_huddle"),
        *texts("offense_formation"), *ints("defenders_in_box", "number_of_pass_rushers", "was_pressure"),
        coerce_zero(source("time_to_throw")).alias("time_to_throw"), coerce_zero(source("epa")).alias("epa"),
        event_time.alias("event_time"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL for every NaN, at any depth."""
    return df.select(*[nan_to_null_deep(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def one_game(df: DataFrame, game_id: str) -> DataFrame:
    return df.filter(F.col("game_id") == game_id)


def leading_team(df: DataFrame) -> DataFrame:
    """Flag which side leads and which has the ball."""
    ball = F.col("posteam")
    return df.withColumns({
        "home_leads": F.col("home_score") > F.col("away_score"),
        "away_leads": F.col("away_score") > F.col("home_score"),
        "home_has_ball": ball.eqNullSafe(F.col("home_team")),
        "away_has_ball": ball.eqNullSafe(F.col("away_team"))})
