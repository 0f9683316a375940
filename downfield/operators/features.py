"""Feature frames for reporting and for the models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.constants import (CLASS_FEATURES, EP_FEATURES, MODEL_FILLS, PRESSURE_FEATURES, SCORING_FEATURES,
                                 SCORING_TARGETS, VECTOR_FEATURES)
from downfield.functions import situation as s
from downfield.functions.clean import number, safe_int
from downfield.functions.rules import flag
from downfield.operators.clean import (coerce_columns, drop_scrambles, fill_defaults, pass_only, require,
                                       run_or_pass)


def play_features(df: DataFrame) -> DataFrame:
    """Run and pass plays with situational flags; needs down, distance and yard line.

    One projection over the scan: nothing is shuffled, and a later aggregation
    reads only the columns it uses.
    """
    yards, to_go, down = number("yardline_100"), number("ydstogo"), number("down")
    quarter, seconds = number("qtr"), number("half_seconds_remaining")
    defenders, rushers = number("defenders_in_box"), number("number_of_pass_rushers")
    ints = ["season", "week", "down", "ydstogo", "yardline_100", "qtr", "half_seconds_remaining",
            "score_differential", "shotgun", "no_huddle", "defenders_in_box", "number_of_pass_rushers"]
    features = run_or_pass(df).select(
        "game_id", "play_id", "posteam", "defteam",
        *[safe_int(c).alias(c) for c in ints],
        *[number(c).alias(c) for c in ("ep", "wp", "epa")],
        "play_type", "posteam_type",
        s.red_zone(yards).alias("red_zone"),
        s.goal_to_go_territory(yards).alias("goal_to_go_territory"),
        s.short_yardage(to_go).alias("short_yardage"),
        s.long_yardage(to_go).alias("long_yardage"),
        s.late_down(down).alias("late_down"),
        s.late_game(quarter, seconds).alias("late_game"),
        s.heavy_box(defenders).alias("heavy_box"),
        s.light_box(defenders).alias("light_box"),
        s.blitz(rushers).alias("blitz"),
        flag(F.col("posteam_type") == "home").alias("posteam_is_home"),
        flag(F.col("play_type") == "pass").alias("is_pass"))
    return require(features, "down", "ydstogo", "yardline_100")


def _home_flag(df: DataFrame) -> DataFrame:
    value = flag(F.col("posteam_type") == "home") if "posteam_type" in df.columns else F.lit(0)
    return df.withColumn("posteam_is_home", value)


def _numeric_inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features as numbers. Missing values become 0 first, as the published order
    of steps has it, so the later fills find nothing left to replace."""
    fills = {c: MODEL_FILLS[c] for c in columns if c in MODEL_FILLS}
    return fill_defaults(coerce_columns(_home_flag(df), columns), fills)


def prepare_ep(df: DataFrame) -> DataFrame:
    plays = require(run_or_pass(_numeric_inputs(df, EP_FEATURES)), "ep")
    return plays.select("game_id", "play_id", *EP_FEATURES, number("ep").alias("ep"))


def prepare_scoring(df: DataFrame) -> DataFrame:
    plays = run_or_pass(_numeric_inputs(df, SCORING_FEATURES))
    plays = plays.select("game_id", "play_id", *SCORING_FEATURES,
                         *[number(c).alias(c) for c in SCORING_TARGETS])
    return require(plays, *SCORING_TARGETS)


def with_personnel(df: DataFrame) -> DataFrame:
    return (df.withColumn("personnel", s.parse_personnel(F.col("offense_personnel")))
            .withColumns({c: F.col("personnel")[c] for c in ("n_rb", "n_te", "n_wr")})
            .drop("personnel"))


def with_score_differential(df: DataFrame) -> DataFrame:
    return df.withColumn("score_differential", F.col("posteam_score") - F.col("defteam_score"))


def with_play_class(df: DataFrame) -> DataFrame:
    run = s.run_type(F.col("play_type"), F.col("run_location"), F.col("run_gap"))
    thrown = s.pass_type(F.col("play_type"), F.col("route"), F.col("pass_length"))
    return df.withColumns({"run_type": run, "pass_type": thrown, "class_5": F.coalesce(run, thrown)})


def with_situation(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "short_yardage": s.short_yardage(c("ydstogo")),
        "long_yardage": s.long_yardage(c("ydstogo")),
        "red_zone": s.red_zone(c("yardline_100")),
        "late_down": s.late_down(c("down")),
        "two_minute_drill": s.two_minute_drill(c("half_seconds_remaining"), c("score_differential")),
        "heavy_box": s.heavy_box(c("defenders_in_box")),
        "light_box": s.light_box(c("defenders_in_box")),
        "extra_rushers": s.blitz(c("number_of_pass_rushers")),
        "pass_heavy_situation": s.pass_heavy(c("down"), c("ydstogo"), c("score_differential"), c("qtr")),
        "run_heavy_situation": s.run_heavy(c("down"), c("ydstogo"), c("score_differential"), c("qtr"))})


def prepare_class(df: DataFrame) -> DataFrame:
    """Inputs and labels of the five-class play classifier."""
    plays = with_score_differential(drop_scrambles(run_or_pass(df)))
    plays = with_situation(with_personnel(with_play_class(plays)))
    plays = plays.withColumns({
        "is_pass": flag(F.col("play_type") == "pass"),
        "heavy_personnel": s.heavy_personnel(F.col("n_rb"), F.col("n_te")),
        "spread_personnel": s.spread_personnel(F.col("n_wr"), F.col("shotgun"))})
    plays = require(coerce_columns(plays, CLASS_FEATURES), "class_5")
    return plays.select("game_id", "play_id", *CLASS_FEATURES, "is_pass", "run_type", "pass_type", "class_5")


def with_pressure_features(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "blitz": s.blitz(c("number_of_pass_rushers")),
        "obvious_passing": s.obvious_passing(c("down"), c("ydstogo")),
        "red_zone": s.red_zone(c("yardline_100")),
        "late_game": s.late_game(c("qtr"), c("half_seconds_remaining"), overtime=True),
        "rushers_ratio": s.rushers_ratio(c("number_of_pass_rushers"), c("defenders_in_box"))})


def prepare_pressure(df: DataFrame) -> DataFrame:
    """Inputs and label of the pressure model: pass plays that are no scrambles."""
    plays = require(drop_scrambles(pass_only(df)), "was_pressure")
    plays = with_pressure_features(with_personnel(with_score_differential(plays)))
    plays = plays.withColumn("pressure", safe_int("was_pressure"))
    plays = require(coerce_columns(plays, PRESSURE_FEATURES), "pressure")
    return plays.select("game_id", "play_id", *PRESSURE_FEATURES, "pressure")


def fit_scaler(df: DataFrame, columns: list[str] = VECTOR_FEATURES):
    """A pipeline model that holds the means and deviations of ``columns``, from one aggregation pass; missing values
    count as 0. It can be saved, loaded and applied to other plays."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=columns, outputCol="raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    return Pipeline(stages=stages).fit(coerce_columns(df, columns))


def apply_scaler(model, df: DataFrame) -> DataFrame:
    """Add ``features``, scaled by the figures the model was fitted on. Missing values count as 0, also in the scaled columns."""
    return model.transform(coerce_columns(df, model.stages[0].getInputCols())).drop("raw_features")


def scaled_features(df: DataFrame, columns: list[str] = VECTOR_FEATURES) -> DataFrame:
    """The documented input vector, each feature with mean 0 and deviation 1 over the plays of ``df``."""
    return apply_scaler(fit_scaler(df, columns), df)
