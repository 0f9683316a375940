"""Rule-based scoring of whole frames. The three rule sets differ on purpose."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.constants import ENRICHED_COLUMNS
from downfield.functions import batch_rules, live_rules, stream_rules
from downfield.operators.clean import play_defaults


def calculate_pressure_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("pressure_probability", stream_rules.pressure_probability(
        F.col("number_of_pass_rushers"), F.col("defenders_in_box")))


def calculate_chaos_score(df: DataFrame) -> DataFrame:
    return df.withColumn("chaos_score", stream_rules.chaos_score(
        F.col("down"), F.col("ydstogo"), F.col("yardline_100"), F.col("number_of_pass_rushers")))


def predict_play_type(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_play_type", stream_rules.predicted_play_type(
        F.col("down"), F.col("ydstogo"), F.col("shotgun")))


def enrich(df: DataFrame) -> DataFrame:
    """Stream rules plus the processing time, on a batch or a stream."""
    scored = predict_play_type(calculate_chaos_score(calculate_pressure_probability(df)))
    return scored.withColumn("processed_at", F.current_timestamp())


def enriched_output(df: DataFrame) -> DataFrame:
    return df.select(*ENRICHED_COLUMNS)


def score_batch(df: DataFrame) -> DataFrame:
    """Batch rules on live plays."""
    down, to_go, yards = F.col("down"), F.col("ydstogo"), F.col("yardline_100")
    first = df.withColumns({
        "expected_points": batch_rules.expected_points(down, to_go, yards),
        "td_prob": batch_rules.td_probability(yards, down),
        "fg_prob": batch_rules.fg_probability(yards),
        "pressure_risk": batch_rules.pressure_risk(F.col("number_of_pass_rushers")),
        "pass_probability": batch_rules.pass_probability(down, to_go),
        "predicted_play": batch_rules.predicted_play(down, to_go)})
    return first.withColumns({
        "no_score_prob": batch_rules.no_score_probability(F.col("td_prob"), F.col("fg_prob")),
        "run_probability": F.lit(1.0) - F.col("pass_probability"),
        "processed_at": F.current_timestamp()})


def live_predictions(c=F.col) -> dict[str, Column]:
    """Live-rule predictions by name; ``c`` looks up an input column."""
    down, to_go, yards = c("down"), c("ydstogo"), c("yardline_100")
    td = live_rules.td_probability(yards, down)
    fg = live_rules.fg_probability(yards)
    passing = live_rules.pass_probability(
        down, to_go, c("half_seconds_remaining"), c("score_differential"), c("shotgun"))
    pressure = live_rules.pressure_probability(
        c("number_of_pass_rushers"), c("defenders_in_box"), down, to_go)
    return {
        "expected_points": live_rules.expected_points(down, to_go, yards),
        "td_prob": F.round(td, 3),
        "fg_prob": F.round(fg, 3),
        "no_score_prob": F.round(live_rules.no_score_probability(td, fg), 3),
        "opp_td_prob": F.lit(live_rules.OPPONENT_TD),
        "opp_fg_prob": F.lit(live_rules.OPPONENT_FG),
        "pass_probability": F.round(passing, 3),
        "run_probability": F.round(F.lit(1.0) - passing, 3),
        "predicted_play": live_rules.predicted_play(down, to_go, yards, passing),
        "pressure_probability": F.round(pressure, 3),
        "pressure_risk": live_rules.pressure_risk(pressure)}


def score_api(df: DataFrame) -> DataFrame:
    """Live rules on a set of plays, complete or not."""
    return play_defaults(df).withColumns(live_predictions())
