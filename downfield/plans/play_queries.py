"""Registered queries over plays: cleaning, features, rules and summaries."""

from pyspark.sql import functions as F

from downfield.constants import (CLASS_FEATURES, EP_FEATURES, HEADSHOT_URL, PRESSURE_FEATURES, SCORING_FEATURES,
                                 SCORING_TARGETS, TEAM_LOGO_URL, TEAMS, VECTOR_FEATURES)
from downfield.functions import situation, text
from downfield.functions.clean import safe_int
from downfield.operators import clean, features, score, summary
from downfield.plans.registry import query
from downfield.sources import testdata as data

KEYS = "game_id, play_id"
FROM_PLAYS = f"from ({data.HISTORY_SQL}) p"
FROM_LIVE = f"from ({data.LIVE_SQL}) p"

# ---------------------------------------------------------------- cleaning

# Numbers as text, some of them unusable.
LOOSE_SQL = f"""select {KEYS},
 case when partkey % 7 = 0 then 'NA' when partkey % 7 = 1 then '' when partkey % 7 = 2 then null
  when partkey % 7 = 3 then concat(cast(partkey as varchar(20)), '.0') else cast(partkey - 50 as varchar(20)) end as loose
 {FROM_PLAYS}"""


@query("safe_int", f"""select {KEYS}, cast(trunc(try_cast(loose as double)) as integer) as as_int,
 try_cast(loose as double) as as_double from ({LOOSE_SQL}) t""")
def q_safe_int(spark, sf):
    return data.view_sql(spark, sf, LOOSE_SQL).select(
        "game_id", "play_id", safe_int("loose").alias("as_int"),
        F.col("loose").try_cast("double").alias("as_double"))


@query("coerce_zero", f"select {KEYS}, coalesce(try_cast(loose as double), 0) as loose from ({LOOSE_SQL}) t")
def q_coerce_zero(spark, sf):
    return clean.coerce_columns(data.view_sql(spark, sf, LOOSE_SQL), ["loose"])


@query("fill_defaults", f"""select {KEYS}, coalesce(down, 1) as down, coalesce(goal_to_go, 0) as goal_to_go,
 coalesce(number_of_pass_rushers, 4) as number_of_pass_rushers {FROM_PLAYS}""")
def q_fill_defaults(spark, sf):
    return clean.fill_defaults(data.history(spark, sf), {
        "down": 1, "goal_to_go": 0, "number_of_pass_rushers": 4}).select(
        "game_id", "play_id", "down", "goal_to_go", "number_of_pass_rushers")


@query("play_event", f"""select game_id, play_id, qtr as quarter, coalesce(down, 0) as down, ydstogo, yardline_100,
 posteam, defteam, play_type, shotgun, no_huddle, coalesce(offense_formation, '') as offense_formation,
 coalesce(defenders_in_box, 0) as defenders_in_box, coalesce(number_of_pass_rushers, 0) as number_of_pass_rushers,
 coalesce(was_pressure, 0) as was_pressure, coalesce(time_to_throw, 0) as time_to_throw, epa {FROM_PLAYS}""")
def q_play_event(spark, sf):
    return clean.play_event(data.history(spark, sf)).drop("event_time")


@query("filter_runpass", f"select {KEYS}, play_type {FROM_PLAYS} where play_type in ('run', 'pass')")
def q_filter_runpass(spark, sf):
    return clean.run_or_pass(data.plays(spark, sf)).select("game_id", "play_id", "play_type")


@query("filter_pass", f"select {KEYS}, play_type {FROM_PLAYS} where play_type = 'pass'")
def q_filter_pass(spark, sf):
    return clean.pass_only(data.plays(spark, sf)).select("game_id", "play_id", "play_type")


@query("drop_scramble", f"select {KEYS}, qb_scramble {FROM_PLAYS} where qb_scramble is null or qb_scramble <> 1")
def q_drop_scramble(spark, sf):
    return clean.drop_scrambles(data.plays(spark, sf)).select("game_id", "play_id", "qb_scramble")


@query("require_cols", f"""select {KEYS}, down, was_pressure {FROM_PLAYS}
 where down is not null and was_pressure is not null""")
def q_require_cols(spark, sf):
    return clean.require(data.plays(spark, sf), "down", "was_pressure").select(
        "game_id", "play_id", "down", "was_pressure")


@query("nan_to_null", f"""select {KEYS}, case when partkey % 6 = 0 then null else time_to_throw end as time_to_throw,
 case when partkey % 5 = 0 then null else epa end as nested_epa, 2 as n,
 case when partkey % 4 = 0 then null else wp end as second {FROM_PLAYS}""")
def q_nan_to_null(spark, sf):
    nan = F.lit(float("nan"))
    dirty = data.history(spark, sf).select(
        "game_id", "play_id", F.coalesce("time_to_throw", nan).alias("time_to_throw"),
        F.struct(F.when(F.col("partkey") % 5 == 0, nan).otherwise(F.col("epa")).alias("epa")).alias("nested"),
        F.array(F.lit(1.0), F.when(F.col("partkey") % 4 == 0, nan).otherwise(F.col("wp"))).alias("list"))
    return clean.nan_to_null(dirty).select(
        "game_id", "play_id", "time_to_throw", F.col("nested.epa").alias("nested_epa"),
        F.size("list").alias("n"), F.get("list", F.lit(1)).alias("second"))


@query("play_defaults", f"""select {KEYS}, coalesce(down, 1) as down, ydstogo, yardline_100,
 coalesce(defenders_in_box, 6) as defenders_in_box, coalesce(number_of_pass_rushers, 4) as number_of_pass_rushers,
 1 as shotgun, 'home' as posteam_type {FROM_PLAYS}""")
def q_play_defaults(spark, sf):
    partial = data.plays(spark, sf).drop("shotgun", "posteam_type")
    return clean.play_defaults(partial).select(
        "game_id", "play_id", "down", "ydstogo", "yardline_100", "defenders_in_box", "number_of_pass_rushers",
        "shotgun", "posteam_type")


GAME = "1998_7_3"


@query("replay_game", f"""select game_id, play_id, qtr as quarter, coalesce(down, 0) as down, posteam, defteam, epa
 {FROM_PLAYS} where game_id = '{GAME}'""")
def q_replay_game(spark, sf):
    return clean.play_event(clean.one_game(data.plays(spark, sf), GAME)).select(
        "game_id", "play_id", "quarter", "down", "posteam", "defteam", "epa")


@query("leading_team", f"""select {KEYS}, home_score > away_score as home_leads, away_score > home_score as away_leads,
 posteam = home_team as home_has_ball, posteam = away_team as away_has_ball {FROM_LIVE}""")
def q_leading_team(spark, sf):
    return clean.leading_team(data.live_plays(spark, sf)).select(
        "game_id", "play_id", "home_leads", "away_leads", "home_has_ball", "away_has_ball")


# ---------------------------------------------------------------- features

def _flag(condition: str, name: str) -> str:
    return f"cast(case when {condition} then 1 else 0 end as integer) as {name}"


FEATURES_SQL = f"""select game_id, play_id, posteam, defteam, season, week, down, ydstogo, yardline_100, qtr,
 half_seconds_remaining, score_differential, shotgun, no_huddle, defenders_in_box, number_of_pass_rushers,
 ep, wp, epa, play_type, posteam_type,
 {_flag("yardline_100 <= 20", "red_zone")}, {_flag("yardline_100 <= 10", "goal_to_go_territory")},
 {_flag("ydstogo <= 3", "short_yardage")}, {_flag("ydstogo >= 8", "long_yardage")},
 {_flag("down >= 3", "late_down")}, {_flag("qtr = 4 and half_seconds_remaining <= 300", "late_game")},
 {_flag("defenders_in_box >= 7", "heavy_box")}, {_flag("defenders_in_box <= 5", "light_box")},
 {_flag("number_of_pass_rushers >= 5", "blitz")}, {_flag("posteam_type = 'home'", "posteam_is_home")},
 {_flag("play_type = 'pass'", "is_pass")}
 {FROM_PLAYS} where play_type in ('run', 'pass') and down is not null"""


@query("features", FEATURES_SQL)
def q_features(spark, sf):
    return features.play_features(data.history(spark, sf))


@query("situational", f"""select {KEYS},
 {_flag("half_seconds_remaining <= 120 and abs(score_differential) <= 8", "two_minute_drill")},
 {_flag("(down >= 3 and ydstogo >= 5) or (score_differential < -8 and qtr >= 3)", "pass_heavy_situation")},
 {_flag("(down <= 2 and ydstogo <= 4) or (score_differential > 14 and qtr >= 3)", "run_heavy_situation")},
 {_flag("number_of_pass_rushers >= 5", "extra_rushers")} {FROM_PLAYS}""")
def q_situational(spark, sf):
    return features.with_situation(data.plays(spark, sf)).select(
        "game_id", "play_id", "two_minute_drill", "pass_heavy_situation", "run_heavy_situation", "extra_rushers")


def _group(code: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(offense_personnel, '([0-9]+) {code}', 1), '') as integer), 0)"


PERSONNEL_SQL = f"""select *,
 case when offense_personnel is null then 1 else {_group("RB")} + {_group("FB")} end as n_rb,
 case when offense_personnel is null then 1 else {_group("TE")} end as n_te,
 case when offense_personnel is null then 3 else {_group("WR")} end as n_wr {FROM_PLAYS}"""


@query("personnel", f"""select {KEYS}, n_rb, n_te, n_wr, {_flag("n_rb >= 2 or n_te >= 2", "heavy_personnel")},
 {_flag("n_wr >= 3 and shotgun = 1", "spread_personnel")} from ({PERSONNEL_SQL}) t""")
def q_personnel(spark, sf):
    plays = features.with_personnel(data.plays(spark, sf))
    return plays.select(
        "game_id", "play_id", "n_rb", "n_te", "n_wr",
        situation.heavy_personnel(F.col("n_rb"), F.col("n_te")).alias("heavy_personnel"),
        situation.spread_personnel(F.col("n_wr"), F.col("shotgun")).alias("spread_personnel"))


PRESSURE_SQL = f"""select game_id, play_id, coalesce(down, 0) as down, ydstogo, yardline_100,
 posteam_score - defteam_score as score_differential, qtr, half_seconds_remaining, wp,
 posteam_timeouts_remaining, defteam_timeouts_remaining, shotgun, no_huddle,
 coalesce(defenders_in_box, 0) as defenders_in_box, coalesce(number_of_pass_rushers, 0) as number_of_pass_rushers,
 n_rb, n_te, n_wr, {_flag("number_of_pass_rushers >= 5", "blitz")},
 {_flag("down >= 3 and ydstogo >= 7", "obvious_passing")}, {_flag("yardline_100 <= 20", "red_zone")},
 {_flag("qtr >= 4 and half_seconds_remaining <= 300", "late_game")},
 coalesce(cast(number_of_pass_rushers as double) / (defenders_in_box + 1), 0) as rushers_ratio,
 was_pressure as pressure
 from ({PERSONNEL_SQL}) t
 where play_type = 'pass' and (qb_scramble is null or qb_scramble <> 1) and was_pressure is not null"""


def _as_double(columns, rest: str, source: str) -> str:
    return f"select {rest}, " + ", ".join(f"cast({c} as double) as {c}" for c in columns) + f" from ({source}) t"


@query("pressure_features", _as_double(PRESSURE_FEATURES, f"{KEYS}, pressure", PRESSURE_SQL))
def q_pressure_features(spark, sf):
    return features.prepare_pressure(data.history(spark, sf))


@query("score_diff", f"select {KEYS}, posteam_score - defteam_score as score_differential {FROM_PLAYS}")
def q_score_diff(spark, sf):
    plays = data.plays(spark, sf).drop("score_differential")
    return features.with_score_differential(plays).select("game_id", "play_id", "score_differential")


CLASS_SQL = f"""select *, case when play_type <> 'run' then null
  when coalesce(run_location, '') = 'middle' or coalesce(run_gap, '') = 'guard' then 'inside_run'
  else 'outside_run' end as run_type,
 case when play_type <> 'pass' then null when coalesce(route, '') = 'SCREEN' then 'screen'
  when coalesce(pass_length, '') = 'deep' then 'deep_pass' else 'short_pass' end as pass_type from ({PERSONNEL_SQL}) p"""


@query("play_class", f"""select {KEYS}, run_type, pass_type, coalesce(run_type, pass_type) as class_5
 from ({CLASS_SQL}) t""")
def q_play_class(spark, sf):
    return features.with_play_class(data.plays(spark, sf)).select(
        "game_id", "play_id", "run_type", "pass_type", "class_5")


CLASS_FEATURES_SQL = f"""select game_id, play_id, coalesce(down, 0) as down, ydstogo, yardline_100,
 posteam_score - defteam_score as score_differential, qtr, half_seconds_remaining, wp,
 posteam_timeouts_remaining, defteam_timeouts_remaining, shotgun, no_huddle,
 coalesce(defenders_in_box, 0) as defenders_in_box, coalesce(number_of_pass_rushers, 0) as number_of_pass_rushers,
 n_rb, n_te, n_wr, coalesce(goal_to_go, 0) as goal_to_go,
 {_flag("ydstogo <= 3", "short_yardage")}, {_flag("ydstogo >= 8", "long_yardage")},
 {_flag("yardline_100 <= 20", "red_zone")}, {_flag("down >= 3", "late_down")},
 {_flag("half_seconds_remaining <= 120 and abs(posteam_score - defteam_score) <= 8", "two_minute_drill")},
 {_flag("defenders_in_box >= 7", "heavy_box")}, {_flag("defenders_in_box <= 5", "light_box")},
 {_flag("number_of_pass_rushers >= 5", "extra_rushers")},
 {_flag("(down >= 3 and ydstogo >= 5) or (posteam_score - defteam_score < -8 and qtr >= 3)", "pass_heavy_situation")},
 {_flag("(down <= 2 and ydstogo <= 4) or (posteam_score - defteam_score > 14 and qtr >= 3)", "run_heavy_situation")},
 {_flag("n_rb >= 2 or n_te >= 2", "heavy_personnel")}, {_flag("n_wr >= 3 and shotgun = 1", "spread_personnel")},
 {_flag("play_type = 'pass'", "is_pass")}, run_type, pass_type, coalesce(run_type, pass_type) as class_5
 from ({CLASS_SQL}) t where play_type in ('run', 'pass') and (qb_scramble is null or qb_scramble <> 1)"""


@query("class_features", _as_double(CLASS_FEATURES, f"{KEYS}, is_pass, run_type, pass_type, class_5",
                                    CLASS_FEATURES_SQL))
def q_class_features(spark, sf):
    return features.prepare_class(data.history(spark, sf))


EP_SQL = f"""select {KEYS}, coalesce(down, 0) as down, ydstogo, yardline_100, half_seconds_remaining,
 posteam_timeouts_remaining, defteam_timeouts_remaining, score_differential,
 {_flag("posteam_type = 'home'", "posteam_is_home")}, qtr, coalesce(goal_to_go, 0) as goal_to_go, shotgun, no_huddle,
 ep, {", ".join(SCORING_TARGETS)} {FROM_PLAYS} where play_type in ('run', 'pass')"""


@query("ep_features", _as_double(EP_FEATURES, f"{KEYS}, ep", EP_SQL))
def q_ep_features(spark, sf):
    return features.prepare_ep(data.history(spark, sf))


@query("scoring_features", _as_double(SCORING_FEATURES + SCORING_TARGETS, KEYS,
                                      f"select * from ({EP_SQL}) s where td_prob is not null"))
def q_scoring_features(spark, sf):
    return features.prepare_scoring(data.history(spark, sf))


@query("goal_to_go", f"select {KEYS}, {_flag('yardline_100 <= ydstogo', 'goal_to_go')} {FROM_PLAYS}")
def q_goal_to_go(spark, sf):
    return data.plays(spark, sf).select(
        "game_id", "play_id", situation.goal_to_go(F.col("yardline_100"), F.col("ydstogo")).alias("goal_to_go"))


@query("feed_flags", f"""select {KEYS}, {_flag("half_seconds_remaining < 120", "no_huddle")},
 yardline_100 <= 20 as is_red_zone {FROM_PLAYS}""")
def q_feed_flags(spark, sf):
    return data.plays(spark, sf).select(
        "game_id", "play_id", situation.hurry_up(F.col("half_seconds_remaining")).alias("no_huddle"),
        situation.in_red_zone(F.col("yardline_100")).alias("is_red_zone"))


_CLOCK = "concat(cast(half_seconds_remaining // 60 as varchar), ':', lpad(cast(half_seconds_remaining % 60 as varchar), 2, '0'))"


@query("clock_text", f"""select {KEYS}, {_CLOCK} as clock, 'Q' || qtr || ' - ' || {_CLOCK} as detail,
 'Q' || qtr || ' ' || {_CLOCK} as short_detail, down || '&' || ydstogo as short_down_distance,
 down || '&' || ydstogo || ' at ' || posteam || ' ' || (100 - yardline_100) as down_distance,
 down || ' & ' || ydstogo || ' at ' || (100 - yardline_100) as spaced_down_distance,
 posteam || ' ball' as possession {FROM_PLAYS}""")
def q_clock_text(spark, sf):
    c = F.col
    period, seconds, spot = c("qtr"), c("half_seconds_remaining"), (c("down"), c("ydstogo"))
    return data.plays(spark, sf).select(
        "game_id", "play_id", text.clock(seconds).alias("clock"), text.period_clock(period, seconds).alias("detail"),
        text.period_clock(period, seconds, " ").alias("short_detail"),
        text.down_and_distance(*spot).alias("short_down_distance"),
        text.field_position(*spot, c("posteam"), c("yardline_100")).alias("down_distance"),
        text.own_yard_line(*spot, c("yardline_100")).alias("spaced_down_distance"),
        text.possession(c("posteam")).alias("possession"))


@query("stat_value", f"""select {KEYS}, partkey * 3 as leading, partkey % 500 as attempts_leading,
 cast(null as integer) as no_number {FROM_PLAYS}""")
def q_stat_value(spark, sf):
    lines = data.history(spark, sf).select(
        "game_id", "play_id",
        F.concat(F.format_number(F.col("partkey") * 3, 0), F.lit(" YDS, 2 TD")).alias("yards"),
        F.concat((F.col("partkey") % 500).cast("string"), F.lit("/474, 3398 YDS")).alias("attempts"))
    return lines.select(
        "game_id", "play_id", text.stat_value(F.col("yards")).cast("bigint").alias("leading"),
        text.stat_value(F.col("attempts")).cast("bigint").alias("attempts_leading"),
        text.stat_value(F.concat(F.lit("n/a "), "yards")).alias("no_number"))


def _code(column: str) -> str:
    return data._team(f"cast(substring({column}, 2, 2) as int)")


TEAM_PLAYS_SQL = f"select {KEYS}, partkey, {_code('posteam')} as posteam, epa {FROM_PLAYS}"


@query("team_logo", f"""select {KEYS}, '{TEAM_LOGO_URL[0]}' || lower(posteam) || '{TEAM_LOGO_URL[1]}' as logo,
 '{HEADSHOT_URL[0]}' || partkey || '{HEADSHOT_URL[1]}' as headshot from ({TEAM_PLAYS_SQL}) t""")
def q_team_logo(spark, sf):
    return data.view_sql(spark, sf, TEAM_PLAYS_SQL).select(
        "game_id", "play_id", text.team_logo(F.col("posteam")).alias("logo"),
        text.headshot(F.col("partkey")).alias("headshot"))


def _scaled(c: str) -> str:
    return (f"round((coalesce({c}, 0) - avg(coalesce({c}, 0)) over ()) / stddev_samp(coalesce({c}, 0)) over (), 6)"
            f" + 0.0 as {c}")


@query("scaled_features", f"select {KEYS}, {', '.join(_scaled(c) for c in VECTOR_FEATURES)} {FROM_PLAYS}")
def q_scaled_features(spark, sf):
    from pyspark.ml.functions import vector_to_array
    scaled = features.scaled_features(data.plays(spark, sf)).select(
        "game_id", "play_id", vector_to_array("features").alias("v"))
    return scaled.select("game_id", "play_id", *[
        (F.round(F.col("v")[i], 6) + F.lit(0.0)).alias(c) for i, c in enumerate(VECTOR_FEATURES)])


# ---------------------------------------------------------------- rules

STREAM_PRESSURE = """case when number_of_pass_rushers >= 5 then 7e-1 when number_of_pass_rushers >= 4 then 5e-1
 when defenders_in_box >= 7 then 6e-1 when defenders_in_box >= 6 then 4e-1 else 25e-2 end"""
CHAOS = """cast((case when down >= 3 then 30 else down * 5 end)
 + (case when ydstogo >= 10 then 25 when ydstogo >= 5 then 15 else 5 end)
 + (case when yardline_100 <= 20 then 25 when yardline_100 <= 40 then 15 else 5 end)
 + (case when number_of_pass_rushers >= 5 then 20 when number_of_pass_rushers >= 4 then 10 else 5 end) as integer)"""
STREAM_PLAY = """case when down = 1 and ydstogo = 10 then 'run' when down >= 3 and ydstogo >= 7 then 'deep_pass'
 when down >= 3 and ydstogo <= 3 then 'short_pass' when shotgun = 1 then 'pass' else 'run' end"""


@query("stream_pressure", f"select {KEYS}, {STREAM_PRESSURE} as pressure_probability {FROM_PLAYS}")
def q_stream_pressure(spark, sf):
    return score.calculate_pressure_probability(data.plays(spark, sf)).select(
        "game_id", "play_id", "pressure_probability")


@query("chaos_score", f"select {KEYS}, {CHAOS} as chaos_score {FROM_PLAYS}")
def q_chaos_score(spark, sf):
    return score.calculate_chaos_score(data.plays(spark, sf)).select("game_id", "play_id", "chaos_score")


@query("stream_play_type", f"select {KEYS}, {STREAM_PLAY} as predicted_play_type {FROM_PLAYS}")
def q_stream_play_type(spark, sf):
    return score.predict_play_type(data.plays(spark, sf)).select("game_id", "play_id", "predicted_play_type")


ENRICHED = f"""select game_id, play_id, qtr as quarter, coalesce(down, 0) as down, ydstogo, posteam, defteam, play_type,
 predicted_play_type, pressure_probability, was_pressure, time_to_throw, chaos_score, epa from (
 select game_id, play_id, qtr, down, ydstogo, posteam, defteam, play_type, was_pressure, time_to_throw, epa,
 {STREAM_PLAY} as predicted_play_type, {STREAM_PRESSURE} as pressure_probability, {CHAOS} as chaos_score
 from (select game_id, play_id, qtr, coalesce(down, 0) as down, ydstogo, yardline_100, posteam, defteam, play_type,
  shotgun, coalesce(defenders_in_box, 0) as defenders_in_box,
  coalesce(number_of_pass_rushers, 0) as number_of_pass_rushers, coalesce(was_pressure, 0) as was_pressure,
  coalesce(time_to_throw, 0) as time_to_throw, epa {FROM_PLAYS}) q) r"""


@query("enriched_output", ENRICHED)
def q_enriched_output(spark, sf):
    return score.enriched_output(score.enrich(clean.play_event(data.history(spark, sf)))).drop("processed_at")


def _raw_points(red: str, ten: str) -> str:
    return f"""(100 - yardline_100) * 6e-2 - 1e0
 + (case down when 1 then 5e-1 when 2 then 1e-1 when 3 then -4e-1 when 4 then -12e-1 else 0e0 end)
 + (case when ydstogo <= 3 then 4e-1 when ydstogo >= 10 then -3e-1 else 0e0 end)
 + (case when yardline_100 <= 20 then {red} else 0e0 end) + (case when yardline_100 <= 10 then {ten} else 0e0 end)
 + (case when yardline_100 <= 5 then 5e-1 else 0e0 end)"""


EP_BATCH = f"""case when down is null or yardline_100 is null then 0e0
 else trunc(({_raw_points("12e-1", "8e-1")}) * 1e2) / 1e2 end"""
TD_BATCH = """case when yardline_100 is null then 0e0 else least(trunc((case when yardline_100 <= 5 then 6e-1
 when yardline_100 <= 10 then 45e-2 when yardline_100 <= 20 then 3e-1 when yardline_100 <= 50 then 18e-2 else 1e-1 end)
 * (case down when 1 then 11e-1 when 4 then 6e-1 else 1e0 end) * 1e3) / 1e3, 95e-2) end"""
FG_BATCH = """case when yardline_100 is null then 0e0 when yardline_100 <= 13 then 9e-1 when yardline_100 <= 23 then 8e-1
 when yardline_100 <= 33 then 65e-2 when yardline_100 <= 38 then 45e-2 else 25e-2 end"""
NO_SCORE_BATCH = f"1e0 - ({TD_BATCH}) - ({FG_BATCH}) * 5e-1"
RISK_BATCH = """case when number_of_pass_rushers >= 5 then 'high' when number_of_pass_rushers <= 3 then 'low'
 else 'medium' end"""
PASS_BATCH = """case when ydstogo is null then 55e-2 when ydstogo >= 7 then 75e-2 when down >= 3 then 7e-1
 else 55e-2 end"""
PLAY_BATCH = "case when ydstogo <= 2 then 'run' when down = 4 then 'punt_or_fg' else 'pass' end"

# Unknown yards and distances for the batch rules, which must answer them too.
GAPS_SQL = f"""select {KEYS}, down, case when partkey % 10 = 0 then null else ydstogo end as ydstogo,
 case when partkey % 12 = 0 then null else yardline_100 end as yardline_100, number_of_pass_rushers {FROM_PLAYS}"""
FROM_GAPS = f"from ({GAPS_SQL}) g"


def _gaps(spark, sf):
    return score.score_batch(data.view_sql(spark, sf, GAPS_SQL))


def _register_batch(name: str, columns: dict[str, str]) -> None:
    text_of = ", ".join(f"{sql} as {c}" for c, sql in columns.items())

    @query(name, f"select {KEYS}, {text_of} {FROM_GAPS}")
    def run(spark, sf):
        return _gaps(spark, sf).select("game_id", "play_id", *columns)


_register_batch("ep_batch", {"expected_points": EP_BATCH})
_register_batch("td_batch", {"td_prob": TD_BATCH})
_register_batch("fg_batch", {"fg_prob": FG_BATCH})
_register_batch("no_score_batch", {"no_score_prob": NO_SCORE_BATCH})
_register_batch("pressure_risk_batch", {"pressure_risk": RISK_BATCH})
_register_batch("pass_batch", {"pass_probability": PASS_BATCH, "run_probability": f"1e0 - ({PASS_BATCH})"})
_register_batch("play_batch", {"predicted_play": PLAY_BATCH})

EP_API = f"round({_raw_points('15e-1', '1e0')}, 2)"
TD_API = """least((case when yardline_100 <= 5 then 55e-2 when yardline_100 <= 10 then 4e-1 when yardline_100 <= 20 then 28e-2
 when yardline_100 <= 50 then 15e-2 else 8e-2 end) * (case down when 1 then 11e-1 when 4 then 5e-1 else 1e0 end), 95e-2)"""
FG_API = """case when yardline_100 + 17 <= 30 then 92e-2 when yardline_100 + 17 <= 40 then 82e-2
 when yardline_100 + 17 <= 50 then 65e-2 when yardline_100 + 17 <= 55 then 45e-2 else 25e-2 end"""
NO_SCORE_API = f"greatest(5e-2, 1e0 - ({TD_API}) - ({FG_API}) * 3e-1)"
PASS_API = """least((case when ydstogo <= 2 then 4e-1 when half_seconds_remaining < 120 and score_differential < 0 then 85e-2
 when down = 3 and ydstogo >= 5 then 82e-2 when ydstogo >= 10 then 78e-2 when ydstogo >= 7 then 72e-2 else 55e-2 end)
 + (case when shotgun = 1 then 1e-1 else 0e0 end), 95e-2)"""
PLAY_API = f"""case when ydstogo <= 2 then 'run' when down = 4 and yardline_100 > 40 then 'punt'
 when down = 4 and yardline_100 <= 40 then 'field_goal' when ({PASS_API}) > 6e-1 then 'pass' else 'run' end"""
PRESSURE_API = """least((case when number_of_pass_rushers >= 6 then 55e-2 when number_of_pass_rushers >= 5 then 45e-2 else 25e-2 end)
 + (case when defenders_in_box >= 8 then 1e-1 else 0e0 end)
 + (case when down = 3 and ydstogo >= 7 then 1e-1 else 0e0 end), 8e-1)"""
RISK_API = f"""case when ({PRESSURE_API}) >= 45e-2 then 'high' when ({PRESSURE_API}) >= 3e-1 then 'medium' else 'low' end"""
SCORE_API = {
    "expected_points": EP_API, "td_prob": f"round({TD_API}, 3)", "fg_prob": FG_API,
    "no_score_prob": f"round({NO_SCORE_API}, 3)", "opp_td_prob": "5e-2", "opp_fg_prob": "2e-2",
    "pass_probability": f"round({PASS_API}, 3)", "run_probability": f"round(1e0 - ({PASS_API}), 3)",
    "predicted_play": PLAY_API, "pressure_probability": f"round({PRESSURE_API}, 3)", "pressure_risk": RISK_API}
COMPLETE_SQL = f"""select game_id, play_id, coalesce(down, 1) as down, ydstogo, yardline_100, half_seconds_remaining,
 score_differential, shotgun, coalesce(defenders_in_box, 6) as defenders_in_box,
 coalesce(number_of_pass_rushers, 4) as number_of_pass_rushers {FROM_PLAYS}"""
FROM_COMPLETE = f"from ({COMPLETE_SQL}) k"


def _register_api(name: str, columns: list[str]) -> None:
    @query(name, f"select {KEYS}, {', '.join(f'{SCORE_API[c]} as {c}' for c in columns)} {FROM_COMPLETE}")
    def run(spark, sf):
        return score.score_api(data.plays(spark, sf)).select("game_id", "play_id", *columns)


_register_api("ep_api", ["expected_points"])
_register_api("td_api", ["td_prob"])
_register_api("fg_api", ["fg_prob"])
_register_api("no_score_api", ["no_score_prob"])
_register_api("pass_api", ["pass_probability", "run_probability"])
_register_api("play_api", ["predicted_play"])
_register_api("pressure_api", ["pressure_probability", "pressure_risk"])
_register_api("score_api", list(SCORE_API))


@query("win_prob", f"""select {KEYS}, home_wp, 100 - home_wp as away_wp from (select {KEYS},
 least(greatest(b + (50 - b) * (1 - half_seconds_remaining / 9e2) * 3e-1, 5e0), 95e0) as home_wp
 from (select *, 50 + (home_score - away_score) * 25e-1 as b {FROM_LIVE}) t) u""")
def q_win_prob(spark, sf):
    c = F.col
    home = situation.win_probability(c("home_score"), c("away_score"), c("half_seconds_remaining"))
    return data.live_plays(spark, sf).select("game_id", "play_id", home.alias("home_wp"), (100 - home).alias("away_wp"))


# ---------------------------------------------------------------- summaries

@query("row_counts", f"""select count(*) as loaded, count(*) filter (where play_type in ('run', 'pass')) as run_or_pass,
 count(*) filter (where play_type in ('run', 'pass') and down is not null) as features {FROM_PLAYS}""")
def q_row_counts(spark, sf):
    return summary.row_counts(data.plays(spark, sf))


SEASON_SQL = f"""select season, count(*) as plays, round(avg(ep), 2) as avg_ep, round(avg(epa), 3) as avg_epa,
 round(avg(is_pass) * 100, 1) as pass_rate_pct from ({FEATURES_SQL}) f group by season"""
RANKING_SQL = f"""select posteam, count(*) as plays, round(avg(epa), 3) as avg_epa,
 round(avg(is_pass) * 100, 1) as pass_rate from ({FEATURES_SQL}) f group by posteam"""


@query("season_stats", SEASON_SQL + " order by season")
def q_season_stats(spark, sf):
    return summary.season_stats(features.play_features(data.history(spark, sf)))


@query("team_rankings", RANKING_SQL + " order by avg_epa desc, posteam")
def q_team_rankings(spark, sf):
    return summary.team_rankings(features.play_features(data.history(spark, sf)))


@query("team_top10", RANKING_SQL + " order by avg_epa desc, posteam limit 10")
def q_team_top10(spark, sf):
    return summary.top_teams(features.play_features(data.history(spark, sf)))


@query("first_n", f"""select {KEYS}, posteam, yardline_100, epa {FROM_PLAYS}
 order by game_id, play_id, posteam, yardline_100, epa limit 50""")
def q_first_n(spark, sf):
    plays = data.plays(spark, sf).select("game_id", "play_id", "posteam", "yardline_100", "epa")
    return summary.first_plays(plays, 50, *plays.columns)


@query("pressure_rate", f"""select count(*) filter (where pressure = 0) as no_pressure,
 count(*) filter (where pressure = 1) as pressure, round(avg(pressure) * 100, 1) as pressure_rate_pct
 from ({PRESSURE_SQL}) t""")
def q_pressure_rate(spark, sf):
    return summary.pressure_rate(features.prepare_pressure(data.history(spark, sf)))


@query("target_stats", f"""select round(avg(ep), 6) as mean, round(stddev_samp(ep), 6) as std, min(ep) as min,
 max(ep) as max from ({EP_SQL}) t""")
def q_target_stats(spark, sf):
    stats = summary.target_stats(features.prepare_ep(data.history(spark, sf)), "ep")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("class_weight", f"""select cast(count(*) filter (where pressure = 0) as double)
 / count(*) filter (where pressure = 1) as weight from ({PRESSURE_SQL}) t""")
def q_class_weight(spark, sf):
    return summary.class_weight(features.prepare_pressure(data.history(spark, sf)), "pressure")


@query("unique_games", f"select distinct game_id {FROM_PLAYS}")
def q_unique_games(spark, sf):
    return summary.unique_games(data.plays(spark, sf))


LATEST_COLUMNS = ["timestamp", "description", "game_id", "down", "ydstogo", "yardline_100", "posteam"]
LATEST_ORDER = ", ".join(f"{c} desc nulls last" for c in LATEST_COLUMNS)


@query("latest_play", f"select {', '.join(LATEST_COLUMNS)} {FROM_LIVE} order by {LATEST_ORDER} limit 1")
def q_latest_play(spark, sf):
    return summary.latest(data.live_plays(spark, sf).select(*LATEST_COLUMNS), "timestamp", "description")


@query("latest_play_by_game", f"""select {', '.join(LATEST_COLUMNS)} from (select *,
 row_number() over (partition by game_id order by {LATEST_ORDER}) as n {FROM_LIVE}) t where n = 1""")
def q_latest_play_by_game(spark, sf):
    return summary.latest(data.live_plays(spark, sf).select(*LATEST_COLUMNS), "timestamp", "description",
                          by=["game_id"])


_TEAM_ROWS = ", ".join(f"('{a}', '{n}', '{c}')" for a, n, c in TEAMS)


@query("team_lookup", f"""select {KEYS}, posteam, name as team_name, color as team_color,
 '{TEAM_LOGO_URL[0]}' || lower(abbr) || '{TEAM_LOGO_URL[1]}' as team_logo
 from ({TEAM_PLAYS_SQL}) p left join (values {_TEAM_ROWS}) t(abbr, name, color) on p.posteam = t.abbr""")
def q_team_lookup(spark, sf):
    plays = data.view_sql(spark, sf, TEAM_PLAYS_SQL).select("game_id", "play_id", "posteam")
    return summary.with_team(plays, "posteam")
