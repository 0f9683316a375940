"""Registered queries over feed documents.

The Spark side builds JSON documents, parses and flattens them; the oracles
state the outcome from the flat game rows the documents were made of.
"""

from pyspark.sql import functions as F

from downfield.functions import feed as f
from downfield.functions.text import clock_seconds
from downfield.operators import feed
from downfield.operators.clean import nan_to_null
from downfield.plans.play_queries import SCORE_API
from downfield.plans.registry import query
from downfield.session import dropping_shuffles, materialise, new_dir
from downfield.sources import testdata as data
from downfield.sources.records import to_keyed_json
from downfield.sources.sinks import read_newest, write_newest

GAMES = f"({data.GAMES_SQL}) g"

SCORES = "coalesce(try_cast(home_score as integer), 0) as home_points, cast(away_score as integer) as away_points"
# What the summary tells, with the defaults for what it leaves out.
NOW_SQL = f"""select *, {SCORES},
 case when has_situation then coalesce(down, 0) else 0 end as now_down,
 case when has_situation then coalesce(distance, 0) else 0 end as now_distance,
 case when has_situation then coalesce(yard_line, 50) else 50 end as now_line,
 coalesce(possession, '') = home_abbr and has_situation as home_ball,
 coalesce(status_period, case when has_situation then situation_period end, 1) as now_period
 from {GAMES}"""
SITUATION_SQL = f"""select *, case when now_line = 0 then 75 when home_ball then 100 - now_line else now_line end as yards,
 case when home_ball then home_points - away_points else away_points - home_points end as lead,
 case when home_ball then home_abbr else away_abbr end as pos, case when home_ball then away_abbr else home_abbr end as def
 from ({NOW_SQL}) n"""
HALF_SECONDS = """case when display_clock = 'Half' then 900
 else (case when display_clock is null then 900 when display_clock = '7' then 420
  else cast(split_part(display_clock, ':', 1) as integer) * 60 + cast(split_part(display_clock, ':', 2) as integer) end)
  + (case when now_period in (1, 3) then 900 else 0 end) end"""


def _games(spark, sf):
    events, summaries = data.feed_documents(spark, sf)
    return feed.game_summary_join(events, summaries)


@query("game_summary_join", f"""select game_id, has_summary, concat('s:20~e:', game_id) as uid,
 case when has_situation then down end as down from {GAMES}""")
def q_game_summary_join(spark, sf):
    return _games(spark, sf).select(
        "game_id", F.col("s").isNotNull().alias("has_summary"), F.col("e.uid").alias("uid"),
        F.col("s.situation.down").alias("down"))


@query("live_only", f"""select game_id, state from ({NOW_SQL}) n where state = 'in' and now_down > 0""")
def q_live_only(spark, sf):
    events, summaries = data.feed_documents(spark, sf)
    records = feed.flatten_feed(feed.live_only(events), summaries)
    return feed.playable(records).select("game_id", F.col("status.state").alias("state"))


@query("home_away_pivot", f"""select game_id, home_id, home_abbr, home_points, 'The ' || home_abbr as home_name,
 away_id, away_abbr, away_points from ({NOW_SQL}) n""")
def q_home_away_pivot(spark, sf):
    home, away = F.col("home_team_full"), F.col("away_team_full")
    return feed.home_away(_games(spark, sf)).select(
        "game_id", home["id"].alias("home_id"), home["abbreviation"].alias("home_abbr"),
        home["score"].alias("home_points"), home["displayName"].alias("home_name"),
        away["id"].alias("away_id"), away["abbreviation"].alias("away_abbr"), away["score"].alias("away_points"))


@query("team_records", f"""select game_id, record_overall as overall, record_home as home, record_road as away,
 record_overall as record, cast(null as varchar) as away_overall from {GAMES}""")
def q_team_records(spark, sf):
    home = F.col("home_team_full")
    return feed.home_away(_games(spark, sf)).select(
        "game_id", *f.pick(home["records"], "overall", "home", "away"), home["record"].alias("record"),
        F.col("away_team_full")["record"].alias("away_overall"))


@query("team_leaders", f"""select game_id,
 case when passer is null then null when passer_has_full_name then passer else passer || ' Jr.' end as passer,
 case when passer is not null then passer_line end as passer_line,
 case when passer is not null then passer_value end as passer_value,
 case when passer is not null then 'QB' end as passer_position,
 case when passer is not null then coalesce(passer_active, true) end as passer_active,
 'Rusher ' || c as rusher, rusher_line, true as rusher_active, home_id as rusher_team,
 cast(null as varchar) as receiver,
 case when k % 14 = 7 then 'Rusher ' || c end as game_rusher from {GAMES}""")
def q_team_leaders(spark, sf):
    lead = F.col("home_team_full")["leaders"]
    passing, rushing = lead["passing"], lead["rushing"]
    return feed.home_away(_games(spark, sf)).select(
        "game_id", passing["name"].alias("passer"), passing["displayValue"].alias("passer_line"),
        passing["value"].alias("passer_value"), passing["position"].alias("passer_position"),
        passing["active"].alias("passer_active"), rushing["name"].alias("rusher"),
        rushing["displayValue"].alias("rusher_line"), rushing["active"].alias("rusher_active"),
        rushing["teamId"].alias("rusher_team"), lead["receiving"]["name"].alias("receiver"),
        f.leaders(F.col("comp")["leaders"])["rushing"]["name"].alias("game_rusher"))


@query("odds_flat", f"""select game_id, case when has_odds then 'Book ' || (k % 3) end as provider,
 case when has_odds then spread end as spread, case when has_odds then over_under end as over_under,
 case when has_odds then home_ml end as home_money, case when has_odds then '-110' end as home_open,
 case when has_odds then '+120' end as away_money, case when has_odds then away_ml_open end as away_open,
 case when has_odds then over_line end as over_line, case when has_odds then '-105' end as over_odds,
 cast(null as varchar) as spread_line, case when has_odds then coalesce(home_favorite, false) end as home_favorite,
 case when has_odds then false end as away_favorite from {GAMES}""")
def q_odds_flat(spark, sf):
    events, _ = data.feed_documents(spark, sf)
    o = F.col("o")
    return feed.parse_events(events).select("game_id", f.odds(F.col("comp")).alias("o")).select(
        "game_id", o["provider"].alias("provider"), o["spread"].alias("spread"), o["overUnder"].alias("over_under"),
        o["homeMoneyLine"].alias("home_money"), o["moneyline"]["homeOpen"].alias("home_open"),
        o["moneyline"]["away"].alias("away_money"), o["moneyline"]["awayOpen"].alias("away_open"),
        o["total"]["over"]["line"].alias("over_line"), o["total"]["over"]["odds"].alias("over_odds"),
        o["pointSpread"]["home"]["line"].alias("spread_line"), o["homeFavorite"].alias("home_favorite"),
        o["awayFavorite"].alias("away_favorite"))


@query("possession", f"""select game_id, now_down as down, now_distance as ydstogo, yards as yardline_100,
 lead as score_differential, pos as posteam, def as defteam,
 case when home_ball then 'home' else 'away' end as posteam_type,
 cast(case when yards <= now_distance then 1 else 0 end as integer) as goal_to_go from ({SITUATION_SQL}) t""")
def q_possession(spark, sf):
    return feed.with_situation(feed.home_away(_games(spark, sf))).select(
        "game_id", "down", "ydstogo", "yardline_100", "score_differential", "posteam", "defteam",
        "posteam_type", "goal_to_go")


@query("clock_parse", f"""select game_id, cast(now_period as integer) as period,
 cast({HALF_SECONDS} as integer) as half_seconds_remaining from ({NOW_SQL}) n""")
def q_clock_parse(spark, sf):
    games = _games(spark, sf)
    period = f.period(F.col("e"), F.col("s"))
    return games.select("game_id", period.alias("period"), clock_seconds(
        f.display_clock(F.col("e")), period).alias("half_seconds_remaining"))


@query("feed_dims", f"""select game_id, temperature, case when temperature is not null then 'Clear' end as sky,
 case when temperature is not null then 'w' end as weather_link, 'v' || (k % 40) as venue_id,
 'Field ' || (k % 40) as venue, 'City ' || (k % 30) as city, coalesce(indoor, false) as indoor,
 coalesce(grass, true) as grass, capacity, cast(1 + k % 18 as integer) as week, false as conference,
 away_abbr || ' at ' || home_abbr as event_name, false as completed,
 case when has_summary and has_game_info then 60000 + c % 7000 end as attendance,
 case when has_summary and has_game_info then 'Cloudy' end as condition,
 case when has_tickets then 'from $90' end as tickets,
 case when has_tickets then c % 5000 end as available,
 case when has_tickets and has_ticket_link then 't/' || game_id end as ticket_link,
 case when has_summary and has_predictor then round(home_projection, 3) end as home_win,
 case when has_summary and has_predictor then round(100 - home_projection, 3) end as away_win from {GAMES}""")
def q_feed_dims(spark, sf):
    e, s, comp, c = F.col("e"), F.col("s"), F.col("comp"), F.col
    dims = _games(spark, sf).select(
        "game_id", f.weather(e).alias("w"), f.venue(comp).alias("v"), f.event_info(e, comp).alias("i"),
        f.status(e, s).alias("st"), f.game_info(s).alias("g"), f.tickets(comp).alias("t"),
        f.predictor(s).alias("p"))
    return dims.select(
        "game_id", c("w.temperature").alias("temperature"), c("w.displayValue").alias("sky"),
        c("w.link").alias("weather_link"), c("v.id").alias("venue_id"), c("v.name").alias("venue"),
        c("v.city").alias("city"), c("v.indoor").alias("indoor"), c("v.grass").alias("grass"),
        c("v.capacity").alias("capacity"), c("i.week").alias("week"),
        c("i.conferenceCompetition").alias("conference"), c("i.name").alias("event_name"),
        c("st.completed").alias("completed"), c("g.attendance").alias("attendance"),
        c("g.weatherCondition").alias("condition"), c("t.summary").alias("tickets"),
        c("t.numberAvailable").alias("available"), c("t.link").alias("ticket_link"),
        F.round(c("p.homeWinProbability"), 3).alias("home_win"),
        F.round(c("p.awayWinProbability"), 3).alias("away_win"))


@query("wp_last10", f"""select game_id, cast(k * 100 + i as varchar) as play_id,
 cast((i * 7 + c) % 100 as double) / 100 as home_win, cast(3600 - i * 30 as integer) as seconds_left
 from (select *, unnest(range(cast(greatest(n_wp - 10, 0) as bigint), cast(n_wp as bigint))) as i
 from {GAMES} where has_summary) t""")
def q_wp_last10(spark, sf):
    return _games(spark, sf).select("game_id", F.inline(f.win_history(F.col("s")))).select(
        "game_id", F.col("playId").alias("play_id"), F.col("homeWinPercentage").alias("home_win"),
        F.col("secondsLeft").alias("seconds_left"))


@query("broadcasts", f"""select game_id,
 case n_broadcasts when 0 then '' when 1 then 'N0,M0' else 'N0,M0,N1,M1' end as names,
 cast(n_geo as integer) as n_geo, case when n_geo = 1 then 'TV' end as geo_type,
 case when n_geo = 1 then 'Net0' end as geo_media, cast(null as varchar) as geo_market from {GAMES}""")
def q_broadcasts(spark, sf):
    events, _ = data.feed_documents(spark, sf)
    comp = F.col("comp")
    geo = f.first(F.col("geo"))
    return feed.parse_events(events).select(
        "game_id", f.broadcasts(comp).alias("names"), f.geo_broadcasts(comp).alias("geo")).select(
        "game_id", F.array_join("names", ",").alias("names"), F.size("geo").alias("n_geo"),
        geo["type"].alias("geo_type"), geo["media"].alias("geo_media"), geo["market"].alias("geo_market"))


@query("links", f"""select game_id, 'g/' || game_id as gamecast,
 case when has_boxscore_link then 'b/' || game_id end as boxscore, 'p/' || game_id as playbyplay from {GAMES}""")
def q_links(spark, sf):
    events, _ = data.feed_documents(spark, sf)
    return feed.parse_events(events).select("game_id", f.links(F.col("e")).alias("l")).select("game_id", "l.*")


@query("last_play", f"""select game_id, has_situation and has_last_play as told,
 case when has_situation and has_last_play then 'lp' || k end as id,
 case when has_situation and has_last_play then 0 end as score_value,
 case when has_situation and has_last_play then home_abbr end as team,
 case when has_situation and has_last_play then (case n_athletes when 0 then '' when 1 then 'Athlete 0'
  else 'Athlete 0|Athlete 1' end) end as athletes from {GAMES}""")
def q_last_play(spark, sf):
    p = F.col("p")
    return _games(spark, sf).select("game_id", f.last_play(F.col("s")).alias("p")).select(
        "game_id", p.isNotNull().alias("told"), p["id"].alias("id"), p["scoreValue"].alias("score_value"),
        p["team"].alias("team"), F.array_join(p["athletesInvolved"], "|").alias("athletes"))


FEED_PLAYS_SQL = f"""select *, {data.FEED_PLAY_COLUMNS} from (
 select *, unnest(range(0, 1 + (k + d) % 3)) as i from (
 select *, unnest(list_concat(range(1, 1 + n_previous::bigint), case when has_current then [99] else [] end)) as d
 from {GAMES} where has_summary) a) b"""


@query("explode_plays", f"select game_id, game_id || '-' || d as drive_id, id, play_text as text from ({FEED_PLAYS_SQL}) t")
def q_explode_plays(spark, sf):
    return feed.explode_plays(*data.feed_documents(spark, sf)).select(
        "game_id", "drive_id", F.col("play.id").alias("id"), F.col("play.text").alias("text"))


@query("parse_feed_play", f"""select game_id, try_cast(id as bigint) as play_id, period as quarter,
 coalesce(play_down, 0) as down, play_distance as ydstogo, to_endzone as yardline_100,
 case team_id when home_id then home_abbr when away_id then away_abbr else '' end as posteam,
 case team_id when home_id then away_abbr when away_id then home_abbr else '' end as defteam,
 play_kind as play_type, home_abbr as home_team, away_abbr as away_team, play_text as description,
 coalesce(team_id, '') as posteam_id from ({FEED_PLAYS_SQL}) t""")
def q_parse_feed_play(spark, sf):
    plays = feed.parse_feed_play(feed.explode_plays(*data.feed_documents(spark, sf)))
    return plays.select("game_id", "play_id", "quarter", "down", "ydstogo", "yardline_100", "posteam", "defteam",
                        "play_type", "home_team", "away_team", "description", "posteam_id")


RICH_FLAT = f"""select *, now_down as down, now_distance as ydstogo, yards as yardline_100, lead as score_differential,
 cast({HALF_SECONDS} as integer) as half_seconds_remaining, 1 as shotgun, 6 as defenders_in_box,
 4 as number_of_pass_rushers
 from (select * exclude (down) from ({SITUATION_SQL}) t) u where state = 'in' and now_down > 0"""


RICH_SQL = f"""select game_id, concat('s:20~e:', game_id) as event_uid, state, pos as posteam, def as defteam,
 down, ydstogo, yardline_100, score_differential, half_seconds_remaining, home_abbr as home_team, home_points as home_score,
 away_points as away_score, coalesce(red_zone, false) as is_red_zone, record_overall as home_record,
 'City ' || (k % 30) as city, case when has_odds then home_ml end as home_money,
 cast(least(n_wp, 10) as integer) as n_history, cast(2 * n_broadcasts as integer) as n_names,
 {", ".join(f"{sql} as {c}" for c, sql in SCORE_API.items())} from ({RICH_FLAT}) r"""


def _rich(records):
    c = F.col
    return records.select(
        "game_id", "event_uid", c("status.state").alias("state"), "posteam", "defteam", "down", "ydstogo",
        "yardline_100", "score_differential", "half_seconds_remaining", "home_team", "home_score", "away_score",
        c("situation.isRedZone").alias("is_red_zone"), c("home_team_full.record").alias("home_record"),
        c("venue.city").alias("city"), c("odds.homeMoneyLine").alias("home_money"),
        F.size("winProbabilityHistory").alias("n_history"), F.size("broadcasts").alias("n_names"),
        "ml_predictions.*")


@query("rich_record", RICH_SQL)
def q_rich_record(spark, sf):
    return _rich(feed.live_records(*data.feed_documents(spark, sf)))


@query("rich_round_trip", RICH_SQL)
def q_rich_round_trip(spark, sf):
    """Records published as keyed JSON, read back, scored anew, merged to the newest per game, and freed of NaN. Some
    come twice, an older copy with another score; some texts are broken."""
    published = materialise(to_keyed_json(feed.live_records(*data.feed_documents(spark, sf)).drop("processed_at")), compression="zstd")
    older = published.select("key", F.regexp_replace("value", r'"timestamp":"\d+', '"timestamp":"1999').alias("value"))
    broken = published.filter(F.crc32(F.col("key").cast("binary")) % 3 == 0).select("key", F.expr("left(value, 40)").alias("value"))
    path = new_dir(spark, "records")
    for batch_id, part in enumerate((published, older.unionByName(broken))):
        records = feed.decoded_records(part).drop("key")
        with dropping_shuffles(spark):
            write_newest(records, batch_id, path, "game_id", "timestamp")
    return _rich(nan_to_null(read_newest(spark, path, records.schema, "game_id", "timestamp")))


@query("poll_counters", f"""select count(*) as games, count(*) filter (where state = 'in') as live_games,
 count(*) filter (where state = 'in' and now_down > 0) as plays_sent from ({NOW_SQL}) n""")
def q_poll_counters(spark, sf):
    return feed.poll_counters(*data.feed_documents(spark, sf))


def _key_rows() -> str:
    """(level, key, when a game's documents carry it) for every key of the documents, in whichever list item."""
    drive, now = "has_summary and n_previous > 0", "has_summary and has_current"
    plays = ("id", "text", "period", "type", "start")
    # A drive d has 1 + (k + d) % 3 plays; the key "second" is that of the second one.
    second = " or ".join(f"(n_previous >= {d} and (k + {d}) % 3 >= 1)" for d in (1, 2, 3))
    carried = {
        "event": {k: "true" for k in ("id", "uid", "name", "week", "status", "links", "competitions")}
        | {"weather": "temperature is not null"},
        "competition": {k: "true" for k in ("competitors", "leaders", "venue", "broadcasts", "geoBroadcasts",
                                            "neutralSite")} | {"odds": "has_odds", "tickets": "has_tickets", "situation": "k % 5 = 0"},
        "competition_situation": {"lastPlay": "k % 5 = 0"},
        "status": {"period": "status_period is not null", "displayClock": "display_clock is not null",
                   "type": "true"},
        "status_type": {"state": "true", "detail": "status_period is not null"},
        "competitor": {k: "true" for k in ("homeAway", "team", "records", "leaders", "score", "statistics")},
        "team": {k: "true" for k in ("id", "abbreviation", "displayName")},
        "team_statistics": {"totalYards": "true", "turnovers": "k % 2 = 0"},
        "team_leaders": {"passingYards": "k % 14 <> 7", "rushingYards": "true"},
        "summary": {"situation": "has_situation", "predictor": "has_summary and has_predictor",
                    "winprobability": "has_summary and n_wp > 0", "gameInfo": "has_summary and has_game_info",
                    "drives": "has_summary", "boxscore": "has_summary and k % 3 = 0", "leaders": "has_summary and k % 4 = 0",
                    "scoringPlays": "has_summary and k % 6 = 0"},
        "situation": {"down": "has_situation and down is not null", "distance": "has_situation and distance is not null",
                      "yardLine": "has_situation and yard_line is not null",
                      "possession": "has_situation and possession is not null",
                      "period": "has_situation and situation_period is not null",
                      "isRedZone": "has_situation and red_zone is not null",
                      "lastPlay": "has_situation and has_last_play"},
        "drives": {"previous": "has_summary", "current": now},
        "gameInfo": {k: "has_summary and has_game_info" for k in ("attendance", "weather")},
        "predictor": {k: "has_summary and has_predictor" for k in ("homeTeam", "awayTeam")},
        "drive": {k: drive for k in ("id", "plays")}, "current_drive": {k: now for k in ("id", "plays")},
        "play": {k: drive for k in plays} | {"second": f"has_summary and ({second})"},
        "current_play": {k: now for k in plays} | {"second": f"{now} and (k + 99) % 3 >= 1"},
        "boxscore": {"players": "has_summary and k % 3 = 0"},
        "boxscore_player": {k: "has_summary and k % 3 = 0" for k in ("team", "statistics")},
        "player_statistics": {"passing": "has_summary and k % 3 = 0", "rushing": "has_summary and k % 6 = 0"},
        "leader_group": {k: "has_summary and k % 4 = 0" for k in ("team", "leaders")},
        "summary_leaders": {"receivingYards": "has_summary and k % 4 = 0"},
        "scoring_play": {k: "has_summary and k % 6 = 0" for k in ("id", "text")}}
    return " union all ".join(
        f"select '{level}' as level, '{key}' as key, count(*) filter (where {when}) as documents from games"
        for level, keys in carried.items() for key, when in keys.items())


@query("json_key_profile", f"""with games as (select * from {GAMES})
 select level, key, documents from ({_key_rows()}) t where documents > 0""")
def q_json_key_profile(spark, sf):
    return feed.json_key_profile(*data.feed_documents(spark, sf))
