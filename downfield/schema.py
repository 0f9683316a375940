"""Schemas of the records that enter and leave the engine, as DDL text."""

from pyspark.sql import types as T


def one_line(ddl: str) -> str:
    return " ".join(ddl.split())


def struct_of(ddl: str) -> T.StructType:
    """The type a DDL text stands for; needs a running session."""
    return T.StructType.fromDDL(ddl)


# Field names and types of each record kind. Play ids are widened to
# bigint, so that ids beyond the 32-bit range survive.
PLAY_EVENT = one_line("""
    game_id string, play_id bigint, quarter int, down int, ydstogo int, yardline_100 int,
    posteam string, defteam string, play_type string, shotgun int, no_huddle int,
    offense_formation string, defenders_in_box int, number_of_pass_rushers int,
    was_pressure int, time_to_throw double, epa double, event_time string
""")
LIVE_PLAY = one_line("""
    game_id string, down int, ydstogo int, yardline_100 int, qtr int,
    half_seconds_remaining int, score_differential int, posteam string, defteam string,
    home_team string, away_team string, home_score int, away_score int, goal_to_go int,
    shotgun int, no_huddle int, defenders_in_box int, number_of_pass_rushers int,
    timestamp string, source string, description string, posteam_type string
""")
TRACKING_FRAME = one_line("""
    game_id string, play_id bigint, frame_id int, player_id string, team string,
    position string, x double, y double, speed double, acceleration double,
    direction double, event_time timestamp
""")
# Season-file columns the engine reads. They are all read as text,
# because the files mark missing numbers in several ways ("", "NA", "1.0").
HISTORY_COLUMNS = """
    game_id play_id season week posteam defteam posteam_type posteam_score defteam_score
    down ydstogo yardline_100 qtr half_seconds_remaining score_differential
    posteam_timeouts_remaining defteam_timeouts_remaining goal_to_go shotgun no_huddle
    defenders_in_box number_of_pass_rushers offense_formation offense_personnel play_type
    run_gap run_location route pass_length qb_scramble was_pressure time_to_throw
    ep wp epa td_prob fg_prob safety_prob no_score_prob opp_td_prob opp_fg_prob opp_safety_prob
""".split()


# Feed documents. Only the branches that are read are declared, so the JSON
# reader skips everything else; every leaf may be absent.
_ATHLETE = """struct<id:string, fullName:string, displayName:string, shortName:string,
    headshot:string, jersey:string, active:boolean, position:struct<abbreviation:string>,
    team:struct<id:string>>"""
_LEADERS = f"""array<struct<name:string, leaders:array<struct<displayValue:string,
    value:double, athlete:{_ATHLETE}>>>>"""
_LINE = "struct<line:string, odds:string>"
_PRICE = "struct<open:struct<odds:string>, close:struct<odds:string>>"
_COMPETITOR = f"""struct<homeAway:string, score:string, winner:boolean,
    team:struct<id:string, uid:string, abbreviation:string, name:string, displayName:string,
        shortDisplayName:string, color:string, alternateColor:string, logo:string>,
    records:array<struct<name:string, type:string, summary:string>>, leaders:{_LEADERS}>"""
_ODDS = f"""struct<provider:struct<id:string, name:string>, details:string, spread:double,
    overUnder:double, moneyline:struct<home:{_PRICE}, away:{_PRICE}>,
    pointSpread:struct<home:struct<close:{_LINE}>, away:struct<close:{_LINE}>>,
    total:struct<over:struct<close:{_LINE}>, under:struct<close:{_LINE}>>,
    homeTeamOdds:struct<favorite:boolean>, awayTeamOdds:struct<favorite:boolean>>"""
EVENT_DOC = one_line(f"""
    id string, uid string, name string, shortName string, date string,
    week struct<number:int>, season struct<type:int, year:int>,
    status struct<period:int, displayClock:string, type:struct<state:string, detail:string,
        shortDetail:string, description:string, completed:boolean>>,
    weather struct<temperature:int, displayValue:string, conditionId:string,
        highTemperature:int, gust:int, link:struct<href:string>>,
    links array<struct<rel:array<string>, href:string>>,
    competitions array<struct<neutralSite:boolean, conferenceCompetition:boolean,
        attendance:bigint, competitors:array<{_COMPETITOR}>, leaders:{_LEADERS},
        venue:struct<id:string, fullName:string, name:string, indoor:boolean, grass:boolean,
            capacity:bigint, address:struct<city:string, state:string, country:string>>,
        odds:array<{_ODDS}>, broadcasts:array<struct<names:array<string>>>,
        geoBroadcasts:array<struct<type:struct<shortName:string>, market:struct<type:string>,
            media:struct<shortName:string>, lang:string, region:string>>,
        tickets:array<struct<summary:string, numberAvailable:bigint,
            links:array<struct<href:string>>>>>>
""")
_PLAY = """struct<id:string, text:string, period:struct<number:int>, type:struct<text:string>,
    start:struct<down:int, distance:int, yardsToEndzone:int, team:struct<id:string>>>"""
SUMMARY_DOC = one_line(f"""
    situation struct<down:int, distance:int, yardLine:int, possession:string, period:int,
        isRedZone:boolean, downDistanceText:string, shortDownDistanceText:string,
        possessionText:string, lastPlay:struct<id:string, text:string, type:struct<text:string>,
            scoreValue:int, team:struct<abbreviation:string>,
            athletesInvolved:array<struct<displayName:string>>>>,
    predictor struct<homeTeam:struct<gameProjection:double>,
        awayTeam:struct<gameProjection:double>>,
    winprobability array<struct<playId:string, homeWinPercentage:double, secondsLeft:int>>,
    gameInfo struct<attendance:bigint, weather:struct<displayValue:string, temperature:int>>,
    drives struct<previous:array<struct<id:string, plays:array<{_PLAY}>>>,
        current:struct<id:string, plays:array<{_PLAY}>>>
""")

# The published record of a game, without the predictions, which are made anew on reading.
_LEADER = """struct<name:string, shortName:string, displayName:string, headshot:string, jersey:string, position:string,
    teamId:string, playerId:string, displayValue:string, value:double, active:boolean>"""
_TOP = f"struct<passing:{_LEADER}, rushing:{_LEADER}, receiving:{_LEADER}>"
_TEAM = f"""struct<id:string, uid:string, abbreviation:string, name:string, displayName:string,
    shortDisplayName:string, color:string, alternateColor:string, logo:string, score:int, winner:boolean,
    homeAway:string, records:struct<overall:string, home:string, away:string>, record:string, leaders:{_TOP}>"""
RICH_RECORD = one_line(f"""
    game_id string, event_uid string, timestamp string, source string,
    status struct<state:string, detail:string, shortDetail:string, description:string, period:int,
        displayClock:string, completed:boolean>,
    situation struct<down:int, distance:int, ydstogo:int, yardLine:int, yardline_100:int, possession:string,
        isRedZone:boolean, downDistanceText:string, shortDownDistanceText:string, possessionText:string>,
    down int, ydstogo int, yardline_100 int, qtr int, half_seconds_remaining int, score_differential int,
    posteam string, defteam string, posteam_type string, goal_to_go int, shotgun int, no_huddle int,
    defenders_in_box int, number_of_pass_rushers int, home_team string, home_team_full {_TEAM}, home_score int,
    away_team string, away_team_full {_TEAM}, away_score int, gameLeaders {_TOP},
    weather struct<temperature:int, displayValue:string, conditionId:string, highTemperature:int, gust:int, link:string>,
    venue struct<id:string, name:string, shortName:string, city:string, state:string, country:string,
        indoor:boolean, grass:boolean, capacity:bigint>,
    odds struct<provider:string, providerId:string, details:string, spread:double, overUnder:double,
        moneyline:struct<home:string, away:string, homeOpen:string, awayOpen:string>,
        pointSpread:struct<home:{_LINE}, away:{_LINE}>, total:struct<over:{_LINE}, under:{_LINE}>,
        homeFavorite:boolean, awayFavorite:boolean, homeMoneyLine:string, awayMoneyLine:string>,
    predictor struct<homeWinProbability:double, awayWinProbability:double>,
    winProbabilityHistory array<struct<playId:string, homeWinPercentage:double, secondsLeft:int>>,
    broadcasts array<string>,
    geoBroadcasts array<struct<type:string, market:string, media:string, lang:string, region:string>>,
    tickets struct<summary:string, numberAvailable:bigint, link:string>,
    links struct<gamecast:string, boxscore:string, playbyplay:string>,
    gameInfo struct<attendance:bigint, weatherCondition:string, weatherTemp:int>,
    lastPlay struct<id:string, text:string, type:string, scoreValue:int, team:string, athletesInvolved:array<string>>,
    event struct<name:string, shortName:string, date:string, week:int, seasonType:int, seasonYear:int,
        neutralSite:boolean, conferenceCompetition:boolean, attendance:bigint>
""")
