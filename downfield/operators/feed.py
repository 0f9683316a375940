"""From raw feed tables to game records and play events.

Events and summaries are tables of (game_id, JSON text). Each document is
parsed once, against a schema of just the branches in use; everything after
that is struct and array expressions, so a game costs one join and no
explode-and-regroup.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.functions import feed as f
from downfield.operators.clean import play_defaults
from downfield.operators.score import live_predictions
from downfield.schema import EVENT_DOC, RICH_RECORD, SUMMARY_DOC
from downfield.sources.records import decode_records, good_records

# What the feed does not tell about a play.
UNTOLD = {"shotgun": 1, "no_huddle": 0, "defenders_in_box": 6, "number_of_pass_rushers": 4}


def parse_events(events: DataFrame) -> DataFrame:
    """(game_id, e, comp): the parsed event and its first competition."""
    parsed = events.select("game_id", _once(F.from_json("event", EVENT_DOC)).alias("e"))
    return parsed.select("game_id", "e", f.competition(F.col("e")).alias("comp"))


def parse_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.select("game_id", _once(F.from_json("summary", SUMMARY_DOC)).alias("s"))


def _once(document: Column) -> Column:
    """Exploding the one document keeps later filters and projections from parsing the text again."""
    return F.explode(F.array(document))


def live_only(events: DataFrame) -> DataFrame:
    """Raw events of games under way; only the state is read from the text."""
    return events.filter(F.get_json_object("event", "$.status.type.state") == "in")


def game_summary_join(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every game with its summary, if it has one. Both sides are parsed first and the competitors told apart, so
    the shuffle carries only the branches that are read later, also of a competitor, rather than whole documents."""
    games = _sides(parse_events(events)).withColumns({"e": F.col("e").dropFields("competitions"),
                                                      "comp": F.col("comp").dropFields("competitors")})
    return games.join(parse_summaries(summaries), "game_id", "left")


def _sides(games: DataFrame) -> DataFrame:
    return games.withColumns({"home_side": f.side(F.col("comp"), True), "away_side": f.side(F.col("comp"), False)})


def home_away(games: DataFrame) -> DataFrame:
    """Competitors split into home and away teams."""
    if "home_side" not in games.columns:
        games = _sides(games)
    return games.withColumns({"home_team_full": f.team(F.col("home_side")),
                              "away_team_full": f.team(F.col("away_side"))})


def with_situation(games: DataFrame) -> DataFrame:
    """Flat situation columns. Codes and scores come straight from the competitors,
    not from the wide team structs, which keeps the expressions small."""
    e, s = F.col("e"), F.col("s")
    home, away = F.col("home_side"), F.col("away_side")
    named = games.withColumns({
        "home_team": home["team"]["abbreviation"], "away_team": away["team"]["abbreviation"],
        "home_score": f.score(home), "away_score": f.score(away),
        "home_ball": f.has_ball(s, home["team"]["abbreviation"]),
        "_now": F.struct(s["situation"].alias("situation"))})  # what is read further up, so that the rest of s can stay below
    now = F.col("_now")
    return named.withColumns({**f.situation(now, F.col("home_ball")), "qtr": f.period(e, now),
                              "half_seconds_remaining": f.half_seconds(e, now)}).drop("_now")


def flatten_feed(events: DataFrame, summaries: DataFrame, source: str = "live_feed") -> DataFrame:
    """One full record per game: identifiers, flat situation, teams and all side branches."""
    games = with_situation(home_away(game_summary_join(events, summaries)))
    e, comp, s, c = F.col("e"), F.col("comp"), F.col("s"), F.col
    situation = F.struct(
        c("down"), c("ydstogo").alias("distance"), c("ydstogo"), c("yard_line").alias("yardLine"),
        c("yardline_100"), c("possession"), f.or_else(s["situation"]["isRedZone"], False).alias("isRedZone"),
        *f.pick(s["situation"], "downDistanceText", "shortDownDistanceText", "possessionText"))
    return games.select(
        "game_id", e["uid"].alias("event_uid"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(source).alias("source"), f.status(e, s).alias("status"), situation.alias("situation"),
        "down", "ydstogo", "yardline_100", "qtr", "half_seconds_remaining", "score_differential",
        "posteam", "defteam", "posteam_type", "goal_to_go",
        *[F.lit(v).alias(k) for k, v in UNTOLD.items()],
        "home_team", "home_team_full", "home_score", "away_team", "away_team_full", "away_score",
        f.leaders(comp["leaders"]).alias("gameLeaders"), f.weather(e).alias("weather"),
        f.venue(comp).alias("venue"), f.odds(comp).alias("odds"), f.predictor(s).alias("predictor"),
        f.win_history(s).alias("winProbabilityHistory"), f.broadcasts(comp).alias("broadcasts"),
        f.geo_broadcasts(comp).alias("geoBroadcasts"), f.tickets(comp).alias("tickets"),
        f.links(e).alias("links"), f.game_info(s).alias("gameInfo"), f.last_play(s).alias("lastPlay"),
        f.event_info(e, comp).alias("event"))


def playable(records: DataFrame) -> DataFrame:
    """Records with a play to score."""
    return records.filter(F.col("down") > 0)


def rich_record(records: DataFrame) -> DataFrame:
    """Records with their predictions, nested and flat."""
    scored = play_defaults(records).withColumns(live_predictions())
    names = list(live_predictions())
    return scored.withColumn("ml_predictions", F.struct(*names))


def live_records(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """Scored records of the games under way, from the raw feed tables.

    The games under way are few, the archive of summaries grows: it is cut to their ids before any of it is parsed.
    """
    live = live_only(events)
    wanted = summaries.join(live.select("game_id").distinct(), "game_id", "left_semi")
    return rich_record(playable(flatten_feed(live, wanted)))


def decoded_records(values: DataFrame) -> DataFrame:
    """Published records back from their JSON text, those that cannot be read left out, scored anew."""
    return rich_record(playable(good_records(decode_records(values, RICH_RECORD))))


def explode_plays(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per play of the finished drives and the one under way."""
    s = F.col("s")
    drives = F.concat(F.coalesce(s["drives"]["previous"], F.slice(F.array(s["drives"]["current"]), 1, 0)),
                      F.when(s["drives"]["current"].isNotNull(), F.array(s["drives"]["current"]))
                      .otherwise(F.slice(F.array(s["drives"]["current"]), 1, 0)))
    games = _sides(parse_events(events)).select(
        "game_id", F.col("home_side")["team"].alias("home"), F.col("away_side")["team"].alias("away"))
    plays = (parse_summaries(summaries).select("game_id", F.explode(drives).alias("drive"))
             .select("game_id", F.col("drive")["id"].alias("drive_id"), F.explode("drive.plays").alias("play")))
    return games.select(
        "game_id", *[F.col(side)[name].alias(f"{side}_{name}") for side in ("home", "away")
                     for name in ("id", "abbreviation")]).join(plays, "game_id")


def parse_feed_play(plays: DataFrame, event_time: Column | None = None) -> DataFrame:
    """Exploded feed plays in the event layout.

    The feed names the offense by team id; it is looked up among the game's two
    teams, and the defense is the other one. Ids that are no number give NULL.
    """
    play, start = F.col("play"), F.col("play")["start"]
    ball = start["team"]["id"]
    of_ball = lambda home, away: (F.when(ball == F.col("home_id"), F.col(home))
                                  .when(ball == F.col("away_id"), F.col(away)).otherwise(""))
    if event_time is None:
        event_time = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return plays.select(
        "game_id", play["id"].try_cast("bigint").alias("play_id"),
        f.or_else(play["period"]["number"], 0).alias("quarter"), f.or_else(start["down"], 0).alias("down"),
        f.or_else(start["distance"], 0).alias("ydstogo"), f.or_else(start["yardsToEndzone"], 0).alias("yardline_100"),
        of_ball("home_abbreviation", "away_abbreviation").alias("posteam"),
        of_ball("away_abbreviation", "home_abbreviation").alias("defteam"),
        f.or_else(play["type"]["text"], "").alias("play_type"), F.lit(0).alias("shotgun"),
        F.lit(0).alias("no_huddle"), F.lit("").alias("offense_formation"), F.lit(0).alias("defenders_in_box"),
        F.lit(0).alias("number_of_pass_rushers"), F.lit(0).alias("was_pressure"),
        F.lit(0.0).alias("time_to_throw"), F.lit(0.0).alias("epa"),
        F.col("home_abbreviation").alias("home_team"), F.col("away_abbreviation").alias("away_team"),
        f.or_else(play["text"], "").alias("description"), f.or_else(ball, "").alias("posteam_id"),
        event_time.alias("event_time"))


def poll_counters(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """Games polled, games under way, and records that can be sent. Only summaries of games under way are read."""
    state = events.select("game_id", (F.get_json_object("event", "$.status.type.state") == "in").alias("live"))
    none = F.lit(0).cast("bigint")
    polled = state.select(F.lit(1).cast("bigint").alias("games"), F.coalesce("live", F.lit(False)).cast("bigint").alias("live_games"),
                          none.alias("plays_sent"))
    down = f.or_else(F.get_json_object("summary", "$.situation.down").try_cast("int"), 0)
    sent = state.filter("live").join(summaries, "game_id").select(
        none.alias("games"), none.alias("live_games"), (down > 0).cast("bigint").alias("plays_sent"))
    return polled.unionByName(sent).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("games", "live_games", "plays_sent")])


# Levels of the feed documents: (name, level above, key there, how its text holds the documents). Two of them are told
# apart by a name inside: a statistic or a leader category counts as one key, its name.
_ONE, _LIST, _NAMES = "one", "list", "names"
EVENT_LEVELS = (
    ("competition", "event", "competitions", _LIST), ("status", "event", "status", _ONE), ("status_type", "status", "type", _ONE),
    ("competition_situation", "competition", "situation", _ONE), ("competitor", "competition", "competitors", _LIST),
    ("team", "competitor", "team", _ONE), ("team_statistics", "competitor", "statistics", _NAMES),
    ("team_leaders", "competitor", "leaders", _NAMES))
SUMMARY_LEVELS = (
    ("situation", "summary", "situation", _ONE), ("drives", "summary", "drives", _ONE), ("gameInfo", "summary", "gameInfo", _ONE),
    ("predictor", "summary", "predictor", _ONE), ("boxscore", "summary", "boxscore", _ONE), ("drive", "drives", "previous", _LIST),
    ("current_drive", "drives", "current", _ONE), ("play", "drive", "plays", _LIST), ("current_play", "current_drive", "plays", _LIST),
    ("boxscore_player", "boxscore", "players", _LIST), ("player_statistics", "boxscore_player", "statistics", _NAMES),
    ("leader_group", "summary", "leaders", _LIST), ("summary_leaders", "leader_group", "leaders", _NAMES),
    ("scoring_play", "summary", "scoringPlays", _LIST))


def json_key_profile(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """How many documents carry each key, level by level, whichever item of a list carries it.

    A level is an array of maps of raw sub-texts, one for each item of all lists above it, so a fragment is read only as deep
    as the next level needs. The distinct keys of a document's level are found in its own row; counts combine before
    the shuffle.
    """
    def items(text: Column, kind: str) -> Column:
        one = F.from_json(text, "map<string,string>")
        if kind == _ONE:
            return F.when(one.isNotNull(), F.array(one))
        return F.transform(F.from_json(text, "array<string>"), lambda x: F.from_json(x, "map<string,string>"))

    def keys(level: Column, kind: str) -> Column:
        if kind == _NAMES:
            found = F.transform(level, lambda m: m["name"])
        else:
            found = F.flatten(F.transform(level, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))
        return F.array_distinct(F.filter(found, lambda k: k.isNotNull()))

    def counted(texts: DataFrame, column: str, levels) -> DataFrame:
        df = texts.select(_once(items(F.col(column), _ONE)).alias(column))
        kinds = {column: _ONE}
        for name, above, key, kind in levels:
            df = df.withColumn(name, _below(F.col(above), key, kind, items))
            kinds[name] = kind
        pairs = F.array(*[F.struct(F.lit(name).alias("level"), keys(F.col(name), kind).alias("keys")) for name, kind in kinds.items()])
        return (df.select(F.inline(pairs)).select("level", F.explode("keys").alias("key"))
                .groupBy("level", "key").agg(F.count("*").alias("documents")))

    return counted(events, "event", EVENT_LEVELS).unionByName(counted(summaries, "summary", SUMMARY_LEVELS))


def _below(above: Column, key: str, kind: str, items) -> Column:
    """The items that ``key`` holds in each map of a level, as one array without NULLs."""
    none = F.array().cast("array<map<string,string>>")
    each = F.transform(F.coalesce(above, none), lambda m: F.coalesce(items(m[key], kind), none))
    return F.filter(F.flatten(each), lambda m: m.isNotNull())
