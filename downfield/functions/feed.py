"""Parts of a game record, cut out of parsed feed documents.

``e`` is a parsed event document, ``s`` a parsed summary document (NULL when
the game has none) and ``comp`` the event's first competition. Missing
branches read as NULL, so every default is stated with ``coalesce``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from downfield.functions.text import clock_seconds

CATEGORIES = ("passing", "rushing", "receiving")


def or_else(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def last_of(items: Column, condition, build=lambda x: x) -> Column:
    """``build`` of the last item that meets the condition, or NULL.

    The item is bound once as a lambda variable, however often ``build`` reads it.
    """
    return last(F.transform(F.filter(items, condition), build))


def head(items: Column, build) -> Column:
    """``build`` of the first item, or NULL."""
    return first(F.transform(F.slice(items, 1, 1), build))


def pick(source: Column, *names: str) -> list[Column]:
    return [source[n].alias(n) for n in names]


def competition(e: Column) -> Column:
    return first(e["competitions"])


def records(entries: Column) -> Column:
    """Win-loss texts by kind; an entry's type decides, or its name without one."""
    def of(*kinds: str) -> Column:
        return last_of(entries, lambda r: F.coalesce(r["type"], r["name"], F.lit("")).isin(*kinds),
                       lambda r: r["summary"])
    return F.struct(of("total", "overall").alias("overall"), of("home").alias("home"),
                    of("road", "away").alias("away"))


def leader(top: Column) -> Column:
    """One leader with the athlete's details."""
    athlete = top["athlete"]
    return F.struct(
        F.coalesce(F.nullif(athlete["fullName"], F.lit("")), athlete["displayName"]).alias("name"),
        *pick(athlete, "shortName", "displayName", "headshot", "jersey"),
        athlete["position"]["abbreviation"].alias("position"), athlete["team"]["id"].alias("teamId"),
        athlete["id"].alias("playerId"), *pick(top, "displayValue", "value"),
        or_else(athlete["active"], True).alias("active"))


def first_tag(tags: tuple[str, ...], has) -> Column:
    """The first tag that ``has`` accepts, or ""."""
    chain = F
    for tag in tags:
        chain = chain.when(has(tag), tag)
    return chain.otherwise("")


def leaders(categories: Column) -> Column:
    """Leaders by passing, rushing and receiving; a name belongs to the first that fits."""
    def of(kind: str) -> Column:
        return last_of(categories, lambda c: first_tag(CATEGORIES, F.lower(c["name"]).contains) == kind,
                       lambda c: head(c["leaders"], leader))
    return F.struct(*[of(kind).alias(kind) for kind in CATEGORIES])


def side(comp: Column, home: bool) -> Column:
    """The home competitor, or the other one."""
    def is_side(c: Column) -> Column:
        at_home = c["homeAway"].eqNullSafe("home")
        return at_home if home else ~at_home
    return last_of(comp["competitors"], is_side)


def score(competitor: Column) -> Column:
    return F.coalesce(competitor["score"].try_cast("int"), F.lit(0))


def team(competitor: Column) -> Column:
    """A team with its score, records and leaders."""
    return F.when(competitor.isNotNull(), F.struct(
        *pick(competitor["team"], "id", "uid", "abbreviation", "name", "displayName", "shortDisplayName",
              "color", "alternateColor", "logo"),
        score(competitor).alias("score"), *pick(competitor, "winner", "homeAway"),
        records(competitor["records"]).alias("records"),
        records(competitor["records"])["overall"].alias("record"),
        leaders(competitor["leaders"]).alias("leaders")))


def has_ball(s: Column, abbr: Column) -> Column:
    return or_else(s["situation"]["possession"], "").eqNullSafe(abbr)


def situation(s: Column, home_ball: Column) -> dict[str, Column]:
    """Flat situation columns, seen from the team with the ball.

    ``home_ball`` says whether that is the home team; team codes and scores are
    read from the columns beside it. The feed counts yards from the home goal,
    and a yard line of 0 means unknown.
    """
    now = s["situation"]
    line, distance = or_else(now["yardLine"], 50), or_else(now["distance"], 0)
    by_side = lambda home, away: F.when(home_ball, home).otherwise(away)
    yards = F.when(line == 0, 75).otherwise(by_side(100 - line, line))
    home, away = F.col("home_score"), F.col("away_score")
    return {
        "down": or_else(now["down"], 0), "ydstogo": distance, "yard_line": line,
        "possession": or_else(now["possession"], ""), "yardline_100": yards,
        "score_differential": by_side(home - away, away - home),
        "posteam": by_side(F.col("home_team"), F.col("away_team")),
        "defteam": by_side(F.col("away_team"), F.col("home_team")),
        "posteam_type": by_side(F.lit("home"), F.lit("away")),
        "goal_to_go": F.when(yards <= distance, 1).otherwise(0)}


def period(e: Column, s: Column) -> Column:
    return F.coalesce(e["status"]["period"], s["situation"]["period"], F.lit(1))


def display_clock(e: Column) -> Column:
    return or_else(e["status"]["displayClock"], "15:00")


def half_seconds(e: Column, s: Column) -> Column:
    return clock_seconds(display_clock(e), period(e, s))


def odds_line(line: Column) -> Column:
    """One provider's lines, with opening and closing prices."""
    price = line["moneyline"]
    home, away = price["home"]["close"]["odds"], price["away"]["close"]["odds"]
    closing = lambda c: F.struct(*pick(c["close"], "line", "odds"))
    return F.struct(
        line["provider"]["name"].alias("provider"), line["provider"]["id"].alias("providerId"),
        *pick(line, "details", "spread", "overUnder"),
        F.struct(home.alias("home"), away.alias("away"), price["home"]["open"]["odds"].alias("homeOpen"),
                 price["away"]["open"]["odds"].alias("awayOpen")).alias("moneyline"),
        F.struct(closing(line["pointSpread"]["home"]).alias("home"),
                 closing(line["pointSpread"]["away"]).alias("away")).alias("pointSpread"),
        F.struct(closing(line["total"]["over"]).alias("over"),
                 closing(line["total"]["under"]).alias("under")).alias("total"),
        or_else(line["homeTeamOdds"]["favorite"], False).alias("homeFavorite"),
        or_else(line["awayTeamOdds"]["favorite"], False).alias("awayFavorite"),
        home.alias("homeMoneyLine"), away.alias("awayMoneyLine"))


def odds(comp: Column) -> Column:
    """The first provider's lines."""
    return head(comp["odds"], odds_line)


def weather(e: Column) -> Column:
    sky = e["weather"]
    return F.struct(*pick(sky, "temperature", "displayValue", "conditionId", "highTemperature", "gust"),
                    sky["link"]["href"].alias("link"))


def venue(comp: Column) -> Column:
    place = comp["venue"]
    return F.struct(place["id"].alias("id"), place["fullName"].alias("name"), place["name"].alias("shortName"),
                    *pick(place["address"], "city", "state", "country"),
                    or_else(place["indoor"], False).alias("indoor"), or_else(place["grass"], True).alias("grass"),
                    place["capacity"].alias("capacity"))


def predictor(s: Column) -> Column:
    odds_of = s["predictor"]
    return F.when(odds_of.isNotNull(), F.struct(
        odds_of["homeTeam"]["gameProjection"].alias("homeWinProbability"),
        odds_of["awayTeam"]["gameProjection"].alias("awayWinProbability")))


def win_history(s: Column, points: int = 10) -> Column:
    """The last ``points`` win-probability points, oldest first."""
    all_points = F.coalesce(s["winprobability"], F.array().cast(
        "array<struct<playId:string,homeWinPercentage:double,secondsLeft:int>>"))
    start = F.greatest(F.size(all_points) - points + 1, F.lit(1))
    return F.slice(all_points, start, F.lit(points))


def broadcasts(comp: Column) -> Column:
    names = F.transform(comp["broadcasts"], lambda b: F.coalesce(b["names"], F.array().cast("array<string>")))
    return F.coalesce(F.flatten(names), F.array().cast("array<string>"))


def geo_broadcasts(comp: Column) -> Column:
    return F.transform(comp["geoBroadcasts"], lambda g: F.struct(
        g["type"]["shortName"].alias("type"), g["market"]["type"].alias("market"),
        g["media"]["shortName"].alias("media"), *pick(g, "lang", "region")))


def game_info(s: Column) -> Column:
    info = s["gameInfo"]
    return F.when(info.isNotNull(), F.struct(
        info["attendance"].alias("attendance"), info["weather"]["displayValue"].alias("weatherCondition"),
        info["weather"]["temperature"].alias("weatherTemp")))


def last_play(s: Column) -> Column:
    play = s["situation"]["lastPlay"]
    names = F.transform(play["athletesInvolved"], lambda a: a["displayName"])
    return F.when(play.isNotNull(), F.struct(
        *pick(play, "id", "text"), play["type"]["text"].alias("type"),
        or_else(play["scoreValue"], 0).alias("scoreValue"), play["team"]["abbreviation"].alias("team"),
        F.coalesce(names, F.array().cast("array<string>")).alias("athletesInvolved")))


def tickets(comp: Column) -> Column:
    return head(comp["tickets"], lambda offer: F.struct(
        *pick(offer, "summary", "numberAvailable"), first(offer["links"])["href"].alias("link")))


# Relation tags of a link, and the names the pages go by.
LINK_TAGS = {"summary": "gamecast", "boxscore": "boxscore", "pbp": "playbyplay"}


def links(e: Column) -> Column:
    """Page addresses by relation tag; a link counts for the first tag it carries."""
    def of(tag: str) -> Column:
        def tagged(link: Column) -> Column:
            return first_tag(tuple(LINK_TAGS), lambda t: F.array_contains(link["rel"], t)) == tag
        return last_of(e["links"], tagged, lambda link: link["href"])
    return F.struct(*[of(tag).alias(name) for tag, name in LINK_TAGS.items()])


def status(e: Column, s: Column) -> Column:
    kind = e["status"]["type"]
    return F.struct(*pick(kind, "state", "detail", "shortDetail", "description"),
                    period(e, s).alias("period"), display_clock(e).alias("displayClock"),
                    or_else(kind["completed"], False).alias("completed"))


def event_info(e: Column, comp: Column) -> Column:
    return F.struct(*pick(e, "name", "shortName", "date"), e["week"]["number"].alias("week"),
                    e["season"]["type"].alias("seasonType"), e["season"]["year"].alias("seasonYear"),
                    or_else(comp["neutralSite"], False).alias("neutralSite"),
                    or_else(comp["conferenceCompetition"], False).alias("conferenceCompetition"),
                    comp["attendance"].alias("attendance"))
