"""Plays, live plays and game documents derived from the driver's tables.

Each ``*_SQL`` text is accepted by Spark and by the oracle database alike, so
both sides start from the same rows. The feed documents themselves are built
only on the Spark side; the oracle works from the flat ``games`` rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.constants import TEAMS
from downfield.operators.clean import play_event
from downfield.operators.numbering import numbered
from downfield.schema import HISTORY_COLUMNS
from downfield.session import new_dir

PLAYS_SQL = """
select concat(cast(year(o.o_orderdate) as varchar(10)), '_', cast(1 + o.o_orderkey % 18 as varchar(10)), '_', cast(o.o_custkey % 16 as varchar(10))) as game_id,
 cast(l.l_orderkey * 10 + l.l_linenumber as bigint) as play_id,
 cast(year(o.o_orderdate) as int) as season,
 cast(1 + o.o_orderkey % 18 as int) as week,
 cast(case when l.l_partkey % 37 = 0 then null else 1 + l.l_partkey % 4 end as int) as down,
 cast(1 + (l.l_partkey + l.l_suppkey) % 15 as int) as ydstogo,
 cast(1 + (l.l_partkey * 7 + l.l_linenumber) % 99 as int) as yardline_100,
 cast(1 + l.l_suppkey % 4 as int) as qtr,
 cast((l.l_partkey * 13 + l.l_suppkey * 7) % 1801 as int) as half_seconds_remaining,
 cast(l.l_suppkey % 50 as int) as posteam_score,
 cast((l.l_partkey + l.l_orderkey) % 45 as int) as defteam_score,
 cast(l.l_suppkey % 50 as int) - cast((l.l_partkey + l.l_orderkey) % 45 as int) as score_differential,
 concat('T', cast(o.o_custkey % 32 as varchar(10))) as posteam,
 concat('T', cast((o.o_custkey + 1 + l.l_suppkey % 31) % 32 as varchar(10))) as defteam,
 case when o.o_orderkey % 2 = 0 then 'home' else 'away' end as posteam_type,
 case when l.l_returnflag = 'R' then 'run' when l.l_returnflag = 'A' then 'pass' when l.l_partkey % 5 = 0 then 'punt' else 'pass' end as play_type,
 cast(l.l_partkey % 2 as int) as shotgun,
 cast(case when l.l_orderkey % 7 = 0 then 1 else 0 end as int) as no_huddle,
 cast(case when l.l_suppkey % 11 = 0 then null else 3 + l.l_suppkey % 5 end as int) as number_of_pass_rushers,
 cast(case when l.l_partkey % 13 = 0 then null else 4 + l.l_partkey % 6 end as int) as defenders_in_box,
 cast(l.l_suppkey % 4 as int) as posteam_timeouts_remaining,
 cast(l.l_partkey % 4 as int) as defteam_timeouts_remaining,
 cast(case when l.l_partkey % 17 = 0 then null when l.l_suppkey % 9 = 0 then 1 else 0 end as int) as qb_scramble,
 cast(case when l.l_partkey % 19 = 0 then null when l.l_suppkey % 3 = 0 then 1 else 0 end as int) as was_pressure,
 case when l.l_partkey % 3 = 0 then 'middle' when l.l_partkey % 3 = 1 then 'left' else null end as run_location,
 case when l.l_suppkey % 3 = 0 then 'guard' when l.l_suppkey % 3 = 1 then 'end' else null end as run_gap,
 case when l.l_partkey % 8 = 0 then 'SCREEN' when l.l_partkey % 8 = 1 then null else 'GO' end as route,
 case when l.l_suppkey % 6 = 0 then 'deep' when l.l_suppkey % 6 = 1 then null else 'short' end as pass_length,
 case when l.l_partkey % 23 = 0 then null when l.l_partkey % 23 = 1 then '2 RB, 1 FB, 1 TE' else concat(cast(1 + l.l_partkey % 2 as varchar(10)), ' RB, ', cast(1 + l.l_suppkey % 2 as varchar(10)), ' TE, ', cast(3 - l.l_suppkey % 2 as varchar(10)), ' WR') end as offense_personnel,
 l.l_discount * 100 - 5 as epa,
 (100 - (1 + (l.l_partkey * 7 + l.l_linenumber) % 99)) * 6e-2 - 1e0 as ep,
 l.l_partkey as partkey
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

# The remaining season-file columns, by arithmetic on the ones above.
HISTORY_SQL = f"""
select p.*,
 cast(case when yardline_100 <= ydstogo then 1 when partkey % 29 = 0 then null else 0 end as int) as goal_to_go,
 cast(partkey % 101 as double) / 1e2 as wp,
 case when partkey % 6 = 0 then null else cast(partkey % 50 as double) / 1e1 end as time_to_throw,
 case when partkey % 9 = 0 then null when shotgun = 1 then 'SHOTGUN' else 'UNDER_CENTER' end as offense_formation,
 case when partkey % 41 = 0 then null else cast(100 - yardline_100 as double) / 2e2 end as td_prob,
 cast(100 - yardline_100 as double) / 4e2 as fg_prob,
 2e-3 as safety_prob,
 9e-1 - cast(100 - yardline_100 as double) * 9e-3 as no_score_prob,
 cast(yardline_100 as double) / 1e3 as opp_td_prob,
 cast(yardline_100 as double) / 2e3 as opp_fg_prob,
 1e-3 as opp_safety_prob
from ({PLAYS_SQL}) p
"""

# Plays in the live record layout.
LIVE_SQL = f"""
select game_id, play_id, down, ydstogo, yardline_100, qtr, half_seconds_remaining, score_differential,
 posteam, defteam,
 case when posteam_type = 'home' then posteam else defteam end as home_team,
 case when posteam_type = 'home' then defteam else posteam end as away_team,
 case when posteam_type = 'home' then posteam_score else defteam_score end as home_score,
 case when posteam_type = 'home' then defteam_score else posteam_score end as away_score,
 cast(case when yardline_100 <= ydstogo then 1 else 0 end as int) as goal_to_go,
 shotgun, no_huddle, defenders_in_box, number_of_pass_rushers,
 concat('2024-01-', lpad(cast(1 + partkey % 28 as varchar(10)), 2, '0'), 'T', lpad(cast(partkey % 24 as varchar(10)), 2, '0'), ':', lpad(cast(play_id % 60 as varchar(10)), 2, '0'), ':00') as timestamp,
 'fixture' as source,
 concat('play ', cast(play_id as varchar(20))) as description,
 posteam_type
from ({PLAYS_SQL}) p
"""

# Three characters per team code, so both engines can pick one by position.
TEAM_CODES = "".join(code.ljust(3) for code, _, _ in TEAMS)


def _team(index: str) -> str:
    return f"trim(substring('{TEAM_CODES}', cast(1 + 3 * ({index}) as int), 3))"


# One row per game: every leaf of its documents, NULL where a branch is absent.
GAMES_SQL = f"""
select cast(o_orderkey as varchar(20)) as game_id, o_orderkey as k, o_custkey as c,
 case o_orderkey % 5 when 0 then 'pre' when 1 then 'post' else 'in' end as state,
 o_orderkey % 2 = 0 as home_first,
 cast(o_orderkey % 32 as varchar(10)) as home_id,
 cast((o_orderkey + 1 + o_custkey % 31) % 32 as varchar(10)) as away_id,
 {_team("o_orderkey % 32")} as home_abbr,
 {_team("(o_orderkey + 1 + o_custkey % 31) % 32")} as away_abbr,
 case when o_orderkey % 13 = 0 then null else cast(o_custkey % 45 as varchar(10)) end as home_score,
 cast(o_orderkey % 38 as varchar(10)) as away_score,
 case when o_orderkey % 3 = 2 then null else concat(cast(o_custkey % 17 as varchar(10)), '-', cast(o_orderkey % 16 as varchar(10))) end as record_overall,
 case when o_orderkey % 4 = 3 then null else concat(cast(o_custkey % 9 as varchar(10)), '-', cast(o_orderkey % 8 as varchar(10))) end as record_home,
 concat(cast(o_custkey % 7 as varchar(10)), '-', cast(o_orderkey % 9 as varchar(10))) as record_road,
 case when o_orderkey % 7 = 0 then null else concat('Passer ', cast(o_custkey as varchar(20))) end as passer,
 o_orderkey % 4 <> 0 as passer_has_full_name,
 concat(cast(o_custkey % 40 as varchar(10)), '/', cast(40 + o_custkey % 20 as varchar(10)), ', ', cast(o_custkey % 400 as varchar(10)), ' YDS') as passer_line,
 cast(o_custkey % 400 as double) as passer_value,
 case when o_orderkey % 12 = 0 then false when o_orderkey % 12 = 5 then true else null end as passer_active,
 concat('1,', lpad(cast(o_custkey % 1000 as varchar(10)), 3, '0'), ' YDS, ', cast(o_custkey % 12 as varchar(10)), ' TD') as rusher_line,
 o_orderkey % 6 <> 0 as has_summary,
 o_orderkey % 6 <> 0 and o_orderkey % 10 <> 3 as has_situation,
 cast(case when o_orderkey % 11 = 0 then null else (o_orderkey + o_custkey) % 5 end as int) as down,
 cast(case when o_orderkey % 23 = 0 then null else 1 + o_custkey % 15 end as int) as distance,
 cast(case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 0 else o_custkey % 100 end as int) as yard_line,
 case when o_orderkey % 8 = 0 then null when o_custkey % 2 = 0 then {_team("o_orderkey % 32")} else {_team("(o_orderkey + 1 + o_custkey % 31) % 32")} end as possession,
 cast(case when o_orderkey % 29 = 0 then null else 1 + o_orderkey % 5 end as int) as status_period,
 cast(case when o_orderkey % 2 = 0 then null else 3 end as int) as situation_period,
 case when o_orderkey % 31 = 0 then 'Half' when o_orderkey % 37 = 0 then null when o_orderkey % 41 = 0 then '7'
  else concat(cast(o_custkey % 15 as varchar(10)), ':', lpad(cast(o_orderkey % 60 as varchar(10)), 2, '0')) end as display_clock,
 case when o_orderkey % 14 = 0 then null else o_orderkey % 14 = 2 end as red_zone,
 o_orderkey % 9 <> 0 as has_odds,
 cast(o_custkey % 29 - 14 as double) / 2e0 as spread,
 cast(40 + o_custkey % 15 as double) as over_under,
 concat('-', cast(100 + o_custkey % 200 as varchar(10))) as home_ml,
 case when o_orderkey % 4 = 1 then null else concat('+', cast(100 + o_custkey % 150 as varchar(10))) end as away_ml_open,
 case when o_orderkey % 5 = 2 then null else concat('o', cast(40 + o_custkey % 15 as varchar(10))) end as over_line,
 case when o_orderkey % 3 = 0 then null else o_custkey % 2 = 0 end as home_favorite,
 case when o_orderkey % 4 = 0 then null else cast(20 + o_custkey % 80 as int) end as temperature,
 case when o_orderkey % 3 = 0 then null else o_orderkey % 3 = 1 end as indoor,
 case when o_orderkey % 5 = 0 then null else o_orderkey % 5 = 1 end as grass,
 cast(60000 + o_custkey % 20000 as bigint) as capacity,
 cast(o_orderkey % 14 as int) as n_wp,
 cast(o_orderkey % 3 as int) as n_broadcasts,
 cast(o_orderkey % 2 as int) as n_geo,
 o_orderkey % 4 <> 0 as has_boxscore_link,
 o_orderkey % 6 <> 1 as has_tickets,
 o_orderkey % 12 <> 2 as has_ticket_link,
 o_orderkey % 5 <> 4 as has_last_play,
 cast(o_orderkey % 3 as int) as n_athletes,
 o_orderkey % 7 <> 3 as has_game_info,
 o_orderkey % 9 <> 4 as has_predictor,
 cast(o_custkey % 1000 as double) / 1e1 as home_projection,
 cast(o_orderkey % 4 as int) as n_previous,
 o_orderkey % 3 = 1 as has_current
from orders
"""

# One row per (game, drive, play) of the documents: drives 1..n_previous are
# finished, drive 99 is the one under way.
FEED_PLAY_COLUMNS = """
 case when (k + d + i) % 43 = 0 then concat('x', cast(k as varchar(20))) else cast(k * 1000 + d * 10 + i as varchar(20)) end as id,
 cast(1 + k % 4 as int) as period,
 cast(case when (k + i) % 9 = 0 then null else 1 + (k + i) % 4 end as int) as play_down,
 cast(1 + (c + i) % 20 as int) as play_distance,
 cast((c + d + i) % 100 as int) as to_endzone,
 case when (c + i) % 6 = 0 then null when i % 2 = 0 then home_id else away_id end as team_id,
 case when i % 3 = 0 then 'Rush' else 'Pass Reception' end as play_kind,
 concat('play text ', cast(i as varchar(10))) as play_text
"""
TRACKED_PLAYS_SQL = """
select cast(o_custkey % 16 as varchar(10)) as game_id, o_orderkey as play_id,
 o_orderkey as k, o_custkey as c, cast(o_orderkey % 5 as int) as n_frames
from orders
"""
# Positions by arithmetic: player 0 is the passer, 1-4 share the team, 5-9 defend, the last without a position.
TRACKING_SQL_COLUMNS = """
 game_id, play_id, cast(frame as int) as frame_id,
 cast(player as varchar(10)) as player_id,
 case when player < 5 then concat('T', cast(c % 32 as varchar(10))) else concat('T', cast((c + 1) % 32 as varchar(10))) end as team,
 case when player = 0 then 'QB' when player < 5 then 'WR' when player < 9 then 'CB' end as position,
 cast((k * 3 + player * 17 + frame * (1 + player)) % 1200 as double) / 1e1 as x,
 cast((c * 7 + player * 29 + frame * (k % 40) * (2 - c % 4)) % 533 + 533 as double) / 2e1 as y,
 cast(player as double) as speed, cast(frame as double) as acceleration, cast(k % 360 as double) as direction
"""


def view_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql`` with the driver's Parquet tables passed in by name."""
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
              for name in ("lineitem", "orders") if f" {name}" in sql}
    text = sql
    for name in frames:
        text = text.replace(f" {name}", " {" + name + "}")
    return spark.sql(text, **frames)


def _dealt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``view_sql`` over the keys of orders dealt evenly to tasks, one for each staged file: the table may come in a few large
    row groups, while an order becomes long documents or many rows."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = max(1, -(-orders.count() // ROWS_PER_FILE))
    return spark.sql(sql.replace(" orders", " {orders}"), orders=orders.repartition(parts))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_sql(spark, sf_dir, PLAYS_SQL)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_sql(spark, sf_dir, HISTORY_SQL)


def live_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_sql(spark, sf_dir, LIVE_SQL)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_sql(spark, sf_dir, GAMES_SQL)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = (_dealt(spark, sf_dir, TRACKED_PLAYS_SQL).filter("n_frames > 0")
              .withColumn("frame", F.explode(F.sequence(F.lit(1), "n_frames")))
              .withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(9)))))
    return spark.sql(f"""select {TRACKING_SQL_COLUMNS},
        timestamp_millis(1704067200000 + play_id * 10000 + frame * 100) as event_time
        from {{frames}}""", frames=frames)


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking frames at ten per second, up to four per play, as a recorder would have left them."""
    path = staged(spark, sf_dir, "frames", lambda path: _frames(spark, sf_dir).write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


# A play's own time to throw; some have none.
OWN_TIME_SQL = "case when k % 7 = 0 then null else cast(k % 50 as double) / 1e1 end"


def tracked_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play events for the tracked plays, in the event layout."""
    return view_sql(spark, sf_dir, TRACKED_PLAYS_SQL).selectExpr(
        "game_id", "play_id", "cast(1 + k % 4 as int) as quarter", "cast(1 + k % 4 as int) as down",
        "cast(1 + c % 15 as int) as ydstogo", "cast(1 + c % 99 as int) as yardline_100",
        "concat('T', c % 32) as posteam", "concat('T', (c + 1) % 32) as defteam",
        "if(k % 3 = 0, 'run', 'pass') as play_type", "cast(k % 2 as int) as shotgun",
        "cast(0 as int) as no_huddle", "'SHOTGUN' as offense_formation", "cast(4 + c % 6 as int) as defenders_in_box",
        "cast(3 + c % 5 as int) as number_of_pass_rushers", "cast(k % 2 as int) as was_pressure",
        f"{OWN_TIME_SQL} as time_to_throw", "cast(c % 10 as double) as epa",
        "timestamp_millis(1704067200000 + play_id * 10000) as event_time")


TRACKED_EVENT = "game_id string, play_id bigint, event_time timestamp"
TRACKED_PLAY = (f"{TRACKED_EVENT}, quarter int, down int, ydstogo int, yardline_100 int, play_type string, shotgun int, "
                "defenders_in_box int, number_of_pass_rushers int, was_pressure int, time_to_throw double, epa double")
LAST_GAME = "last"


def tracking_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of tracked plays and of their tracking frames as JSON lines: ``now`` holds all, ``end`` one play of a year
    later."""
    def write(path: str) -> None:
        def lines(df: DataFrame, name: str) -> None:
            df.write.options(**PACKED).json(f"{path}/{name}")

        columns = [c.split()[0] for c in TRACKED_PLAY.split(", ")]
        lines(tracked_plays(spark, sf_dir).select(*columns), "plays/now")
        lines(tracking(spark, sf_dir), "frames/now")
        later = F.make_timestamp(F.lit(2100), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        one = spark.range(1).select(F.lit(LAST_GAME).alias("game_id"), F.col("id").alias("play_id"), later.alias("event_time"))
        one.write.json(f"{path}/plays/end")
        one.withColumn("frame_id", F.lit(1)).write.json(f"{path}/frames/end")

    path = staged(spark, sf_dir, "tracked", write)
    return f"{path}/plays", f"{path}/frames"


# Rows per staged file, so that many tasks can read what one task wrote; texts are packed, to a tenth or less.
ROWS_PER_FILE = 20_000
PACKED = {"maxRecordsPerFile": ROWS_PER_FILE, "compression": "gzip"}
PACKED_TABLE = {"maxRecordsPerFile": ROWS_PER_FILE, "compression": "zstd"}
# Folders written so far, by session, source folder and name.
_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A folder below the shared one that ``write`` fills, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = new_dir(spark, name)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def feed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw feed tables: (game_id, event json) and (game_id, summary json), written
    to the shared folder as a feed would have left them there."""
    def write(path: str) -> None:
        rows = _dealt(spark, sf_dir, GAMES_SQL)
        (rows.select("game_id", F.to_json(_event()).alias("event")).write
         .options(**PACKED_TABLE).parquet(f"{path}/events"))
        (rows.filter("has_summary").select("game_id", F.to_json(_summary()).alias("summary"))
         .write.options(**PACKED_TABLE).parquet(f"{path}/summaries"))

    path = staged(spark, sf_dir, "feed", write)
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/summaries")


EVENT_TIME_SQL = ("concat('2024-01-', lpad(cast(1 + partkey % 28 as varchar(10)), 2, '0'), 'T', "
                  "lpad(cast(partkey % 24 as varchar(10)), 2, '0'), ':', "
                  "lpad(cast(play_id % 60 as varchar(10)), 2, '0'), ':00')")


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """Play events as JSON-lines files."""
    return staged(spark, sf_dir, "events", lambda path: (
        play_event(history(spark, sf_dir), F.expr(EVENT_TIME_SQL)).write
        .options(**PACKED).json(path)))


def live_files(spark: SparkSession, sf_dir: str) -> str:
    """Live plays as JSON-lines files."""
    return staged(spark, sf_dir, "live", lambda path: (
        live_plays(spark, sf_dir).drop("play_id").write.options(**PACKED).json(path)))


# Columns that older seasons lack.
LATE_COLUMNS = ["route", "was_pressure", "time_to_throw"]
FIRST_FULL_SEASON = 1998


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(play_id, value): record texts, some of them broken in different ways."""
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    game, k = F.concat(F.lit('{"game_id": '), quote("game_id")), F.col("partkey")
    value = (F.when(k % 17 == 0, "not json").when(k % 19 == 0, "")
             .when(k % 23 == 0, F.concat(game, F.lit(', "down": "third"}')))
             .when(k % 29 == 0, F.concat(game, F.lit(', "down": ')))
             .otherwise(F.concat(game, F.lit(', "down": '), F.coalesce(F.col("down").cast("string"), F.lit("null")),
                                 F.lit(', "extra": [1], "posteam": '), quote("posteam"), F.lit(', "ydstogo": '),
                                 F.col("ydstogo").cast("string"), F.lit("}"))))
    return history(spark, sf_dir).select("play_id", value.alias("value"))


def record_files(spark: SparkSession, sf_dir: str) -> str:
    """Record texts as Parquet files for a file stream."""
    return staged(spark, sf_dir, "records", lambda path: (
        record_texts(spark, sf_dir).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)))


def play_log(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """(position, chunk, play_id, note): a line per order by its key, ``rows`` to a chunk, for ``sources.log``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("play_id"), F.col("o_orderstatus").alias("note"))
    return numbered(orders, "play_id").withColumnRenamed("rank", "position").withColumn("chunk", F.floor(F.col("position") / rows))


def season_files(spark: SparkSession, sf_dir: str) -> str:
    """Season files in two layouts: ``old`` seasons lack some columns and order the
    rest differently from ``new`` ones. ``all`` has one layout throughout."""
    def write(path: str) -> None:
        rows = history(spark, sf_dir).select(*HISTORY_COLUMNS)
        old = [c for c in reversed(HISTORY_COLUMNS) if c not in LATE_COLUMNS]
        csv = lambda df, name: (
            df.write.option("header", True).options(**PACKED).csv(f"{path}/{name}"))
        csv(rows, "all")
        csv(rows.filter(F.col("season") < FIRST_FULL_SEASON).select(*old), "old")
        csv(rows.filter(F.col("season") >= FIRST_FULL_SEASON), "new")

    return staged(spark, sf_dir, "seasons", write)


def _keep(condition, branch: Column) -> Column:
    return F.when(condition, branch)


def _event() -> Column:
    c = F.col
    text = F.concat_ws
    no_record = F.lit(None).cast("struct<name:string,type:string,summary:string>")

    def record(kind: str, name: str, summary: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), summary.alias("summary"))

    overall = (F.when(c("k") % 3 == 0, record("total", "Overall", c("record_overall")))
               .when(c("k") % 3 == 1, record(None, "overall", c("record_overall"))).otherwise(no_record))
    home_rec = F.when(c("record_home").isNotNull(), record("home", "Home", c("record_home")))
    records = F.filter(F.array(overall, home_rec, record("road", "Road", c("record_road"))),
                       lambda r: r.isNotNull())
    passer = F.struct(
        c("passer_line").alias("displayValue"), c("passer_value").alias("value"),
        F.struct(F.concat(F.lit("p"), "c").alias("id"),
                 F.when(c("passer_has_full_name"), c("passer")).alias("fullName"),
                 F.concat("passer", F.lit(" Jr.")).alias("displayName"), c("passer_active").alias("active"),
                 F.struct(F.lit("QB").alias("abbreviation")).alias("position"),
                 F.struct(c("home_id").alias("id")).alias("team")).alias("athlete"))
    rusher = F.struct(
        c("rusher_line").alias("displayValue"), F.lit(None).cast("double").alias("value"),
        F.struct(F.concat(F.lit("r"), "c").alias("id"), F.lit(None).cast("string").alias("fullName"),
                 F.concat(F.lit("Rusher "), "c").alias("displayName"),
                 F.lit(None).cast("boolean").alias("active"),
                 F.struct(F.lit("RB").alias("abbreviation")).alias("position"),
                 F.struct(c("home_id").alias("id")).alias("team")).alias("athlete"))
    no_leaders = F.array().cast("array<string>")

    def category(name: str, leader: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), leader.alias("leaders"))

    passing = category("passingYards", F.when(c("passer").isNotNull(), F.array(passer))
                       .otherwise(F.slice(F.array(passer), 1, 0)))
    leaders = F.filter(F.array(F.when(~c("k").isNull() & (c("k") % 14 != 7), passing),
                               category("rushingYards", F.array(rusher))), lambda x: x.isNotNull())

    def team(side: str) -> Column:
        abbr = c(f"{side}_abbr")
        return F.struct(c(f"{side}_id").alias("id"), abbr.alias("abbreviation"),
                        F.concat(F.lit("The "), abbr).alias("displayName"))

    home = F.struct(F.lit("home").alias("homeAway"), c("home_score").alias("score"),
                    team("home").alias("team"), records.alias("records"), leaders.alias("leaders"))
    away = F.struct(F.lit("away").alias("homeAway"), c("away_score").alias("score"),
                    team("away").alias("team"), F.slice(records, 1, 0).alias("records"),
                    F.slice(leaders, 1, 0).alias("leaders"),
                    F.array(F.struct(F.lit("totalYards").alias("name")),
                            F.struct(F.when(c("k") % 2 == 0, "turnovers").alias("name"))).alias("statistics"))
    # Both sides of a list have one type, in which the home side has no statistics.
    home = home.withField("statistics", F.lit(None).cast("array<struct<name:string>>"))
    price = lambda o, cl: F.struct(F.struct(o.alias("odds")).alias("open"),
                                   F.struct(cl.alias("odds")).alias("close"))
    odds = F.struct(
        F.struct(F.lit("58").alias("id"), F.concat(F.lit("Book "), c("k") % 3).alias("name")).alias("provider"),
        F.concat("home_abbr", F.lit(" "), "spread").alias("details"),
        c("spread").alias("spread"), c("over_under").alias("overUnder"),
        F.struct(price(F.lit("-110"), c("home_ml")).alias("home"),
                 price(c("away_ml_open"), F.lit("+120")).alias("away")).alias("moneyline"),
        F.struct(F.struct(F.struct(c("over_line").alias("line"), F.lit("-105").alias("odds")).alias("close"))
                 .alias("over")).alias("total"),
        F.struct(c("home_favorite").alias("favorite")).alias("homeTeamOdds"))
    numbered = lambda n, f: F.transform(F.slice(F.sequence(F.lit(0), F.lit(13)), F.lit(1), n), f)
    competition = F.struct(
        F.when(c("home_first"), F.array(home, away)).otherwise(F.array(away, home)).alias("competitors"),
        F.slice(leaders, 1, 1).alias("leaders"),
        F.struct(F.concat(F.lit("v"), c("k") % 40).alias("id"), F.concat(F.lit("Field "), c("k") % 40).alias("fullName"),
                 c("indoor").alias("indoor"), c("grass").alias("grass"), c("capacity").alias("capacity"),
                 F.struct(F.concat(F.lit("City "), c("k") % 30).alias("city")).alias("address")).alias("venue"),
        _keep(c("has_odds"), F.array(odds)).alias("odds"),
        numbered(c("n_broadcasts"), lambda i: F.struct(F.array(
            F.concat(F.lit("N"), i), F.concat(F.lit("M"), i)).alias("names"))).alias("broadcasts"),
        numbered(c("n_geo"), lambda i: F.struct(
            F.struct(F.lit("TV").alias("shortName")).alias("type"),
            F.struct(F.concat(F.lit("Net"), i).alias("shortName")).alias("media"),
            F.lit("en").alias("lang"))).alias("geoBroadcasts"),
        _keep(c("has_tickets"), F.array(F.struct(
            F.lit("from $90").alias("summary"), (c("c") % 5000).alias("numberAvailable"),
            _keep(c("has_ticket_link"), F.array(F.struct(F.concat(F.lit("t/"), "game_id").alias("href"))))
            .alias("links")))).alias("tickets"),
        F.lit(False).alias("neutralSite"),
        _keep(c("k") % 5 == 0, F.struct(F.lit("x").alias("lastPlay"))).alias("situation"))
    link = lambda rels, tail: F.struct(F.array(*[F.lit(r) for r in rels]).alias("rel"),
                                       F.concat(F.lit(tail), "game_id").alias("href"))
    links = F.filter(F.array(link(["summary", "desktop"], "g/"), _keep(c("has_boxscore_link"), link(["boxscore"], "b/")),
                             link(["pbp", "desktop"], "p/")), lambda x: x.isNotNull())
    return F.struct(
        c("game_id").alias("id"), F.concat(F.lit("s:20~e:"), "game_id").alias("uid"),
        F.concat("away_abbr", F.lit(" at "), "home_abbr").alias("name"),
        F.struct((1 + c("k") % 18).cast("int").alias("number")).alias("week"),
        F.struct(c("status_period").alias("period"), c("display_clock").alias("displayClock"),
                 F.struct(c("state").alias("state"), F.concat(F.lit("Q"), "status_period").alias("detail"))
                 .alias("type")).alias("status"),
        _keep(c("temperature").isNotNull(), F.struct(
            c("temperature").alias("temperature"), F.lit("Clear").alias("displayValue"),
            F.struct(F.lit("w").alias("href")).alias("link"))).alias("weather"),
        links.alias("links"), F.array(competition).alias("competitions"))


def _summary() -> Column:
    c = F.col
    situation = F.struct(
        c("down"), c("distance"), c("yard_line").alias("yardLine"), c("possession"),
        c("situation_period").alias("period"), c("red_zone").alias("isRedZone"),
        _keep(c("has_last_play"), F.struct(
            F.concat(F.lit("lp"), "k").alias("id"), F.lit("pass complete").alias("text"),
            F.struct(F.lit("Pass").alias("text")).alias("type"),
            F.struct(c("home_abbr").alias("abbreviation")).alias("team"),
            F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), c("n_athletes")),
                        lambda i: F.struct(F.concat(F.lit("Athlete "), i).alias("displayName")))
            .alias("athletesInvolved"))).alias("lastPlay"))
    points = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(13)), F.lit(1), c("n_wp")),
        lambda i: F.struct((c("k") * 100 + i).cast("string").alias("playId"),
                           (((i * 7 + c("c")) % 100).cast("double") / 100).alias("homeWinPercentage"),
                           (3600 - i * 30).alias("secondsLeft")))
    game_info = F.struct((60000 + c("c") % 7000).alias("attendance"),
                         F.struct(F.lit("Cloudy").alias("displayValue"), c("temperature").alias("temperature"))
                         .alias("weather"))
    drives = F.struct(
        F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), c("n_previous")), _drive).alias("previous"),
        _keep(c("has_current"), _drive(F.lit(99))).alias("current"))
    return F.struct(
        _keep(c("has_situation"), situation).alias("situation"),
        _keep(c("has_predictor"), F.struct(
            F.struct(c("home_projection").alias("gameProjection")).alias("homeTeam"),
            F.struct((100 - c("home_projection")).alias("gameProjection")).alias("awayTeam"))).alias("predictor"),
        _keep(c("n_wp") > 0, points).alias("winprobability"),
        _keep(c("has_game_info"), game_info).alias("gameInfo"), drives.alias("drives"),
        _keep(c("k") % 3 == 0, F.struct(F.array(_box(None), _box(F.when(c("k") % 2 == 0, "rushing"))).alias("players")))
        .alias("boxscore"),
        _keep(c("k") % 4 == 0, F.array(F.struct(F.lit("t").alias("team"), F.array(
            F.struct(F.lit("receivingYards").alias("name"))).alias("leaders")))).alias("leaders"),
        # Only the second scoring play has a text.
        _keep(c("k") % 6 == 0, F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct(
            i.alias("id"), F.when(i == 1, "touchdown").alias("text")))).alias("scoringPlays"))


def _box(more: Column | None) -> Column:
    """A team's part of the box score: passing, and what only one of the teams has."""
    more = F.lit(None).cast("string") if more is None else more
    return F.struct(F.lit("t").alias("team"), F.array(F.struct(F.lit("passing").alias("name")),
                                                      F.struct(more.alias("name"))).alias("statistics"))


def _drive(d: Column) -> Column:
    c = F.col
    count = (1 + (c("k") + d) % 3).cast("int")

    def play(i: Column) -> Column:
        text = lambda x: x.cast("string")
        return F.struct(
            F.when((c("k") + d + i) % 43 == 0, F.concat(F.lit("x"), "k"))
            .otherwise(text(c("k") * 1000 + d * 10 + i)).alias("id"),
            F.concat(F.lit("play text "), i).alias("text"),
            F.struct((1 + c("k") % 4).cast("int").alias("number")).alias("period"),
            F.struct(F.when(i % 3 == 0, "Rush").otherwise("Pass Reception").alias("text")).alias("type"),
            F.struct(
                F.when((c("k") + i) % 9 != 0, (1 + (c("k") + i) % 4).cast("int")).alias("down"),
                (1 + (c("c") + i) % 20).cast("int").alias("distance"),
                ((c("c") + d + i) % 100).cast("int").alias("yardsToEndzone"),
                F.when((c("c") + i) % 6 != 0, F.struct(
                    F.when(i % 2 == 0, c("home_id")).otherwise(c("away_id")).alias("id"))).alias("team"))
            .alias("start"), F.when(i == 1, True).alias("second"))  # a key that only the second play of a drive has

    return F.struct(F.concat("game_id", F.lit("-"), d).alias("id"),
                    F.transform(F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), count), play).alias("plays"))
