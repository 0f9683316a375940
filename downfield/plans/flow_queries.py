"""Registered queries that read and write files, run streams, or join tracking data."""

from pyspark.sql import functions as F

from downfield.operators import score, tracking
from downfield.operators.clean import play_event, typed_history
from downfield.operators.features import play_features
from downfield.plans.play_queries import (CHAOS, ENRICHED, EP_BATCH, FEATURES_SQL, FG_BATCH, FROM_LIVE, FROM_PLAYS,
                                          NO_SCORE_BATCH, PASS_BATCH, PLAY_BATCH, RISK_BATCH, STREAM_PLAY,
                                          STREAM_PRESSURE, TD_BATCH)
from downfield.plans.registry import query
from downfield.schema import LIVE_PLAY, PLAY_EVENT, TRACKING_FRAME
from downfield.session import materialise, new_dir
from downfield.sources import history, log, records, sinks
from downfield.sources import testdata as data
from downfield.streaming import counters, jobs

# Micro-batches in which a stream takes in the staged files, so that state, watermark and merges go through several.
BATCHES = 4
CHUNK_ROWS = 20_000


def _per_trigger(spark, path: str) -> int:
    """Files per trigger that make about ``BATCHES`` batches of a folder."""
    folder, fs = sinks.file_system(spark, path)
    files = sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(folder))
    return max(1, -(-files // BATCHES))


def run(started) -> None:
    started.awaitTermination()


# ---------------------------------------------------------------- files

SEASON_COLUMNS = ("game_id, play_id, season, down, offense_formation, offense_personnel, was_pressure, route,"
                  " time_to_throw, ep, epa, td_prob")


@query("scan_csv", f"select {SEASON_COLUMNS} {FROM_PLAYS}")
def q_scan_csv(spark, sf):
    plays = history.scan_csv(spark, data.season_files(spark, sf) + "/all")
    return typed_history(plays).select(*SEASON_COLUMNS.replace(" ", "").split(","))


def _late(column: str) -> str:
    return f"case when season >= {data.FIRST_FULL_SEASON} then {column} end as {column}"


@query("union_seasons", f"""select game_id, play_id, season, down, offense_formation, offense_personnel, ep, epa, td_prob,
 {", ".join(_late(c) for c in data.LATE_COLUMNS)} {FROM_PLAYS}""")
def q_union_seasons(spark, sf):
    path = data.season_files(spark, sf)
    return history.load_seasons(spark, [f"{path}/new", f"{path}/old"]).select(
        *SEASON_COLUMNS.replace(" ", "").split(","))


BAD = "(partkey % 17 = 0 or partkey % 19 = 0 or partkey % 23 = 0 or partkey % 29 = 0)"


@query("decode_records", f"""select play_id, case when {BAD} then null else game_id end as game_id,
 case when {BAD} then null else down end as down, case when {BAD} then null else ydstogo end as ydstogo,
 case when partkey % 17 = 0 then 'not json' when partkey % 19 = 0 then ''
 when partkey % 23 = 0 then '{{"game_id": "' || game_id || '", "down": "third"}}'
 when partkey % 29 = 0 then '{{"game_id": "' || game_id || '", "down": ' end as rejected {FROM_PLAYS}""")
def q_decode_records(spark, sf):
    decoded = records.decode_records(data.record_texts(spark, sf))
    bad = F.col(records.CORRUPT).isNotNull()
    return decoded.select("play_id", *[F.when(~bad, F.col(c)).alias(c) for c in ("game_id", "down", "ydstogo")],
                          F.col(records.CORRUPT).alias("rejected"))


REJECTED = """case when partkey % 17 = 0 then 'not json' when partkey % 19 = 0 then ''
 when partkey % 23 = 0 then '{"game_id": "' || game_id || '", "down": "third"}'
 when partkey % 29 = 0 then '{"game_id": "' || game_id || '", "down": ' end"""


@query("decode_stream", f"""select 'good' as sink, play_id, game_id, down, ydstogo, cast(null as varchar) as value {FROM_PLAYS} where not {BAD}
 union all select 'quarantine', null, null, null, null, {REJECTED} {FROM_PLAYS} where {BAD}""")
def q_decode_stream(spark, sf):
    """A stream of texts into two sinks, in several micro-batches."""
    path, source = new_dir(spark, "decoded"), data.record_files(spark, sf)
    texts = (spark.readStream.schema("play_id bigint, value string")
             .option("maxFilesPerTrigger", _per_trigger(spark, source)).parquet(source))
    run(jobs.decode_stream(texts, path, new_dir(spark, "ckpt"), every=None))
    good, bad = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/quarantine")
    columns = ("play_id", "game_id", "down", "ydstogo")
    return good.select(F.lit("good").alias("sink"), *columns, F.lit(None).cast("string").alias("value")).union(
        bad.select(F.lit("quarantine"), *[F.lit(None).cast(good.schema[c].dataType) for c in columns], "value"))


@query("conform_schema", f"""select play_id, game_id, down, posteam, cast(null as integer) as shotgun,
 cast(null as varchar) as source, 22 as n_columns {FROM_PLAYS} where not {BAD}""")
def q_conform_schema(spark, sf):
    conformed = records.good_records(records.decode_records(data.record_texts(spark, sf), LIVE_PLAY))
    return conformed.select("play_id", "game_id", "down", "posteam", "shotgun", "source",
                            F.lit(len(conformed.columns) - 1).alias("n_columns"))


@query("to_keyed_json", f"""select game_id as key, game_id, play_id, qtr as quarter, coalesce(down, 0) as down, posteam,
 coalesce(offense_formation, '') as offense_formation, coalesce(time_to_throw, 0) as time_to_throw, epa,
 18 as n_keys {FROM_PLAYS}""")
def q_to_keyed_json(spark, sf):
    keyed = records.to_keyed_json(play_event(data.history(spark, sf)))
    event = keyed.select("key", F.size(F.json_object_keys("value")).alias("n_keys"),
                         F.from_json("value", PLAY_EVENT).alias("e"))
    return event.select("key", "n_keys", *[F.col("e")[c].alias(c) for c in (
        "game_id", "play_id", "quarter", "down", "posteam", "offense_formation", "time_to_throw", "epa")])


@query("write_features", FEATURES_SQL)
def q_write_features(spark, sf):
    path = new_dir(spark, "features")
    features = play_features(data.history(spark, sf))
    sinks.write_features(features, path)
    return spark.read.parquet(path).select(*features.columns)


NUMBERED_SQL = f"""select game_id, play_id, (row_number() over (order by game_id, play_id) - 1) // {CHUNK_ROWS} as chunk
 {FROM_PLAYS}"""


@query("chunk_json", f"select * from ({NUMBERED_SQL}) c where chunk < 2")
def q_chunk_json(spark, sf):
    path = new_dir(spark, "chunks")
    sinks.chunk_json(play_event(data.history(spark, sf)), path, CHUNK_ROWS, "game_id", "play_id", n_files=2)
    return spark.read.schema(f"{PLAY_EVENT}, chunk bigint").json(path).select("game_id", "play_id", "chunk")


SCORED = {"expected_points": EP_BATCH, "td_prob": TD_BATCH, "fg_prob": FG_BATCH, "no_score_prob": NO_SCORE_BATCH,
          "pressure_risk": RISK_BATCH, "pass_probability": PASS_BATCH, "run_probability": f"1e0 - ({PASS_BATCH})",
          "predicted_play": PLAY_BATCH}
LIVE_COLUMNS = [f.strip().split(" ")[0] for f in LIVE_PLAY.split(",")]
NEWEST = ", ".join(f"{c} desc nulls last" for c in ["timestamp", "description"] + [
    c for c in LIVE_COLUMNS if c not in ("timestamp", "description")])
NEWEST_SQL = f"""select * from (select *, row_number() over (partition by game_id order by {NEWEST}) as n
 {FROM_LIVE}) r where n = 1"""
SCORED_COLUMNS = ["game_id", "timestamp", "description", "down", "ydstogo", "yardline_100", *SCORED]
SCORED_SQL = f"""select game_id, timestamp, description, down, ydstogo, yardline_100,
 {", ".join(f"{sql} as {c}" for c, sql in SCORED.items())}"""


@query("latest_snapshot", f"{SCORED_SQL} from ({NEWEST_SQL}) s")
def q_latest_snapshot(spark, sf):
    """Three batches, one of them twice."""
    path, plays = new_dir(spark, "snapshot"), data.live_plays(spark, sf).drop("play_id")
    for batch_id, part in ((0, "qtr = 2"), (1, "qtr = 1"), (1, "qtr = 1"), (2, "qtr > 2")):
        sinks.write_newest(score.score_batch(plays.filter(part)), batch_id, path, jobs.SCORE_KEY, *jobs.SCORE_ORDER)
    return jobs.read_scores(spark, path).select(*SCORED_COLUMNS)


@query("read_latest", f"{SCORED_SQL} {FROM_LIVE} where qtr > 2")
def q_read_latest(spark, sf):
    path, plays = new_dir(spark, "latest"), data.live_plays(spark, sf)
    for part in ("qtr <= 2", "qtr > 2"):
        sinks.publish_snapshot(score.score_batch(plays.filter(part)), path)
    return sinks.read_latest(spark, path).select(*SCORED_COLUMNS)


# ---------------------------------------------------------------- streams

@query("stream_json", f"""select game_id, play_id, qtr as quarter, coalesce(down, 0) as down, posteam,
 coalesce(time_to_throw, 0) as time_to_throw, epa, {data.EVENT_TIME_SQL} as event_time {FROM_PLAYS}""")
def q_stream_json(spark, sf):
    path = new_dir(spark, "plain")
    source = data.event_files(spark, sf)
    plays = jobs.read_from_files(spark, source, max_files=_per_trigger(spark, source))
    run(jobs.write_to_parquet(plays, path, new_dir(spark, "ckpt"), partition_by=None, every=None))
    return spark.read.parquet(path).select("game_id", "play_id", "quarter", "down", "posteam", "time_to_throw",
                                           "epa", "event_time")


@query("stream_counters", f"""select count(*) as plays, count(*) filter (where play_type = 'run') as runs,
 count(*) filter (where play_type = 'pass') as passes, count(*) filter (where down > 0) as sent, count(*) as written {FROM_PLAYS}""")
def q_stream_counters(spark, sf):
    """What a listener gathered of a running stream, batch by batch, beside the rows that the stream wrote."""
    path = new_dir(spark, "counted")
    source = data.event_files(spark, sf)
    plays = counters.count_plays(jobs.read_from_files(spark, source, max_files=_per_trigger(spark, source)))
    with counters.listening(spark, counters.PLAYS) as seen:
        stream = jobs.write_to_parquet(plays, path, new_dir(spark, "ckpt"), partition_by=None, every=None)
        run(stream)
        totals = seen.wait(stream)
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(
        *[F.lit(totals[c]).cast("bigint").alias(c) for c in ("plays", "runs", "passes", "sent")], "written")


@query("stream_enrich", ENRICHED)
def q_stream_enrich(spark, sf):
    path = new_dir(spark, "enriched")
    source = data.event_files(spark, sf)
    run(jobs.enrich_stream(spark, source, path, new_dir(spark, "ckpt"),
                           _per_trigger(spark, source), partition_by=None, every=None))
    return spark.read.parquet(path).drop("processed_at")


@query("stream_parquet", f"select *, cast(split_part(game_id, '_', 1) as integer) as season from ({ENRICHED}) e")
def q_stream_parquet(spark, sf):
    """By season rather than by game: games are far too many for a folder each."""
    path = new_dir(spark, "by_season")
    source = data.event_files(spark, sf)
    plays = jobs.read_from_files(spark, source, max_files=_per_trigger(spark, source))
    enriched = score.enriched_output(score.enrich(plays))
    seasons = enriched.withColumn("season", F.split_part("game_id", F.lit("_"), F.lit(1)).cast("int"))
    run(jobs.write_to_parquet(seasons, path, new_dir(spark, "ckpt"), partition_by="season", every=None))
    return spark.read.parquet(path).drop("processed_at")


@query("stream_dedup", f"select distinct game_id, play_id {FROM_PLAYS}")
def q_stream_dedup(spark, sf):
    source = data.event_files(spark, sf)
    plays = jobs.read_from_files(spark, source, max_files=_per_trigger(spark, source))
    timed = plays.withColumn("sent_at", F.to_timestamp("event_time"))
    path = new_dir(spark, "deduped")
    run(jobs.write_to_parquet(jobs.dedupe(timed, time="sent_at", delay="60 days"), path, new_dir(spark, "ckpt"),
                              partition_by=None, every=None))
    return spark.read.parquet(path).select("game_id", "play_id")


@query("stream_score", f"{SCORED_SQL} from ({NEWEST_SQL}) s")
def q_stream_score(spark, sf):
    base = new_dir(spark, "scores")
    source = data.live_files(spark, sf)
    plays = jobs.read_from_files(spark, source, LIVE_PLAY, _per_trigger(spark, source))
    run(jobs.score_stream(plays, base, new_dir(spark, "ckpt"), every=None))
    return jobs.read_scores(spark, base).select(*SCORED_COLUMNS)


@query("replay_plays", f"select game_id, play_id, cast(chunk as integer) as batch from ({NUMBERED_SQL}) c")
def q_replay_plays(spark, sf):
    """Each staged chunk is one micro-batch, in play order."""
    source, path = new_dir(spark, "replay"), new_dir(spark, "replayed")
    jobs.write_replay(play_event(data.history(spark, sf)), source, CHUNK_ROWS, compression="gzip")
    plays = jobs.read_from_files(spark, f"{source}/chunk=*", max_files=1)
    run(jobs.write_batches(plays.select("game_id", "play_id"), path, new_dir(spark, "ckpt"), every=None))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- tracking

TRACKING_SQL = f"""select {data.TRACKING_SQL_COLUMNS} from (select *, unnest(range(0, 10)) as player from (
 select *, unnest(range(1, 1 + n_frames::bigint)) as frame from ({data.TRACKED_PLAYS_SQL}) a) b) c"""
NEAREST_SQL = f"""select game_id, play_id, min(gap) as nearest_defender_dist,
 case when max_by(qb_y, frame_id) - min_by(qb_y, frame_id) > 2 then 'Left'
  when max_by(qb_y, frame_id) - min_by(qb_y, frame_id) < -2 then 'Right' else 'Center' end as qb_pocket_location,
 (max(frame_id) - min(frame_id)) * 1e5 / 1e6 as time_to_throw
 from (select q.game_id, q.play_id, q.frame_id, q.y as qb_y,
  min(sqrt((d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y))) as gap
  from ({TRACKING_SQL}) q join ({TRACKING_SQL}) d on q.game_id = d.game_id and q.play_id = d.play_id
   and q.frame_id = d.frame_id and q.team <> d.team
  where q.position = 'QB' group by all) f group by game_id, play_id"""


@query("nearest_defender", NEAREST_SQL)
def q_nearest_defender(spark, sf):
    return tracking.tracking_summary(data.tracking(spark, sf))


TRACKED_EVENTS_SQL = f"""select *, cast(1 + k % 4 as integer) as quarter, cast(1 + k % 4 as integer) as down,
 cast(1 + c % 15 as integer) as ydstogo, cast(1 + c % 99 as integer) as yardline_100,
 case when k % 3 = 0 then 'run' else 'pass' end as play_type, cast(k % 2 as integer) as shotgun,
 cast(4 + c % 6 as integer) as defenders_in_box, cast(3 + c % 5 as integer) as number_of_pass_rushers,
 cast(k % 2 as integer) as was_pressure, cast(c % 10 as double) as epa, {data.OWN_TIME_SQL} as own_time
 from ({data.TRACKED_PLAYS_SQL}) t"""


@query("enriched_play", f"""select p.game_id, p.play_id, quarter, down, ydstogo, play_type,
 {STREAM_PLAY} as predicted_play_type, {STREAM_PRESSURE} as pressure_rate, coalesce(n.time_to_throw, own_time) as time_to_throw, was_pressure,
 defenders_in_box, n.nearest_defender_dist, n.qb_pocket_location, cast({CHAOS} as double) as chaos_score, epa
 from ({TRACKED_EVENTS_SQL}) p left join ({NEAREST_SQL}) n on p.game_id = n.game_id and p.play_id = n.play_id""")
def q_enriched_play(spark, sf):
    return tracking.enriched_plays(data.tracked_plays(spark, sf), data.tracking(spark, sf)).drop("processed_at")


@query("stream_enriched", f"""select p.game_id, p.play_id, quarter, down, ydstogo, play_type,
 {STREAM_PLAY} as predicted_play_type, {STREAM_PRESSURE} as pressure_rate, coalesce(n.time_to_throw, own_time) as time_to_throw, was_pressure,
 defenders_in_box, n.nearest_defender_dist, n.qb_pocket_location, cast({CHAOS} as double) as chaos_score, epa
 from ({TRACKED_EVENTS_SQL}) p left join ({NEAREST_SQL}) n on p.game_id = n.game_id and p.play_id = n.play_id""")
def q_stream_enriched(spark, sf):
    """One enriched row for each streamed play, equal to the batch result; the watermark closes them in the second run."""
    path, ckpt = new_dir(spark, "enriched_stream"), new_dir(spark, "ckpt")
    plays, frames = data.tracking_files(spark, sf)
    for upto in ("now", "*"):
        enriched = jobs.enrich_tracked(jobs.read_from_files(spark, f"{plays}/{upto}", data.TRACKED_PLAY, None),
                                       jobs.read_from_files(spark, f"{frames}/{upto}", TRACKING_FRAME, None))
        run(jobs.write_to_parquet(enriched, path, ckpt, partition_by=None, every=None))
    return spark.read.parquet(path).filter(F.col("game_id") != data.LAST_GAME).drop("processed_at")


@query("stream_tracking", f"""select p.game_id, p.play_id, f.frame_id, f.x, f.y from ({data.TRACKED_PLAYS_SQL}) p
 left join (select * from ({TRACKING_SQL}) t where position = 'QB') f on p.game_id = f.game_id and p.play_id = f.play_id""")
def q_stream_tracking(spark, sf):
    """Streamed plays joined with the streamed spots of their passers; plays without any come last."""
    path, ckpt = new_dir(spark, "tracked"), new_dir(spark, "ckpt")
    plays, frames = data.tracking_files(spark, sf)
    # The second run continues the first: a far later play moves the watermark beyond all others.
    for upto in ("now", "*"):
        joined = jobs.join_tracking(jobs.read_from_files(spark, f"{plays}/{upto}", data.TRACKED_EVENT, None),
                                    jobs.read_from_files(spark, f"{frames}/{upto}", TRACKING_FRAME, None).filter(
                                        "position = 'QB' or position is null and player_id is null"))
        kept = joined.select("game_id", "play_id", "frame_id", "x", "y")
        run(jobs.write_to_parquet(kept, path, ckpt, partition_by=None, every=None))
    return spark.read.parquet(path).filter(F.col("game_id") != data.LAST_GAME)


LOG_FETCHES, LOG_FILES, LOG_OLD = 10, 12, 7


@query("stream_log", f"""select start, position, o_orderkey as play_id, o_orderstatus as note from (
 select *, row_number() over (order by o_orderkey) - 1 as position, (count(*) over () + {LOG_FILES - 1}) // {LOG_FILES} as rows from orders) o,
 (select unnest(['earliest', 'latest']) as start) s where start = 'earliest' or position >= {LOG_OLD} * rows""")
def q_stream_log(spark, sf):
    """A log read from its oldest line and from now on; both readers stop and go on while it grows."""
    path, n = new_dir(spark, "log"), spark.read.parquet(f"{sf}/orders.parquet").count()
    rows = -(-n // LOG_FILES)
    lines = materialise(data.play_log(spark, sf, rows))

    def grow(first: int, last: int) -> None:
        (lines.filter(F.col("chunk").between(first, last - 1)).repartition("chunk").sortWithinPartitions("chunk", "position")
         .drop("position").write.mode("append").partitionBy("chunk").json(path))

    readers = {start: (new_dir(spark, start), new_dir(spark, "ckpt")) for start in ("earliest", "latest")}

    def start_all() -> list:
        return [jobs.write_batches(log.read_log(spark, path, rows, ckpt, start, -(-n // LOG_FETCHES)), out, ckpt, every="0 seconds")
                for start, (out, ckpt) in readers.items()]

    grow(0, LOG_OLD)
    for first, last in ((LOG_OLD, LOG_OLD + 2), (LOG_OLD + 2, LOG_FILES)):
        running = start_all()
        for q in running:
            q.processAllAvailable()
        grow(first, last)
        for q in running:
            q.processAllAvailable()
            q.stop()
    found = [spark.read.parquet(where[0]).select(F.lit(start).alias("start"), "position", F.from_json(
        "value", "play_id bigint, note string").alias("line")) for start, where in readers.items()]
    return found[0].union(found[1]).select("start", "position", "line.*")
