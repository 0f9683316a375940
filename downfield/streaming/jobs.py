"""Streams of plays: reading, enriching, deduplicating, scoring, writing.

Each running query needs a checkpoint folder of its own. The transformations
are the batch ones, applied to a streaming frame.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from downfield.operators.score import enrich, enriched_output, score_batch
from downfield.operators.tracking import enriched_layout
from downfield.schema import LIVE_PLAY, PLAY_EVENT, struct_of
from downfield.session import dropping_shuffles
from downfield.sources.records import decode_records, good_records, quarantine, to_keyed_json
from downfield.sources.sinks import chunk_json, read_newest, set_times, write_newest


def read_from_files(spark: SparkSession, path: str, schema: str = PLAY_EVENT,
                    max_files: int | None = 1, newest_first: bool = False) -> DataFrame:
    """JSON-lines files as they appear, ``max_files`` per trigger (None: no bound)."""
    reader = spark.readStream.schema(schema).option("latestFirst", newest_first)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _trigger(writer, every: str | None):
    """Poll at an interval, or take what is there and stop."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def write_to_console(df: DataFrame, every: str | None = "3 seconds") -> StreamingQuery:
    writer = df.writeStream.format("console").option("truncate", False).outputMode("append")
    return _trigger(writer, every).start()


def write_to_parquet(df: DataFrame, path: str, checkpoint: str, partition_by: str | None = "game_id",
                     every: str | None = "3 seconds") -> StreamingQuery:
    """Append to Parquet. One folder per game makes many small files; a coarser
    ``partition_by`` suits large inputs better."""
    writer = (df.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return _trigger(writer, every).start()


def enrich_stream(spark: SparkSession, source: str, path: str, checkpoint: str,
                  max_files: int | None = 1, partition_by: str | None = "game_id",
                  every: str | None = "3 seconds") -> StreamingQuery:
    """Files of play events in, enriched plays out."""
    plays = read_from_files(spark, source, max_files=max_files)
    return write_to_parquet(enriched_output(enrich(plays)), path, checkpoint, partition_by, every)


def dedupe(df: DataFrame, keys: Iterable[str] = ("game_id", "play_id"), time: str | None = None,
           delay: str | None = None) -> DataFrame:
    """Let each play pass once.

    With ``time`` and ``delay`` a key is remembered for ``delay`` of event time,
    and a copy that comes later passes. Without them keys are kept for good, so
    the state grows with the number of plays. Rows go to their key's task as they are: one more pass over all of them
    costs more than the rare copies of a feed. For a feed that sends one play very many times at once see ``salted_dedupe``.
    """
    if time and delay:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def salted_dedupe(df: DataFrame, keys: Iterable[str] = ("game_id", "play_id"), time: str = "event_time",
                  delay: str = "1 day", parts: int = 64) -> DataFrame:
    """``dedupe`` in two steps for hot keys: copies are first thinned to one for each of ``parts`` shares of a key's rows,
    by a hash of the whole row and the file it came in, and only those meet in the key's task."""
    share = F.pmod(F.xxhash64(F.input_file_name(), *df.columns), F.lit(parts))
    first = df.withWatermark(time, delay).withColumn("_share", share).dropDuplicatesWithinWatermark([*keys, "_share"])
    return first.drop("_share").dropDuplicatesWithinWatermark(list(keys))


def write_batches(df: DataFrame, path: str, checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """Parquet with the number of the micro-batch that brought each row, as ``batch``; a repeated batch replaces its own
    folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def write_keyed(df: DataFrame, path: str, checkpoint: str, key: str = "game_id",
                every: str | None = "3 seconds") -> StreamingQuery:
    """Keyed JSON records, (key, value) per line, as they come."""
    writer = (to_keyed_json(df, key).writeStream.format("json").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(writer, every).start()


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "game_id",
                every: str | None = "3 seconds") -> StreamingQuery:
    """Keyed JSON records into a log, the counterpart of ``records.read_topic``. Needs the Kafka connector on the class path."""
    writer = (to_keyed_json(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("topic", topic).option("checkpointLocation", checkpoint))
    return _trigger(writer, every).start()


SCORE_KEY, SCORE_ORDER = "game_id", ("timestamp", "description")


def score_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = "3 seconds") -> StreamingQuery:
    """Score each micro-batch and write the newest scored play of every game in it; ``read_scores`` gives the table."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        write_newest(score_batch(batch), batch_id, path, SCORE_KEY, *SCORE_ORDER)
    writer = df.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The newest scored play of every game."""
    scored = score_batch(spark.createDataFrame([], struct_of(LIVE_PLAY))).schema
    return read_newest(spark, path, scored, SCORE_KEY, *SCORE_ORDER)


def decode_stream(texts: DataFrame, path: str, checkpoint: str, schema: str = LIVE_PLAY, every: str | None = "3 seconds") -> StreamingQuery:
    """Decode a stream of record texts (``value``; other columns stay) into two sinks: ``path/good`` has the records,
    ``path/quarantine`` the texts that could not be read. Both are written per micro-batch, as ``batch=<id>``, and
    a repeated batch replaces both."""
    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_records(batch, schema).persist()
        try:
            for name, rows in (("good", good_records(decoded)), ("quarantine", quarantine(decoded))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            decoded.unpersist()
    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def write_replay(events: DataFrame, path: str, rows: int = 100_000, **options: str) -> None:
    """History as JSON files in play order, for ``read_from_files`` on ``path/chunk=*`` to replay in that order. ``options``
    are those of the JSON writer, such as its compression."""
    with dropping_shuffles(events.sparkSession):
        chunk_json(events, path, rows, "game_id", "play_id", **options)
    set_times(events.sparkSession, path)


def join_tracking(plays: DataFrame, frames: DataFrame, delay: str = "1 minute",
                  longest: str = "10 minutes") -> DataFrame:
    """Streamed plays with their streamed tracking frames: a row per play and frame, and one row with NULLs for a play
    without frames, once the watermark tells that none can follow.

    Frames of a play come within ``longest`` of its start, which bounds the
    state on both sides; later ones belong to no play.
    """
    p = plays.withWatermark("event_time", delay).withColumnRenamed("event_time", "play_time").alias("p")
    f = frames.withWatermark("event_time", delay).withColumnRenamed("event_time", "frame_time").alias("f")
    on = F.expr("p.game_id = f.game_id and p.play_id = f.play_id and f.frame_time >= p.play_time "
                f"and f.frame_time <= p.play_time + interval {longest}")
    extra = [c for c in f.columns if c not in ("game_id", "play_id")]
    return p.join(f, on, "left_outer").select("p.*", *[F.col(f"f.{c}") for c in extra])


def enrich_tracked(plays: DataFrame, frames: DataFrame, delay: str = "1 minute", longest: str = "10 minutes") -> DataFrame:
    """One row per streamed play in the documented enriched layout, once the watermark tells that none of its tracking frames
    can follow; append mode.

    Behind the stream-stream join two stateful aggregations follow: per frame the passer and the spots of all other players
    (as many as stand on the field), then per play the smallest distance, the passer's drift and time. Keys hold the play's
    event time, so that the watermark closes them; both aggregations combine before the shuffle.
    """
    wanted = frames.select("game_id", "play_id", "frame_id", "player_id", "team", "position", "x", "y", "event_time")
    joined = join_tracking(plays.select("game_id", "play_id", "event_time", F.struct(
        *[c for c in plays.columns if c not in ("game_id", "play_id", "event_time")]).alias("play")), wanted, delay, longest)
    key = ["game_id", "play_id", "play_time", "play"]
    spot = F.struct("player_id", "team", "x", "y", F.unix_micros("frame_time").alias("at"))
    passer = F.col("position").eqNullSafe("QB")
    by_frame = joined.groupBy(*key, "frame_id").agg(
        F.min(F.when(passer, spot)).alias("qb"),
        F.collect_set(F.when(~passer, F.struct("team", "x", "y"))).alias("others"))
    gaps = F.transform(F.filter("others", lambda o: o["team"] != F.col("qb.team")), lambda o: F.sqrt(
        (o["x"] - F.col("qb.x")) * (o["x"] - F.col("qb.x")) + (o["y"] - F.col("qb.y")) * (o["y"] - F.col("qb.y"))))
    seen = F.when(F.col("qb").isNotNull(), F.struct("frame_id", F.col("qb.y").alias("y")))
    by_play = by_frame.groupBy(*key).agg(
        F.min(F.when(F.col("qb").isNotNull(), F.array_min(gaps))).alias("nearest_defender_dist"),
        F.min(seen).alias("first"), F.max(seen).alias("last"), F.min("qb.at").alias("from"), F.max("qb.at").alias("to"))
    return enriched_layout(by_play.select(
        "game_id", "play_id", "play.*", "nearest_defender_dist", (F.col("last.y") - F.col("first.y")).alias("drift"),
        ((F.col("to") - F.col("from")) / 1_000_000).alias("tracked_time")))
