"""Files, streams, snapshots and the whole batch job."""

import glob
import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from downfield.operators import summary, tracking
from downfield.operators.clean import play_event
from downfield.operators.features import play_features
from downfield.operators.score import enrich, enriched_output
from downfield.plans.jobs import build_features
from downfield.schema import LIVE_PLAY, PLAY_EVENT, TRACKING_FRAME
from downfield.session import materialise
from downfield.sources import history, log, records, sinks
from downfield.sources import testdata as data
from downfield.streaming import counters, jobs


def rows(df):
    return sorted(map(str, df.collect()))


def lines(path):
    out = []
    for name in sorted(glob.glob(f"{path}/part-*.json")):
        with open(name) as f:
            out.append([json.loads(line) for line in f])
    return out


def test_stream_equals_batch(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    events = play_event(data.history(spark, sf).limit(300), F.lit("2024-01-01T00:00:00"))
    events.repartition(3).write.json(source)
    jobs.enrich_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"), every=None).awaitTermination()
    batch = enriched_output(enrich(spark.read.schema(PLAY_EVENT).json(source))).drop("processed_at")
    out = spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).select(*batch.columns)
    assert rows(out) == rows(batch)
    assert glob.glob(str(tmp_path / "out" / "game_id=*"))


def send(spark, path, name, records_):
    df = spark.createDataFrame(records_, "game_id string, play_id bigint, sent_at timestamp")
    df.write.json(f"{path}/{name}")


@pytest.mark.parametrize("delay,expected", [("2 hours", 3), (None, 2)])
def test_dedupe_across_batches(spark, tmp_path, delay, expected):
    """A copy within the delay is dropped; one far later passes only if keys expire."""
    from datetime import datetime as d
    source, schema = str(tmp_path / "in"), "game_id string, play_id bigint, sent_at timestamp"
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    early = [("g", 1, d(2024, 1, 1, 0)), ("g", 1, d(2024, 1, 1, 0)), ("g", 2, d(2024, 1, 1, 0))]
    for i, batch in enumerate([early, [("g", 2, d(2024, 1, 1, 1))], [("g", 2, d(2024, 1, 3, 0))],
                               [("g", 2, d(2024, 1, 3, 1))]]):
        send(spark, source, f"b{i}", batch)
        plays = jobs.read_from_files(spark, f"{source}/*", schema, max_files=None)
        kept = jobs.dedupe(plays, time="sent_at" if delay else None, delay=delay)
        jobs.write_to_parquet(kept, out, ck, partition_by=None, every=None).awaitTermination()
    assert spark.read.schema(schema).parquet(out).count() == expected


def test_salted_dedupe_keeps_one_of_each(spark, tmp_path):
    from datetime import datetime as d
    source, schema = str(tmp_path / "in"), "game_id string, play_id bigint, sent_at timestamp"
    send(spark, source, "b", [("g", 1, d(2024, 1, 1, 0))] * 500 + [("g", i, d(2024, 1, 1, i % 5)) for i in range(9)])
    plays = jobs.read_from_files(spark, f"{source}/*", schema, max_files=None)
    kept = jobs.salted_dedupe(plays, time="sent_at", delay="2 days", parts=4)
    jobs.write_to_parquet(kept, str(tmp_path / "o"), str(tmp_path / "c"), partition_by=None, every=None).awaitTermination()
    assert sorted(r.play_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(9))


def frame(spark, *r):
    return spark.createDataFrame(list(r), "game_id string, timestamp string, down int")


def newest(spark, path):
    return rows(sinks.read_newest(spark, path, frame(spark).schema, "game_id", "timestamp"))


def test_newest_play_survives_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "scores")
    sinks.write_newest(frame(spark, ("a", "1", 1), ("b", "5", 2), ("a", "0", 7)), 0, path, "game_id", "timestamp")
    for part in (("a", "2", 9), ("a", "3", 3)):  # the second write stands for the batch done again
        sinks.write_newest(frame(spark, part, ("b", "4", 4)), 1, path, "game_id", "timestamp")
    assert sorted(d for d in os.listdir(path)) == ["batch=0", "batch=1"]
    assert spark.read.parquet(f"{path}/batch=0").count() == 2  # a row per game
    assert newest(spark, path) == rows(frame(spark, ("a", "3", 3), ("b", "5", 2)))
    sinks.write_newest(frame(spark), 2, path, "game_id", "timestamp")
    assert newest(spark, path) == rows(frame(spark, ("a", "3", 3), ("b", "5", 2)))


def test_snapshots_are_overwritten(spark, tmp_path):
    path = str(tmp_path / "latest")
    for version in range(4):
        sinks.publish_snapshot(spark.range(version), path)
    assert sinks.read_latest(spark, path).count() == 3


def test_both_sinks_are_replaced_when_a_batch_is_repeated(spark, tmp_path):
    """The commit of the last batch is taken back, so that the next run does it again."""
    source, path, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    good, bad = '{"game_id": "g", "down": 1}', "no json"
    for turn in range(3):
        if turn < 2:
            spark.createDataFrame([(turn, good), (turn, bad), (turn, None)], "play_id bigint, value string").coalesce(1).write.mode(
                "append").parquet(source)
        texts = spark.readStream.schema("play_id bigint, value string").parquet(source)
        jobs.decode_stream(texts, path, ckpt, every=None).awaitTermination()
        assert spark.read.parquet(f"{path}/good").count() == min(turn + 1, 2)
        assert sorted(r.value for r in spark.read.parquet(f"{path}/quarantine").collect()) == sorted([bad, ""] * min(turn + 1, 2))
        if turn == 1:
            for name in glob.glob(f"{ckpt}/commits/*1*") + glob.glob(f"{ckpt}/commits/.1*"):
                os.remove(name)


def logged(path, first, n, rows_per_file=5):
    for i in range(first, first + n):
        folder = f"{path}/chunk={i // rows_per_file}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/part-0.json", "a") as f:
            f.write(f"line {i}\n")


def test_log_from_both_ends_goes_on_without_loss(spark, tmp_path):
    path = str(tmp_path / "log")
    logged(path, 0, 13)

    def turn(start):
        ckpt = str(tmp_path / f"{start}-ckpt")
        return jobs.write_batches(log.read_log(spark, path, 5, ckpt, start, per_fetch=4), str(tmp_path / start), ckpt, every="0 seconds")

    def seen(start):
        got = spark.read.schema("position bigint, value string, batch int").parquet(str(tmp_path / start)).collect()
        assert all(r.value == f"line {r.position}" for r in got)
        return sorted(r.position for r in got), got

    quiet = turn("latest")  # starts and ends without a line
    quiet.processAllAvailable()
    quiet.stop()
    for first, n in ((13, 9), (22, 6)):
        running = [turn("earliest"), turn("latest")]
        running[0].processAllAvailable()
        logged(path, first, n)
        for q in running:
            q.processAllAvailable()
            q.stop()
    positions, got = seen("earliest")
    assert positions == list(range(28))
    assert seen("latest")[0] == list(range(13, 28))
    assert max(sum(r.batch == b for r in got) for b in {r.batch for r in got}) == 4


def test_log_leaves_files_that_are_being_written(tmp_path):
    path = str(tmp_path / "log")
    logged(path, 0, 5)
    logged(f"{path}/_temporary/0/_temporary/attempt_1_m_000001_2", 5, 2)
    reader = log.LogReader({"path": path, "rows": "5", "checkpoint": str(tmp_path / "ckpt"), "start": "earliest"})
    assert reader._end() == 5
    logged(path, 5, 5)
    assert reader._end() == 10 and all("_temporary" not in f for f in reader._files())


def test_log_start_must_be_known():
    with pytest.raises(ValueError):
        log.LogReader({"path": "x", "rows": "5", "checkpoint": "c", "start": "middle"})


@pytest.mark.parametrize("n_files", [5, None])
def test_chunks_hold_the_first_plays_in_order(spark, sf, tmp_path, n_files):
    path = str(tmp_path / "chunks")
    events = play_event(data.history(spark, sf)).select("game_id", "play_id")
    sinks.chunk_json(events, path, 700, "game_id", "play_id", n_files=n_files)
    files = [lines(f"{path}/chunk={i}") for i in range(len(glob.glob(f"{path}/chunk=*")))]
    want = [(r.game_id, r.play_id) for r in events.orderBy("game_id", "play_id").collect()]
    assert all(len(f) == 1 for f in files) and len(files) == (n_files or 9)
    got = [(r["game_id"], r["play_id"]) for f in files for r in f[0]]
    assert got == want[:len(got)] and len(got) == min(len(want), 700 * len(files))


def test_replay_files_come_in_play_order(spark, sf, tmp_path):
    path = str(tmp_path / "replay")
    jobs.write_replay(play_event(data.history(spark, sf)), path, rows=500)
    names = glob.glob(f"{path}/chunk=*/part-*.json")
    by_time = sorted(names, key=os.path.getmtime)
    assert [int(n.split("chunk=")[1].split("/")[0]) for n in by_time] == list(range(12))


def test_numbering_splits_rows_that_are_all_alike(spark):
    from downfield.operators.numbering import dealt, numbered
    df = materialise(spark.range(20_000).selectExpr("if(id % 10 = 0, id, 7) as key").repartition(4))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows share a part
    try:
        assert dealt(df, [F.col("key")]).groupBy("part").count().agg(F.max("count")).first()[0] < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    ranks = sorted((r.rank, r.key) for r in numbered(df, "key").collect())
    assert [r for r, _ in ranks] == list(range(20_000)) and [k for _, k in ranks] == sorted(k for _, k in ranks)


def test_csv_marks_and_layouts(spark, tmp_path):
    old, new = str(tmp_path / "old.csv"), str(tmp_path / "new.csv")
    with open(old, "w") as f:
        f.write("season,play_id,game_id,down,epa\n2016.0,1,g,1.0,NA\n2016,2,g,,-0.5\n")
    with open(new, "w") as f:
        f.write("game_id,play_id,season,was_pressure,unused,down\nh,3,2023,1.0,x,NA\n")
    got = history.load_seasons(spark, [old, new]).orderBy("play_id").select(
        "game_id", "play_id", "season", "down", "epa", "was_pressure").collect()
    assert [tuple(r) for r in got] == [("g", 1, 2016, 1, None, None), ("g", 2, 2016, None, -0.5, None),
                                       ("h", 3, 2023, None, None, 1)]


def test_scan_refuses_another_layout(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        history.scan_csv(spark, path, ["a", "b"]).collect()


def test_decode_routes_bad_records(spark):
    values = ['{"game_id": "a", "down": 1, "more": 2}', "{", '{"down": "x"}', "", None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    decoded = records.decode_records(df, LIVE_PLAY).cache()
    assert [(r.game_id, r.down) for r in records.good_records(decoded).collect()] == [("a", 1)]
    assert records.quarantine(decoded).count() == 4


def test_decoding_parses_once(spark):
    df = spark.createDataFrame([("{}",)], "value string")
    good = records.good_records(records.decode_records(df))
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_large_play_ids_are_kept(spark):
    big = 2**60 + 1
    assert play_event(spark.createDataFrame([(big,)], "play_id bigint")).first().play_id == big


def test_keyed_json_has_a_key_for_every_row(spark):
    df = spark.createDataFrame([("g", None), (None, 1)], "game_id string, down int")
    assert rows(records.to_keyed_json(df)) == rows(spark.createDataFrame(
        [("g", '{"game_id":"g","down":null}'), ("default", '{"game_id":null,"down":1}')], "key string, value string"))


def test_batch_job(spark, sf, tmp_path):
    files = data.season_files(spark, sf)
    out = str(tmp_path / "features")
    counts, seasons, teams = build_features(spark, [f"{files}/new", f"{files}/old"], out)
    features = play_features(data.history(spark, sf))
    assert counts == {"loaded": 6000, "run_or_pass": counts["run_or_pass"], "features": features.count()}
    assert rows(seasons) == rows(summary.season_stats(features))
    assert rows(teams) == rows(summary.team_rankings(features))
    before = rows(seasons)
    _, after, _ = build_features(spark, [f"{files}/new"], out, replace=False)  # replaces only the newer seasons
    assert rows(after) == before
    counts, after, _ = build_features(spark, [f"{files}/new"], out)
    assert sum(r.plays for r in after.collect()) == counts["features"] < features.count()


def test_large_play_ids_survive_the_text_path(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("game_id,play_id,season\ng,1152921504606846977,2023\ng,7.0,2023\n")
    assert {r.play_id for r in history.load_seasons(spark, [path]).collect()} == {1152921504606846977, 7}


def test_keyed_records_are_written(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("g", 1), (None, 2)], "game_id string, play_id bigint").write.json(source)
    plays = jobs.read_from_files(spark, source, "game_id string, play_id bigint")
    jobs.write_keyed(plays, str(tmp_path / "out"), str(tmp_path / "c"), every=None).awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.key for r in got.collect()) == ["default", "g"]
    assert sorted(json.loads(r.value)["play_id"] for r in got.collect()) == [1, 2]


def test_interval_trigger_and_console(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    play_event(data.history(spark, sf).limit(5), F.lit("2024-01-01T00:00:00")).write.json(source)
    plays = enrich(jobs.read_from_files(spark, source))
    queries = [jobs.write_to_console(plays, every="1 second"),
               jobs.write_to_parquet(plays, str(tmp_path / "out"), str(tmp_path / "c"), None, every="1 second")]
    for q in queries:
        q.processAllAvailable()
        assert q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) == 5
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).filter("processed_at is not null").count() == 5


def test_defenders_without_a_position_count(spark):
    frames = spark.createDataFrame(
        [("g", 1, 1, "q", "A", "QB", 0.0, 0.0), ("g", 1, 1, "d", "B", None, 1.0, 0.0), ("g", 1, 1, "e", "B", "CB", 9.0, 0.0),
         ("g", 1, 1, "e", "B", "CB", 9.0, 0.0), ("g", 2, 1, "d", "B", "CB", 1.0, 0.0)],
        "game_id string, play_id bigint, frame_id int, player_id string, team string, position string, x double, y double",
    ).withColumn("event_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    got = tracking.tracking_summary(frames).collect()
    assert [(r.play_id, r.nearest_defender_dist, r.time_to_throw) for r in got] == [(1, 1.0, 0.0)]


def test_frames_are_dealt_once(spark):
    """Repeated spots and frames without keys among them; of the raw frames there is one exchange."""
    frames = spark.createDataFrame(
        [("g", 1, 1, "q", "A", "QB", 0.0, 0.0), ("g", 1, 1, "p", "A", "QB", 3.0, 0.0), ("g", 1, 1, "d", "B", "CB", 4.0, 0.0)] * 3
        + [(None, None, 1, "q", "A", "QB", 0.0, 1.0), (None, None, 1, "d", "B", None, 0.0, 3.0), ("g", 2, 1, "q", "A", "QB", 0.0, 0.0)],
        "game_id string, play_id bigint, frame_id int, player_id string, team string, position string, x double, y double",
    ).withColumn("event_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    found = tracking.nearest_by_frame(frames)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.game_id, r.play_id, r.qb_y, r.distance) for r in found.collect()} == {
        ("g", 1, 0.0, 1.0), (None, None, 1.0, 2.0), ("g", 2, 0.0, None)}


def test_enriched_plays_of_the_event_layout(spark, sf):
    events = play_event(data.history(spark, sf).limit(20))
    got = tracking.enriched_plays(events, data.tracking(spark, sf))
    assert got.count() == 20 and got.filter("time_to_throw is null or processed_at is null").count() == 0


def test_streamed_enriched_plays_close_with_the_watermark(spark, tmp_path):
    """A play with frames, one without, one whose frames have no passer; a late frame belongs to no play."""
    play = ('{"game_id": "g", "play_id": %d, "event_time": "2024-01-01T0%d:00:00", "quarter": 1, "down": 3, "ydstogo": 7, "yardline_100": 30,'
            ' "play_type": "pass", "shotgun": 1, "defenders_in_box": 6, "number_of_pass_rushers": 4, "time_to_throw": 1.5}')
    spot = ('{"game_id": "g", "play_id": %d, "frame_id": %d, "player_id": "%s", "team": "%s", "position": "%s", "x": %f, "y": %f,'
            ' "event_time": "2024-01-01T0%d:%02d:0%d"}')
    frames = [spot % (1, 1, "q", "A", "QB", 0, 0, 1, 0, 0), spot % (1, 1, "d", "B", "CB", 3, 4, 1, 0, 0), spot % (1, 1, "w", "A", "WR", 0, 1, 1, 0, 0),
              spot % (1, 2, "q", "A", "QB", 0, 3, 1, 0, 2), spot % (1, 2, "d", "B", "CB", 0, 4, 1, 0, 2), spot % (1, 3, "d", "B", "CB", 0, 3, 1, 30, 0),
              spot % (3, 1, "d", "B", "CB", 0, 4, 1, 0, 0)]
    events = [play % (i, 1) for i in (1, 2, 3)]
    for name, own in (("plays", events), ("frames", frames)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(own) + "\n")
    for more in (False, True):
        if more:
            (tmp_path / "plays" / "b.json").write_text(play % (9, 9) + "\n")
            (tmp_path / "frames" / "b.json").write_text(spot % (9, 1, "q", "A", "QB", 0, 0, 9, 0, 0) + "\n")
        enriched = jobs.enrich_tracked(jobs.read_from_files(spark, str(tmp_path / "plays"), data.TRACKED_PLAY, None),
                                       jobs.read_from_files(spark, str(tmp_path / "frames"), TRACKING_FRAME, None))
        jobs.write_to_parquet(enriched, str(tmp_path / "out"), str(tmp_path / "ckpt"), None, every=None).awaitTermination()
    got = {r.play_id: (r.nearest_defender_dist, r.qb_pocket_location, r.time_to_throw)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1.0, "Left", 2.0), 2: (None, None, 1.5), 3: (None, None, 1.5)}


def test_counters_of_a_restarted_stream(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    schema = "game_id string, play_type string, down int"

    def go(seen):
        stream = jobs.write_to_parquet(counters.count_plays(jobs.read_from_files(spark, source, schema)), out, ckpt,
                                       partition_by=None, every=None)
        stream.awaitTermination()
        return str(stream.id), seen.wait(stream)

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    with counters.listening(spark, counters.PLAYS) as seen:
        put([("a", "run", 1), ("a", "pass", None)])
        put([("b", "pass", 2)])
        first, totals = go(seen)
        assert totals == {"plays": 3, "runs": 1, "passes": 2, "sent": 2} and seen.batches(first) == 2
        put([("c", None, 0)])
        again, totals = go(seen)
        assert again == first and totals == {"plays": 4, "runs": 1, "passes": 2, "sent": 2}
    assert spark.read.parquet(out).count() == 4


def test_counts_of_a_repeated_batch_replace_the_first():
    seen = counters.Counters("n")
    for query, batch, n in (("q", 0, 5), ("q", 1, 2), ("q", 1, 3), ("p", 0, 7), ("q", 2, None)):
        seen.add(query, batch, Row(plays=n))
    seen.add("q", 3, None)
    assert seen.totals("q") == {"plays": 8} and seen.totals("p") == {"plays": 7} and seen.totals("none") == {}
    assert seen.batches("q") == 3


def test_staged_texts_are_packed(spark, sf):
    for path in (data.event_files(spark, sf), data.live_files(spark, sf), data.season_files(spark, sf) + "/all",
                 data.tracking_files(spark, sf)[1] + "/now"):
        names = [n for n in os.listdir(path.removeprefix("file:")) if n.startswith("part-")]
        assert names and all(n.endswith(".gz") for n in names)
    assert spark.read.schema("play_id bigint").json(data.event_files(spark, sf)).count() == data.history(spark, sf).count()


def test_orders_of_one_row_group_are_dealt_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(data, "ROWS_PER_FILE", 100)
    spark.range(1000).selectExpr("id as o_orderkey", "id * 7 as o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    dealt = data._dealt(spark, str(tmp_path), data.TRACKED_PLAYS_SQL)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    assert dealt.exceptAll(data.view_sql(spark, str(tmp_path), data.TRACKED_PLAYS_SQL)).isEmpty() and dealt.count() == 1000
    assert data._frames(spark, str(tmp_path)).count() == 20_000


def test_replayed_chunks_are_packed_and_whole(spark, tmp_path):
    events = spark.range(250).selectExpr("concat('g', id % 3) as game_id", "id as play_id", "if(id % 5 = 0, null, id) as down")
    jobs.write_replay(materialise(events), str(tmp_path / "replay"), 100, compression="gzip")
    files = sorted((tmp_path / "replay").glob("chunk=*/part-*"))
    assert len(files) == 3 and all(f.name.endswith(".json.gz") for f in files)
    got = spark.read.schema("game_id string, play_id bigint, down bigint, chunk int").json(str(tmp_path / "replay"))
    assert got.drop("chunk").exceptAll(events).isEmpty() and events.exceptAll(got.drop("chunk")).isEmpty()
    assert sorted(r["count"] for r in got.groupBy("chunk").count().collect()) == [50, 100, 100]


def test_newest_rows_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "game_id string, timestamp int")
    sinks.write_newest(rows, 0, str(tmp_path), "game_id", "timestamp")
    files = list((tmp_path / "batch=0").glob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "batch=0")).collect()} == {("a", 2), ("b", 1)}
