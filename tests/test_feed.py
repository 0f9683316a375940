"""Hand-written feed documents, most with branches missing."""

import json

import pytest

from downfield.operators import feed
from downfield.sources import testdata as data

TEAM = {"home": {"homeAway": "home", "score": "21", "team": {"id": "1", "abbreviation": "KC"}},
        "away": {"homeAway": "away", "score": "14", "team": {"id": "2", "abbreviation": "BUF"}}}


def records(spark, event, summary=None):
    events = spark.createDataFrame([("g", json.dumps(event))], "game_id string, event string")
    rows = [("g", json.dumps(summary))] if summary is not None else []
    summaries = spark.createDataFrame(rows, "game_id string, summary string")
    return feed.flatten_feed(events, summaries)


def test_empty_documents(spark):
    r = records(spark, {}).first()
    assert (r.down, r.ydstogo, r.yardline_100, r.qtr, r.half_seconds_remaining) == (0, 0, 50, 1, 1800)
    assert (r.home_team, r.home_score, r.away_score, r.posteam_type) == (None, 0, 0, "away")
    assert r.broadcasts == [] and r.winProbabilityHistory == [] and r.odds is None
    assert r.venue.grass is True and r.venue.indoor is False and r.status.completed is False


@pytest.mark.parametrize("ball,line,yards,lead,kind", [
    ("KC", 35, 65, 7, "home"), ("BUF", 35, 35, -7, "away"), ("KC", 0, 75, 7, "home"), (None, 20, 20, -7, "away")])
def test_possession(spark, ball, line, yards, lead, kind):
    event = {"competitions": [{"competitors": [TEAM["away"], TEAM["home"]]}]}
    now = {"down": 2, "distance": 7, "yardLine": line, "possession": ball}
    r = records(spark, event, {"situation": {k: v for k, v in now.items() if v is not None}}).first()
    assert (r.yardline_100, r.score_differential, r.posteam_type) == (yards, lead, kind)
    assert (r.posteam, r.defteam) == (("KC", "BUF") if kind == "home" else ("BUF", "KC"))


def test_last_entry_of_a_kind_wins(spark):
    home = dict(TEAM["home"], records=[{"type": "total", "summary": "1-1"}, {"name": "overall", "summary": "2-1"},
                                       {"type": "road", "name": "home", "summary": "0-1"}],
                leaders=[{"name": "passingYards", "leaders": [{"value": 1, "athlete": {"fullName": "A"}}]},
                         {"name": "PassingRushing", "leaders": [{"value": 2, "athlete": {"fullName": "",
                                                                                        "displayName": "B"}}]},
                         {"name": "rushing", "leaders": []}])
    r = records(spark, {"competitions": [{"competitors": [home]}]}).first().home_team_full
    assert (r.records.overall, r.records.home, r.records.away, r.record) == ("2-1", None, "0-1", "2-1")
    assert (r.leaders.passing.name, r.leaders.passing.active) == ("B", True)
    assert r.leaders.rushing is None and r.leaders.receiving is None


def test_lists(spark):
    event = {"competitions": [{"broadcasts": [{"names": ["A", "B"]}, {}, {"names": ["C"]}],
                               "tickets": [{"summary": "x", "links": []}], "odds": [{"spread": -3.5}, {"spread": 1}]}],
             "links": [{"rel": ["pbp", "summary"], "href": "both"}, {"rel": ["boxscore"], "href": "b"}, {}]}
    points = [{"playId": str(i), "homeWinPercentage": i / 100, "secondsLeft": i} for i in range(12)]
    r = records(spark, event, {"winprobability": points}).first()
    assert r.broadcasts == ["A", "B", "C"]
    assert (r.links.gamecast, r.links.boxscore, r.links.playbyplay) == ("both", "b", None)
    assert (r.tickets.summary, r.tickets.link) == ("x", None)
    assert (r.odds.spread, r.odds.homeFavorite, r.odds.moneyline.home) == (-3.5, False, None)
    assert [p.playId for p in r.winProbabilityHistory] == [str(i) for i in range(2, 12)]


def test_drives_without_plays_or_current(spark):
    event = {"competitions": [{"competitors": list(TEAM.values())}]}
    play = {"id": "4", "start": {"down": 1, "team": {"id": "2"}}}
    for drives, n in (({}, 0), ({"previous": [{"id": "d"}]}, 0), ({"current": {"plays": [play]}}, 1),
                      ({"previous": [{"plays": [play, dict(play, id="x")]}], "current": {"plays": [play]}}, 3)):
        ev = spark.createDataFrame([("g", json.dumps(event))], "game_id string, event string")
        su = spark.createDataFrame([("g", json.dumps({"drives": drives}))], "game_id string, summary string")
        plays = feed.parse_feed_play(feed.explode_plays(ev, su)).collect()
        assert len(plays) == n
        if plays:
            assert {(p.posteam, p.defteam, p.posteam_id) for p in plays} == {("BUF", "KC", "2")}
    assert sorted((p.play_id is None, p.play_id) for p in plays if p.play_id) == [(False, 4), (False, 4)]


def test_only_playable_live_games_are_scored(spark):
    docs = [("a", "in", 1), ("b", "in", 0), ("c", "post", 1)]
    ev = spark.createDataFrame([(g, json.dumps({"status": {"type": {"state": s}}})) for g, s, _ in docs],
                               "game_id string, event string")
    su = spark.createDataFrame([(g, json.dumps({"situation": {"down": d}})) for g, _, d in docs],
                               "game_id string, summary string")
    got = feed.live_records(ev, su).collect()
    assert [r.game_id for r in got] == ["a"] and got[0].ml_predictions.td_prob == got[0].td_prob
    assert feed.poll_counters(ev, su).first().asDict() == {"games": 3, "live_games": 2, "plays_sent": 1}


def test_join_carries_only_the_branches_that_are_read(spark):
    """The situation needs neither drives of a summary nor leaders of a competitor: neither is parsed or dealt."""
    events = spark.createDataFrame([("g", "{}")], "game_id string, event string")
    summaries = spark.createDataFrame([("g", "{}")], "game_id string, summary string")
    games = feed.with_situation(feed.home_away(feed.game_summary_join(events, summaries)))
    plan = games.select("game_id", "posteam", "yardline_100", "score_differential")._jdf.queryExecution().optimizedPlan()
    join = next(line for line in plan.toString().splitlines() if "Project" in line and "_extract" in line)
    assert "winprobability" not in plan.toString() and "home_side" not in join


def test_staged_documents_are_packed(spark, sf):
    for df in data.feed_documents(spark, sf):
        assert df.inputFiles() and all(name.endswith(".zstd.parquet") for name in df.inputFiles())
