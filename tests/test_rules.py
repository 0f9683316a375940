"""Rules on a grid of situations against an independent statement of each rule."""

import itertools

import pytest
from pyspark.sql import functions as F

from downfield.functions import text
from downfield.functions.situation import parse_personnel
from downfield.operators.score import score_api, score_batch

DOWNS = [None, 1, 2, 3, 4]
DISTANCES = [None, 1, 2, 3, 5, 7, 9, 10, 12]
YARDS = [None, 1, 5, 6, 10, 13, 20, 21, 33, 38, 40, 41, 50, 51, 99]


def near(a, b):
    return abs(a - b) < 1e-9


def points(down, to_go, yards, red, ten):
    p = (100 - yards) * 0.06 - 1.0 + {1: 0.5, 2: 0.1, 3: -0.4, 4: -1.2}.get(down, 0)
    p += 0 if to_go is None else 0.4 if to_go <= 3 else -0.3 if to_go >= 10 else 0
    return p + (red if yards <= 20 else 0) + (ten if yards <= 10 else 0) + (0.5 if yards <= 5 else 0)


def table(value, bounds, beyond):
    return next((v for b, v in bounds if value <= b), beyond)


@pytest.fixture(scope="module")
def grid(spark):
    rows = list(itertools.product(DOWNS, DISTANCES, YARDS))
    return spark.createDataFrame(rows, "down int, ydstogo int, yardline_100 int").withColumn(
        "number_of_pass_rushers", F.lit(4))


def test_batch_rules(grid):
    for r in score_batch(grid).collect():
        down, to_go, yards = r.down, r.ydstogo, r.yardline_100
        if down is None or yards is None:
            assert r.expected_points == 0.0
        else:
            assert near(r.expected_points, int(points(down, to_go, yards, 1.2, 0.8) * 100) / 100)
        if yards is None:
            assert (r.td_prob, r.fg_prob) == (0.0, 0.0)
        else:
            td = table(yards, [(5, .6), (10, .45), (20, .3), (50, .18)], .1) * {1: 1.1, 4: .6}.get(down, 1)
            assert near(r.td_prob, min(int(td * 1000) / 1000, .95))
            assert r.fg_prob == table(yards + 17, [(30, .9), (40, .8), (50, .65), (55, .45)], .25)
        assert near(r.no_score_prob, 1 - r.td_prob - r.fg_prob * .5)
        assert r.pass_probability == (.55 if to_go is None else .75 if to_go >= 7 else
                                      .7 if down is not None and down >= 3 else .55)
        assert r.predicted_play == ("run" if to_go is not None and to_go <= 2 else
                                    "punt_or_fg" if down == 4 else "pass")


@pytest.mark.parametrize("shotgun,seconds,lead,rushers,defenders", [
    (1, 900, 0, 4, 6), (0, 100, -3, 5, 8), (1, 119, -1, 6, 9), (0, 120, -1, 3, 8)])
def test_live_rules(grid, shotgun, seconds, lead, rushers, defenders):
    plays = grid.drop("number_of_pass_rushers").withColumns({
        "shotgun": F.lit(shotgun), "half_seconds_remaining": F.lit(seconds), "score_differential": F.lit(lead),
        "number_of_pass_rushers": F.lit(rushers), "defenders_in_box": F.lit(defenders)})
    for r in score_api(plays).collect():
        down, to_go, yards = r.down, r.ydstogo, r.yardline_100
        assert None not in (down, to_go, yards)
        assert near(r.expected_points, round(points(down, to_go, yards, 1.5, 1.0), 2))
        td = min(table(yards, [(5, .55), (10, .4), (20, .28), (50, .15)], .08) * {1: 1.1, 4: .5}.get(down, 1), .95)
        fg = table(yards + 17, [(30, .92), (40, .82), (50, .65), (55, .45)], .25)
        assert near(r.td_prob, round(td, 3)) and near(r.fg_prob, fg)
        assert near(r.no_score_prob, round(max(.05, 1 - td - fg * .3), 3))
        p = .4 if to_go <= 2 else .85 if seconds < 120 and lead < 0 else .82 if down == 3 and to_go >= 5 else \
            .78 if to_go >= 10 else .72 if to_go >= 7 else .55
        p = min(p + (.1 if shotgun else 0), .95)
        assert near(r.pass_probability, round(p, 3)) and near(r.run_probability, round(1 - p, 3))
        assert r.predicted_play == ("run" if to_go <= 2 else "punt" if down == 4 and yards > 40 else
                                    "field_goal" if down == 4 else "pass" if p > .6 else "run")
        risk = .55 if rushers >= 6 else .45 if rushers >= 5 else .25
        risk += .1 if defenders >= 8 else 0
        risk += .1 if down == 3 and to_go >= 7 else 0
        assert near(r.pressure_probability, round(min(risk, .8), 3))
        assert r.pressure_risk == ("high" if risk >= .45 else "medium" if risk >= .3 else "low")


def test_two_tenths_on_a_quarter_stay_medium(spark):
    """.25 + .10 + .10 is below .45 in doubles."""
    play = spark.createDataFrame([(3, 8, 50, 4, 8)], "down int, ydstogo int, yardline_100 int, "
                                 "number_of_pass_rushers int, defenders_in_box int")
    row = score_api(play).first()
    assert (row.pressure_probability, row.pressure_risk) == (0.45, "medium")


def test_empty_play_takes_all_defaults(spark):
    row = score_api(spark.createDataFrame([(None,)], "game_id string")).first()
    assert (row.down, row.ydstogo, row.yardline_100, row.predicted_play) == (1, 10, 75, "pass")


def test_personnel(spark):
    texts = [("1 RB, 2 TE, 2 WR",), ("2 RB, 1 FB, 1 TE",), (None,), ("nothing",), ("10RB",)]
    rows = spark.createDataFrame(texts, "t string").select(parse_personnel(F.col("t")).alias("p")).select("p.*")
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 2), (3, 1, 0), (1, 1, 3), (0, 0, 0), (10, 0, 0)]


def test_clock(spark):
    rows = [("15:00", 1, 1800), ("7:30", 2, 450), ("0:05", 3, 905), ("7", 4, 420), ("Half", 2, 900),
            (None, 2, 900), ("1:xx", 1, 900), ("", 1, 900)]
    df = spark.createDataFrame(rows, "t string, p int, want int").select(
        "want", text.clock_seconds(F.col("t"), F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_stat_value(spark):
    lines = [("299/474, 3398 YDS, 22 TD", 299), ("1,204 YDS", 1204), ("12 CAR", 12), ("none", None), (None, None)]
    df = spark.createDataFrame(lines, "t string, want int").select("want", text.stat_value(F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_team_dimension_literally(spark):
    """The oracle reads the same constants as the engine; these few values are stated on their own."""
    from downfield.operators.summary import teams
    got = {r.abbr: (r.name, r.color, r.logo) for r in teams(spark).collect()}
    assert len(got) == 32
    assert got["KC"] == ("Kansas City Chiefs", "E31837", "https://a.espncdn.com/i/teamlogos/nfl/500/kc.png")
    assert got["GB"][:2] == ("Green Bay Packers", "203731") and got["LV"][0] == "Las Vegas Raiders"
    assert {"ARI", "NE", "SF", "WAS"} <= set(got)
