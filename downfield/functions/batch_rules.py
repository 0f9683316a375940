"""Rule set applied to micro-batches of live plays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from downfield.functions.rules import at_least, at_most, bonus, first_match

# Points by down, and chances by distance.
DOWN_POINTS = {1: 0.5, 2: 0.1, 3: -0.4, 4: -1.2}
TD_STEPS = [(5, 0.60), (10, 0.45), (20, 0.30), (50, 0.18)]
TD_BEYOND = 0.10
FG_STEPS = [(30, 0.90), (40, 0.80), (50, 0.65), (55, 0.45)]
FG_BEYOND = 0.25
KICK_YARDS = 17


def _cut(c: Column, scale: float) -> Column:
    """Drop the decimals beyond ``scale``, towards zero."""
    return (c * F.lit(scale)).cast("bigint") / F.lit(scale)


def raw_points(down: Column, to_go: Column, yards: Column, boosts: list[tuple[int, float]]) -> Column:
    """Points from field position, down and distance; near the goal boosts add up."""
    points = (F.lit(100) - yards) * F.lit(0.06) - F.lit(1.0)
    points += first_match([(down == d, p) for d, p in DOWN_POINTS.items()], 0.0)
    points += first_match([(to_go <= 3, 0.4), (to_go >= 10, -0.3)], 0.0)
    for bound, extra in boosts:
        points += bonus(yards <= bound, extra)
    return points


def expected_points(down: Column, to_go: Column, yards: Column) -> Column:
    points = raw_points(down, to_go, yards, [(20, 1.2), (10, 0.8), (5, 0.5)])
    return F.when(down.isNull() | yards.isNull(), 0.0).otherwise(_cut(points, 100.0))


def td_probability(yards: Column, down: Column) -> Column:
    chance = at_most(yards, TD_STEPS, TD_BEYOND)
    chance *= first_match([(down == 1, 1.1), (down == 4, 0.6)], 1.0)
    return F.when(yards.isNull(), 0.0).otherwise(F.least(_cut(chance, 1000.0), F.lit(0.95)))


def fg_probability(yards: Column) -> Column:
    return F.when(yards.isNull(), 0.0).otherwise(at_most(yards + KICK_YARDS, FG_STEPS, FG_BEYOND))


def no_score_probability(td: Column, fg: Column) -> Column:
    """What the two chances leave; there is no floor, so it can fall below zero."""
    return F.lit(1.0) - td - fg * F.lit(0.5)


def pressure_risk(rushers: Column) -> Column:
    return first_match([(rushers >= 5, "high"), (rushers <= 3, "low")], "medium")


def pass_probability(down: Column, to_go: Column) -> Column:
    by_down = at_least(down, [(3, 0.70)], 0.55)
    return F.when(to_go >= 7, 0.75).when(to_go.isNotNull(), by_down).otherwise(0.55)


def predicted_play(down: Column, to_go: Column) -> Column:
    return first_match([(to_go <= 2, "run"), (down == 4, "punt_or_fg")], "pass")
