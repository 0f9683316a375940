"""Rule set behind live scoring requests.

Inputs are complete plays (see ``operators.clean.play_defaults``). Sums keep
their order of addition: .25 + .10 + .10 is just below .45 in doubles, and the
risk label depends on it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from downfield.functions.batch_rules import KICK_YARDS, raw_points
from downfield.functions.rules import at_least, at_most, bonus, first_match

# Chances by distance, and constant chances of the opponent.
TD_STEPS = [(5, 0.55), (10, 0.40), (20, 0.28), (50, 0.15)]
TD_BEYOND = 0.08
FG_STEPS = [(30, 0.92), (40, 0.82), (50, 0.65), (55, 0.45)]
FG_BEYOND = 0.25
OPPONENT_TD = 0.05
OPPONENT_FG = 0.02


def expected_points(down: Column, to_go: Column, yards: Column) -> Column:
    return F.round(raw_points(down, to_go, yards, [(20, 1.5), (10, 1.0), (5, 0.5)]), 2)


def td_probability(yards: Column, down: Column) -> Column:
    chance = at_most(yards, TD_STEPS, TD_BEYOND)
    chance *= first_match([(down == 1, 1.1), (down == 4, 0.5)], 1.0)
    return F.least(chance, F.lit(0.95))


def fg_probability(yards: Column) -> Column:
    return at_most(yards + KICK_YARDS, FG_STEPS, FG_BEYOND)


def no_score_probability(td: Column, fg: Column) -> Column:
    return F.greatest(F.lit(0.05), F.lit(1.0) - td - fg * F.lit(0.3))


def pass_probability(down: Column, to_go: Column, seconds: Column, lead: Column, shotgun: Column) -> Column:
    base = first_match([(to_go <= 2, 0.40),
                        ((seconds < 120) & (lead < 0), 0.85),
                        ((down == 3) & (to_go >= 5), 0.82),
                        (to_go >= 10, 0.78),
                        (to_go >= 7, 0.72)], 0.55)
    return F.least(base + bonus(shotgun == 1, 0.10), F.lit(0.95))


def predicted_play(down: Column, to_go: Column, yards: Column, passing: Column) -> Column:
    return first_match([(to_go <= 2, "run"),
                        ((down == 4) & (yards > 40), "punt"),
                        (down == 4, "field_goal"),
                        (passing > 0.6, "pass")], "run")


def pressure_probability(rushers: Column, defenders: Column, down: Column, to_go: Column) -> Column:
    chance = at_least(rushers, [(6, 0.55), (5, 0.45)], 0.25)
    chance += bonus(defenders >= 8, 0.10)
    chance += bonus((down == 3) & (to_go >= 7), 0.10)
    return F.least(chance, F.lit(0.80))


def pressure_risk(chance: Column) -> Column:
    return at_least(chance, [(0.45, "high"), (0.30, "medium")], "low")
