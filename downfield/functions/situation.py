"""Game-situation features as column expressions.

Each function takes the columns it needs; comparisons with NULL give 0.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from downfield.functions.rules import flag


def red_zone(yards: Column) -> Column:
    return flag(yards <= 20)


def goal_to_go_territory(yards: Column) -> Column:
    return flag(yards <= 10)


def short_yardage(to_go: Column) -> Column:
    return flag(to_go <= 3)


def long_yardage(to_go: Column) -> Column:
    return flag(to_go >= 8)


def late_down(down: Column) -> Column:
    return flag(down >= 3)


def late_game(quarter: Column, seconds: Column, overtime: bool = False) -> Column:
    """Last five minutes of the fourth quarter; with ``overtime`` also of any later one."""
    return flag(((quarter >= 4) if overtime else (quarter == 4)) & (seconds <= 300))


def heavy_box(defenders: Column) -> Column:
    return flag(defenders >= 7)


def light_box(defenders: Column) -> Column:
    return flag(defenders <= 5)


def blitz(rushers: Column) -> Column:
    return flag(rushers >= 5)


def two_minute_drill(seconds: Column, lead: Column) -> Column:
    return flag((seconds <= 120) & (F.abs(lead) <= 8))


def pass_heavy(down: Column, to_go: Column, lead: Column, quarter: Column) -> Column:
    return flag(((down >= 3) & (to_go >= 5)) | ((lead < -8) & (quarter >= 3)))


def run_heavy(down: Column, to_go: Column, lead: Column, quarter: Column) -> Column:
    return flag(((down <= 2) & (to_go <= 4)) | ((lead > 14) & (quarter >= 3)))


def obvious_passing(down: Column, to_go: Column) -> Column:
    return flag((down >= 3) & (to_go >= 7))


def rushers_ratio(rushers: Column, defenders: Column) -> Column:
    return F.coalesce(F.try_divide(rushers.cast("double"), defenders + 1), F.lit(0.0))


def goal_to_go(yards: Column, to_go: Column) -> Column:
    return flag(yards <= to_go)


def in_red_zone(yards: Column) -> Column:
    """The feed's own flag, a boolean."""
    return yards <= 20


def hurry_up(seconds: Column) -> Column:
    return flag(seconds < 120)


def parse_personnel(text: Column) -> Column:
    """Struct (n_rb, n_te, n_wr) from text such as "1 RB, 2 TE, 2 WR".

    Full backs count as running backs, an absent group as 0, and missing text
    as the usual 1-1-3. An absent group never reaches the cast, whose failure
    would cost far more than the match.
    """
    def group(code: str) -> Column:
        digits = F.regexp_extract(text, rf"(\d+)\s*{code}", 1)
        return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))

    known = text.isNotNull()
    return F.struct(
        F.when(known, group("RB") + group("FB")).otherwise(1).alias("n_rb"),
        F.when(known, group("TE")).otherwise(1).alias("n_te"),
        F.when(known, group("WR")).otherwise(3).alias("n_wr"))


def heavy_personnel(n_rb: Column, n_te: Column) -> Column:
    return flag((n_rb >= 2) | (n_te >= 2))


def spread_personnel(n_wr: Column, shotgun: Column) -> Column:
    return flag((n_wr >= 3) & (shotgun == 1))


def run_type(play_type: Column, location: Column, gap: Column) -> Column:
    inside = location.eqNullSafe("middle") | gap.eqNullSafe("guard")
    return F.when(play_type == "run", F.when(inside, "inside_run").otherwise("outside_run"))


def pass_type(play_type: Column, route: Column, length: Column) -> Column:
    kind = F.when(route == "SCREEN", "screen").when(length == "deep", "deep_pass").otherwise("short_pass")
    return F.when(play_type == "pass", kind)


def win_probability(home_score: Column, away_score: Column, seconds: Column) -> Column:
    """Estimated chance, in percent, that the home side wins."""
    base = F.lit(50) + (home_score - away_score) * F.lit(2.5)
    pulled = base + (F.lit(50) - base) * (F.lit(1) - seconds / F.lit(900)) * F.lit(0.3)
    return F.least(F.greatest(pulled, F.lit(5.0)), F.lit(95.0))
