"""Building blocks for rules: flags and step tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or cannot be told."""
    return F.when(condition, 1).otherwise(0)


def first_match(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first case whose condition holds."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def at_most(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """Value of the first step with ``c <= bound``; bounds ascend."""
    return first_match([(c <= bound, value) for bound, value in steps], otherwise)


def at_least(c: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """Value of the first step with ``c >= bound``; bounds descend."""
    return first_match([(c >= bound, value) for bound, value in steps], otherwise)


def bonus(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)
