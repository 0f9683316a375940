"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.session import materialise

ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of type long); the root is the smallest node of the component.

    Alternates large-star and small-star steps, each two grouped minima and joins over the edge table, and writes the
    edges to the shared folder after every round. Ends when a round changes nothing."""
    kept = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(ROUNDS):
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return kept.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                kept.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = state
        kept = materialise(_small_star(_large_star(kept)))
    raise RuntimeError("components did not settle")
