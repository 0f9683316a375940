"""Global order without a single task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.session import materialise


def dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range parts of ``order``, written with the number of the part. ``df`` must read files, so that a repeated
    task numbers its rows alike; by that number even rows that are equal throughout spread over parts."""
    salted = df.withColumn("part", F.monotonically_increasing_id()).repartitionByRange(*order, "part")
    return materialise(salted.withColumn("part", F.spark_partition_id()), compression="zstd")


def running(df: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows of the same group that come earlier in ``order``, and
    ``rank``, their number.

    No group needs to fit in a task: rows are range-sorted by ``order``, the parts are written with their number, and
    each part adds what the parts before it hold. ``df`` must read files (see ``materialise``). Group columns must not be
    null, and no column may be called part, before, rank, held or held_rows. Rows equal in ``order`` follow in any order.
    """
    rows, keys = dealt(df, order), ["part", *group]
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = (rows.groupBy(*keys).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
            .select(*keys, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("held"),
                    F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("held_rows")))
    within = Window.partitionBy(*keys).orderBy(*order)
    up_to = within.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("before", F.coalesce(F.sum(value).over(up_to), F.lit(0)))
            .withColumn("rank", F.row_number().over(within) - 1)
            .join(held, keys)
            .withColumn("before", F.col("before") + F.col("held"))
            .withColumn("rank", F.col("rank") + F.col("held_rows"))
            .drop("part", "held", "held_rows"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rank``, the row's number from 0 in the order of the named columns; ties fall to a hash of the whole row."""
    tie = [F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)]
    placed = running(materialise(df.withColumn("_one", F.lit(1)), compression="zstd"), [], [*map(F.col, order), *tie], "_one")
    return placed.drop("_one", "before")
