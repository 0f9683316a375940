"""Mixing sources to target weights along a curriculum."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import n_words, small
from downfield.operators.numbering import running
from downfield.session import dropping_shuffles, materialise

# Weights by the place of a source in code point order, repeating.
WEIGHTS = (5, 2, 1)
# A schedule is a list of (share of the training, relative rate): sources of the first weight come early, of the last late.
SCHEDULES = (((0.25, 2), (0.5, 1), (0.25, 0)), ((1.0, 1),), ((0.25, 0), (0.5, 1), (0.25, 2)))
LIMIT = 3
# Passes of a partial reading.
PASSES = 3
# A written mix is read once; long pages and thorough packing make it an eighth smaller than zstandard's own settings.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}


def source_targets(sources: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """Add place, weight and target to a table of one row per source (source, source_size).

    A target is the source's weight share of all words, up to ``limit`` times its size; what is above that goes to the
    others by weight. So targets are min(limit * size, level * weight) for one level. Sources in order of the level
    at which they fill up are full as long as the rest of the words, shared by the rest of the weights, lies above;
    that share is highest at the wanted level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = (sources.withColumn("place", F.row_number().over(by_name) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                                 (F.col("place") % len(weights) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * limit))
    filling = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    return (placed.withColumn("at", left.cast("double") / share.cast("double"))
            .withColumn("level", F.max("at").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
            .drop("cap", "at", "level"))


def position(demand: Column, place: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Training time, 0 to 1, at which a source has used the share ``demand`` of its target. The schedule's rate is
    integrated over its phases; the phase in which the integral reaches the demand is inverted."""
    out = None
    for k, schedule in enumerate(schedules):
        total = sum(span * rate for span, rate in schedule)
        start, used, when = 0.0, 0.0, None
        last = F.lit(1.0)
        for span, rate in schedule:
            gained = span * rate / total
            if gained > 0:
                value = F.lit(start) + (demand - F.lit(used)) * F.lit(span / gained)
                when = (F.when(demand <= F.lit(used + gained), value) if when is None
                        else when.when(demand <= F.lit(used + gained), value))
                last = F.lit(start + span)
                used += gained
            start += span
        own = when.otherwise(last)
        hit = place % len(schedules) == k
        out = F.when(hit, own) if out is None else out.when(hit, own)
    return out


def last_reading(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, rank) of the documents that a last, partial reading takes, and (stream, open), the words it leaves open, for
    (stream, rank, size, before, rest), ``rest`` being the words wanted.

    A pass takes documents in reading order as long as they fit, where those larger than what is open do not count, and so
    stops no earlier than a text that does fit by itself. ``PASSES`` passes follow each other, the last one from the smallest
    document up: after it, what is open is less than the size of any document left."""
    taken = None
    left = materialise(placed.groupBy("stream").agg(F.max("rest").alias("open")))
    for turn in range(PASSES):
        free = placed.select("stream", "rank", "size")
        if taken is not None:
            free = free.join(taken, ["stream", "rank"], "left_anti")
        free = free.join(small(left), "stream").where((F.col("open") > 0) & (F.col("size") <= F.col("open")))
        order = [F.col("place")] if turn < PASSES - 1 else [F.col("size"), F.col("place")]
        now = running(materialise(free.withColumnRenamed("rank", "place")), ["stream"], order, "size")
        now = materialise(now.where(F.col("before") + F.col("size") <= F.col("open")).select("stream", F.col("place").alias("rank"), "size"))
        used = now.groupBy("stream").agg(F.sum("size").alias("used"))
        left = materialise(left.join(used, "stream", "left").select("stream", (F.col("open") - F.coalesce("used", F.lit(0))).alias("open")))
        chosen = now.select("stream", "rank")
        taken = chosen if taken is None else materialise(taken.union(chosen))
    return taken, left


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, limit: int = LIMIT) -> DataFrame:
    """How often each row of ``docs`` is taken, and when.

    Each source is a stream of its documents in a fixed shuffled order, read again and again up to its target:
    ``copies`` whole readings, and in a last one the documents that ``last_reading`` takes and one more that best fills what is
    left, so that a target is missed by less than the smallest document not taken. The demand before the middle of a reading, put through the inverse of the integrated schedule, is its training
    position. Returns doc_id, key (of the row), source, size, source_size, target, copies, taken and positions (one per
    copy, ascending).

    A null text has size 0, a null source is a source of its own, rows of size 0 are taken as often as the rest of
    their source would be and add no words; whole texts count, however long; repeated rows are separate rows, and ties in the order
    are rows alike; other columns are ignored. An empty table gives none."""
    thin = materialise(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("key"),
        F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffled"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stream")))
    sources = materialise(source_targets(
        thin.groupBy("source", "stream").agg(F.sum("size").alias("source_size")), weights, limit))
    order = [F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("key")]
    placed = running(thin, ["stream"], order, "size").drop("shuffled").join(
        small(sources.select("stream", "source_size", "target", "place")), "stream")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))
    placed = materialise(placed.withColumn("whole", whole.cast("int")).withColumn("rest", rest))
    more, left = last_reading(placed)
    # What is still open, filled by the document that comes nearest, if that is nearer than none.
    fit = F.abs(F.col("size") - F.col("open"))
    best = materialise(placed.join(more, ["stream", "rank"], "left_anti").join(small(left), "stream").where(fit < F.col("open"))
                       .groupBy("stream").agg(F.min(F.struct(fit.alias("off"), "rank")).alias("best"))
                       .select("stream", F.col("best.rank").alias("best")))
    placed = placed.join(more.withColumn("more", F.lit(True)), ["stream", "rank"], "left").withColumn("more", F.coalesce("more", F.lit(False)))
    copies = F.col("whole") + F.when(F.col("more") | (F.col("rank") == F.col("best")), 1).otherwise(0)
    middle = F.col("before") + F.col("size") / F.lit(2.0)
    taken = (placed.join(small(best), "stream", "left").withColumn("copies", copies).withColumn("middle", middle))
    turns = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return (taken.withColumn("positions", F.transform(turns, lambda turn: position(
                F.when(F.col("target") > 0, F.least(F.lit(1.0), (turn * F.col("source_size") + F.col("middle")) / F.col("target"))
                       ).otherwise(F.lit(0.5)), F.col("place"), schedules)))
            .select("doc_id", "key", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "positions"))


def _laid(docs: DataFrame, settings: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    """The plan, the rows it takes in training order (``row``, with their position ``at``), and the key columns that both have.

    Rows equal in doc_id, source and text share a key. They are numbered among themselves over range partitions, by a hash of
    all their columns, and the n-th takes the n-th place of the plan, so no array or task holds all of them."""
    keys = [F.xxhash64("doc_id", "source", "hash").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "source", "hash").alias("k2")]
    key = ["k1", "k2"]
    planned = materialise(plan(docs, **settings).withColumnRenamed("key", "hash").select(
        *keys, "doc_id", "size", "source_size", "target", "positions"))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row")).select(*keys, "row")
    repeated = materialise(planned.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    if not repeated.isEmpty():
        again = small(repeated)

        def told_apart(df: DataFrame, order: Column) -> DataFrame:
            copies = running(materialise(df.join(again, key).withColumn("one", F.lit(1))), key, [order], "one").drop("one", "before")
            return copies.unionByName(df.join(again, key, "left_anti").withColumn("rank", F.lit(0)))

        planned, rows = materialise(told_apart(planned, F.get("positions", F.lit(0)))), told_apart(rows, F.xxhash64("row"))
        key = [*key, "rank"]
    # Written between the two exchanges of whole texts, packed and before copies multiply, so that only one of them is on disk at a time.
    placed = materialise(rows.join(planned.where(F.size("positions") > 0).select(*key, "positions"), key).select(
        *key, "row", "positions"), compression="zstd")
    at = placed.select(*key, "row", F.explode("positions").alias("at"))
    return planned, at.repartitionByRange("at", "k1").sortWithinPartitions("at", "k1"), key


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` in training order, repeated or left out as ``plan`` says, with their columns unchanged."""
    with dropping_shuffles(docs.sparkSession):
        return _laid(docs, settings)[1].select("row.*")


def account(docs: DataFrame, **settings) -> DataFrame:
    """Write the mix of ``docs``, whole rows in training order, and tell from what was written how often each row is in it
    (``copies``), with how many words (``taken``) and where first (``first_position``, null if not). One row for each of
    ``docs``, with doc_id, size, source_size and target as ``plan`` has them."""
    with dropping_shuffles(docs.sparkSession):
        planned, laid, key = _laid(docs, settings)
        written = materialise(laid, **PACKED)
    found = written.groupBy(*key).agg(F.count("*").alias("copies"), F.sum(n_words(F.col("row.text"))).alias("taken"),
                                      F.min("at").alias("first_position"))
    return planned.join(found, key, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("copies", F.lit(0).cast("long")).alias("copies"), "first_position")
