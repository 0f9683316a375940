"""Benchmark decontamination by a prefix-filtered set join."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import KEYS, lower_ascii, row_key, without
from downfield.session import materialise

WINDOW, SHINGLE = 13, 3
# A benchmark of up to so many shingles is sent to every executor (about 20 bytes each); a larger one is joined by shuffle.
BROADCAST_SHINGLES = 2_000_000
SHARE = 20


def words(text: Column) -> Column:
    """Runs of a-z, digits and non-ASCII characters after lowering A-Z; a null text has none."""
    apart = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), apart), "")


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(win, item_id, n, k, grams): the windows of all items, named by their words; n words in shingles of k words."""
    items = (benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
             .withColumn("n", F.least(F.size("w"), F.lit(window))))
    places = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    wide = items.select("item_id", "n", F.explode(F.transform(places, lambda i: F.slice("w", i, F.col("n")))).alias("w"))
    wide = wide.withColumn("k", F.least("n", F.lit(SHINGLE)))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("k"))

    def grams_of(k: int) -> Column:
        return F.transform(starts, lambda i: gram([F.get(F.col("w"), i + j) for j in range(k)]))

    grams = [grams_of(k) for k in range(1, SHINGLE + 1)]
    chosen = F.when(F.col("k") == 1, grams[0])
    for k in range(2, SHINGLE + 1):
        chosen = chosen.when(F.col("k") == k, grams[k - 1])
    return wide.select(F.xxhash64("w").alias("win"), "item_id", "n", "k", chosen.alias("grams"))


def gram(shingle: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(shingle)), *shingle)


def benchmark_hits(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, keys, n_words, place, gram, hit, own): every shingle of the texts that also occurs in a window is a hit, found
    in one pass. The one row that is ``own`` of each row of ``docs`` carries its number of words, hit or not."""
    known = wins.select(F.explode("grams").alias("known")).distinct()
    lengths = sorted(r["k"] for r in wins.select("k").distinct().collect()) or [SHINGLE]
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    # Each word beside those that follow it; past the end there are none.
    beside = F.arrays_zip(*[F.slice("w", j + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{j}") for j in range(max(lengths))])
    placed = (docs.select("doc_id", *row_key(), words(F.col("text")).alias("w"))
              .select("doc_id", *KEYS, F.size("w").alias("n_words"), F.posexplode_outer(beside).alias("at", "x"))
              .withColumn("place", F.coalesce("at", F.lit(0))))
    own = F.col("place") == 0
    if len(lengths) == 1:
        k = lengths[0]
        grams = placed.select("doc_id", *KEYS, "n_words", "place", F.lit(k).alias("k"), gram([F.col(f"x.w{j}") for j in range(k)]).alias("gram"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("k"), gram([F.col(f"x.w{j}") for j in range(k)]).alias("gram")) for k in lengths])
        grams = placed.select("doc_id", *KEYS, "n_words", "place", F.explode(each).alias("y")).select(
            "doc_id", *KEYS, "n_words", "place", "y.k", "y.gram")
        own = own & (F.col("k") == lengths[0])
    whole = F.col("place") + F.col("k") <= F.col("n_words")
    return (grams.join(known, F.col("gram") == F.col("known"), "left")
            .withColumn("hit", F.col("known").isNotNull() & whole).withColumn("own", own)
            .where("hit or own").drop("known", "k"))


def occurrences(seen: DataFrame, wins: DataFrame) -> DataFrame:
    """(keys, win, start, n): where windows lie in documents.

    The shingles of a window are ordered by how often they occur in all documents. A match holds all of them, so its
    necessary prefix is the one rarest shingle, and candidates begin only there. Its place gives the start, which must
    leave room on both sides (positional and length bounds). A candidate holds if shingles that together cover the
    window lie at their places, which is exact containment. A window with a shingle of no document has no candidate."""
    distinct = wins.select("win", "n", "k", "grams").dropDuplicates(["win"])
    # Repeated rows have one key: each place of it counts once, so that copies do not meet copies.
    places = materialise(seen.where("hit").select(*KEYS, "n_words", "place", "gram").distinct())
    counts = places.groupBy("gram").agg(F.count("*").alias("held"))
    spread = distinct.select("win", F.size("grams").alias("m"), F.posexplode("grams").alias("q", "gram"))
    prefix = (spread.join(counts, "gram").groupBy("win", "m")
              .agg(F.count("*").alias("found"), F.min(F.struct("held", "q", "gram")).alias("rarest"))
              .where("found = m").select("win", "rarest.q", "rarest.gram"))
    prefix = materialise(prefix.join(distinct, "win"))
    if prefix.count() <= BROADCAST_SHINGLES // WINDOW:
        prefix = F.broadcast(prefix)
    candidates = (places.join(prefix, "gram").withColumn("start", F.col("place") - F.col("q"))
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))))
    # Every k-th shingle and the last one cover all words.
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - F.col("k"), F.col("k")),
                                      F.array(F.col("n") - F.col("k"))))
    asked = (candidates.withColumn("cover", cover)
             .select(*KEYS, "win", "start", "n", F.size("cover").alias("m"), "grams", F.posexplode("cover").alias("j", "at"))
             .select(*KEYS, "win", "start", "n", "m", "j", (F.col("start") + F.col("at")).alias("place"),
                     F.get("grams", F.col("at")).alias("gram")))
    there = places.select(*KEYS, "place", "gram")
    return (asked.join(there, [*KEYS, "place", "gram"]).groupBy(*KEYS, "win", "start", "n", "m")
            .agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))
            .where(F.bit_count("bits") == F.col("m")).select(*KEYS, "win", "start", "n"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a benchmark window), n_items,
    items_sha256, contaminated (``share`` times n_hit reaches n_words) and the row's key.

    Null and empty texts have no words and are clean; whole texts count, however long; items without words match nothing,
    shorter items are one window; an empty benchmark leaves all clean, an empty table gives no rows; repeated rows are judged once and
    get equal results; a window at several places, or in several items, counts for each; other columns are ignored."""
    wins = materialise(windows(benchmark, window))
    seen = materialise(benchmark_hits(docs, wins))
    found = materialise(occurrences(seen, wins))
    earlier = Window.partitionBy(*KEYS).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    hit = (found.select(*KEYS, "start", "n").distinct()
           .withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))))
           .groupBy(*KEYS).agg(F.sum("fresh").alias("n_hit")))
    items = (found.select(*KEYS, "win").distinct().join(wins.select("win", "item_id").distinct(), "win")
             .groupBy(*KEYS).agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))
    listed = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return (seen.where("own").select("doc_id", *KEYS, F.col("n_words").cast("long").alias("n_words"))
            .join(hit.join(items, KEYS), KEYS, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"),
                    F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), *KEYS)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged."""
    bad = contamination(docs, benchmark, **settings).where("contaminated").select(*KEYS).distinct()
    return without(docs, materialise(bad))
