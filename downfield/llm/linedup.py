"""Removal of repeated line runs by a suffix array over line numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import KEYS, n_words, row_key
from downfield.operators.numbering import running
from downfield.session import materialise

# A repeated run counts if it has so many lines, or so many words in fewer lines.
MIN_LINES, MIN_WORDS = 4, 50


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, keys, doc, g, n, line): a row per row of ``docs``, numbered by doc_id, then by key. ``line`` lists the lines
    with a word (place, 128-bit hash, words); g is the number of the first of them among all, with a gap after each
    text, so that no run reaches from one text into the next."""
    listed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.struct(
        i.alias("place"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), n_words(s).alias("words")))
    thin = docs.select("doc_id", *row_key(), F.filter(listed, lambda x: x["words"] > 0).alias("line"))
    order = [F.col("doc_id").asc_nulls_first(), *map(F.col, KEYS)]
    placed = running(materialise(thin.withColumn("n", F.size("line").cast("long"))), [], order, "n")
    return placed.select("doc_id", *KEYS, F.col("rank").alias("doc"), (F.col("before") + F.col("rank")).alias("g"), "n", "line")


def ranked(windows: DataFrame, key: list[str]) -> DataFrame:
    """(g, r, first, words) of those ``windows`` (g, words and the columns of ``key``) that occur twice or more. r is the
    place of their content in the order of ``key``, first the smallest g with that content."""
    classes = windows.groupBy(*key).agg(F.min("g").alias("first"), F.count("*").alias("one")).where("one > 1")
    placed = running(materialise(classes.withColumn("one", F.lit(1))), [], [F.col(k) for k in key], "one")
    placed = placed.select(*key, "first", F.col("rank").cast("long").alias("r"))
    return materialise(windows.join(placed, key).select("g", "r", "first", "words"))


def repeated_runs(lined: DataFrame, depth: int) -> dict[int, DataFrame]:
    """The suffixes of the whole line sequence by their first 1 to ``depth`` lines, as ``ranked`` gives them.

    Prefix doubling: lines are ranked first; the ranks of runs of p lines at g and at g + p, as a pair, are the key that
    ranks runs of 2p lines, and other lengths join a rank of p lines with one of the remaining lines. Ranks follow the order
    of the suffixes, so those with one rank lie together in the suffix array: they are the interval in which neighbours
    share that many lines or more. Unique runs have no such neighbour and leave the table. Deeper intervals lie
    within those of ``depth`` lines and hold no other lines, so the doubling may end there."""
    single = lined.select("g", F.posexplode("line").alias("i", "x")).select(
        (F.col("g") + F.col("i")).alias("g"), "x.h1", "x.h2", "x.words")
    out = {1: ranked(single, ["h1", "h2"])}
    for length in range(2, depth + 1):
        p = 1 << (length - 1).bit_length() - 1
        head = out[p].select("g", F.col("r").alias("r1"), F.col("words").alias("w1"))
        tail = out[length - p].select((F.col("g") - p).alias("g"), F.col("r").alias("r2"), F.col("words").alias("w2"))
        out[length] = ranked(head.join(tail, "g").select("g", "r1", "r2", (F.col("w1") + F.col("w2")).alias("words")), ["r1", "r2"])
    return out


def later_copies(lined: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(g) of each line in a later copy of a run that counts. A run of more lines is covered by those of ``min_lines``."""
    found = None
    for length, runs in repeated_runs(lined, min_lines).items():
        counts = F.lit(True) if length == min_lines else F.col("words") >= min_words
        own = runs.where((F.col("first") < F.col("g")) & counts).select(
            F.explode(F.sequence(F.col("g"), F.col("g") + (length - 1))).alias("g"))
        found = own if found is None else found.union(own)
    return found.distinct()


def clean(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without later copies of repeated line runs, n_lines (with a word),
    n_dropped, words_dropped.

    The first copy stays: that in the text of the smallest doc_id (null first; then by key), and there the first. A
    copy may overlap the first one. Lines without a word neither count nor break a run and stay; a null text stays null;
    of repeated rows one is the first and the others are its copies; other columns are ignored."""
    lined = materialise(lines(docs))
    gone = materialise(later_copies(lined, min_lines, min_words))
    places = lined.select("doc", "g", F.posexplode("line").alias("i", "x")).select(
        "doc", (F.col("g") + F.col("i")).alias("g"), "x.place", "x.words")
    dropped = (places.join(gone, "g").groupBy("doc")
               .agg(F.collect_list("place").alias("gone"), F.sum("words").alias("words_dropped")))  # at most a text's lines
    marked = lined.select("doc_id", *KEYS, "doc", "n").join(dropped, "doc", "left")
    texts = docs.select(*row_key(), "text").dropDuplicates(KEYS).select(
        *KEYS, "text", F.split("text", "\n").alias("all"))
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("all"), i)), "\n")
    return texts.join(marked, KEYS).select(
        "doc_id", F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.col("n").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("words_dropped", F.lit(0)).cast("long").alias("words_dropped"))
