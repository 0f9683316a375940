"""Quality rules with risk-controlled cutoffs."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import BLANK, words
from downfield.session import materialise

RUN = 5
SYMBOLS = "[#*$%&|<>]+"
# Per mille of a text's characters, lines or words. A text is rejected by a rule if its value is above the cutoff.
RULES = ("symbols", "capitals", "dup_lines", "repeats")
CUTOFFS = (800, 600, 400, 300, 250, 200, 150, 125, 100, 75, 50, 30, 20, 10)
# Of the good texts of a stratum at most RISK are rejected, all rules together, with confidence 1 - DOUBT for all strata at once.
RISK, DOUBT = 0.05, 0.05
# A cutoff is worth having if it rejects more than so many bad texts for each good one.
COST = 20
BROADCAST_STRATA = 10_000


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANK))) > 0)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed.

    Windows of five words are compared by a 64-bit hash within their own text. Only texts in which a hash comes back are
    sorted to find the words covered."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", "lang", text.alias("text"), words(text).alias("w"), _lines(text).alias("lines"))
    none = F.array().cast("array<bigint>")
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - RUN),
                         lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(RUN)]))
    step = step.select(
        "doc_id", "lang", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_capitals"),
        F.when(F.size("w") > RUN, hashes).otherwise(none).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    listed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(repeats, listed))

    def twice(x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(F.col("s"), j - 1)["h"])
        return (before.eqNullSafe(x["h"])) | F.get(F.col("s"), j + 1)["h"].eqNullSafe(x["h"])

    step = step.withColumn("starts", F.when(F.col("s").isNotNull(), F.sort_array(
        F.transform(F.filter("s", twice), lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(F.lit(RUN), F.coalesce(F.get(F.col("starts"), j + 1) - x, F.lit(RUN)))),
        F.lit(0), lambda total, x: total + x)
    step = step.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(0))
    out = step.select("doc_id", "lang", *[F.col(c).cast("long").alias(a) for c, a in (
        ("n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"),
        ("n_repeat_words", "n_repeat_words"), ("n_lines", "n_lines"), ("n_capitals", "n_capitals"))])
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """Each rule's value in whole per mille; a text without characters, lines or words has 0."""
    def share(part: str, whole: str) -> Column:
        return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("int")

    return {"symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the exact chance of ``k`` or fewer successes among ``n`` of chance ``p``, summed term by term."""
    first = n.cast("double") * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
        top = F.greatest(state["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(state["total"] - top) + F.exp(term - top))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1), k.cast("int")), start, add)["total"]).otherwise(first)


def select_cutoffs(held: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, rule, cutoff) for the rules in use, from labelled rows (stratum, good, and a value for each rule).

    In each stratum and for each rule the cutoffs are tried from lenient to strict. A cutoff is certified if so few good
    rows lie above it that, were its true share of false rejections above the rule's part of ``risk``, as few would be
    seen with a chance of at most ``doubt`` over the number of strata and rules (Bonferroni); the first that fails ends
    the sequence, which needs no further correction. Of the certified ones that with the greatest gain is used, or none."""
    part = risk / len(RULES)
    wide = held.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("x"))
    # How many cutoffs lie below the value: it is rejected by those.
    above = sum((F.col("x.value") > c).cast("int") for c in CUTOFFS)
    counted = wide.groupBy("stratum", F.col("x.rule").alias("rule"), "good", above.alias("above")).agg(F.count("*").alias("c"))
    totals = counted.groupBy("stratum", "rule").agg(F.coalesce(F.sum(F.when(F.col("good"), F.col("c"))), F.lit(0)).alias("n"))
    tested = (counted.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(CUTOFFS))])).alias("step"))
              .where(F.col("above") >= len(CUTOFFS) - F.col("step"))
              .groupBy("stratum", "rule", "step").agg(
                  F.coalesce(F.sum(F.when(F.col("good"), F.col("c"))), F.lit(0)).alias("k"),
                  F.coalesce(F.sum(F.when(~F.col("good"), F.col("c"))), F.lit(0)).alias("caught")))
    every = totals.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(CUTOFFS))])).alias("step"))
    tested = every.join(tested, ["stratum", "rule", "step"], "left").fillna(0, ["k", "caught"])
    tests = totals.groupBy().agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    few = F.col("k") <= part * F.col("n")
    passed = few & (log_binomial_cdf(F.col("n"), F.when(few, F.col("k")).otherwise(0), part)
                    <= F.log(F.lit(doubt) / F.col("tests")))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certified = (tested.join(F.broadcast(tests)).withColumn("passed", passed)
                 .withColumn("certified", F.min("passed").over(so_far)).where("certified")
                 .withColumn("gain", F.col("caught") - COST * F.col("k")).where("gain > 0"))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("gain", (-F.col("step")).alias("lenient"))).alias("best"))
    cutoff = F.get(F.array(*[F.lit(c) for c in reversed(sorted(CUTOFFS))]), -F.col("best.lenient"))
    return best.select("stratum", "rule", cutoff.alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """One row per row of ``docs``: the columns of ``base`` and kept, which is false for texts that fail the base rules or
    lie above a cutoff of their stratum (the language; null is one). Labelled rows that pass the base rules are the
    holdout; a twofold label counts as bad if one of its rows does, a null label is none.

    Without enough labels no cutoff is certified and all that pass the base rules are kept. Null and empty texts have no
    words and fail; repeated rows are judged alike; other columns are ignored."""
    stratum = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum")
    based = materialise(base(docs).select("*", stratum, *[c.alias(r) for r, c in measures().items()]))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good"))
    held = based.where("not base_failed").join(known, "doc_id")
    cuts = select_cutoffs(held, risk, doubt)
    cuts = materialise(cuts.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]))
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return based.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
