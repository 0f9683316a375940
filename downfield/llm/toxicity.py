"""Toxicity by non-negative positive-unlabelled learning."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from downfield.llm.common import unused
from downfield.session import materialise

# Bounds of the labelled rows a model is fitted on; scoring covers every row.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12_000
DIMENSIONS = 1 << 20
PREFIXES = (4, 5)
MIN_DOCS, MIN_SIGMA = 5, 3.0
THRESHOLD = 0.3
_NOT_LETTERS = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()),
                               b" " * sum(not chr(i).isalnum() for i in range(128)))
_CACHE = 1 << 20


def terms(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a whole text; a null or empty text has none."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_NOT_LETTERS).split())


def features(term: bytes) -> list[int]:
    """Hashed places of a word and of its beginnings, which related words share."""
    return [xxh32_intdigest(term) % DIMENSIONS, *(xxh32_intdigest(b"^" + term[:n]) % DIMENSIONS
                                                  for n in PREFIXES if len(term) > n)]


def term_ids(text: str | None) -> np.ndarray:
    """The places of all distinct words; a beginning counts once for each of them."""
    return np.sort(np.fromiter((i for t in terms(text) for i in features(t)), np.int32))


@dataclass
class Model:
    """Weights by hashed word (only those learnt), a bias, and the share of toxic texts assumed."""
    weights: dict[int, float]
    bias: float
    prior: float


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: np.ndarray, prior: float, steps: int = 300,
        rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Logistic model of the non-negative risk: ``prior`` times the loss of the positives as positives, plus the loss of
    the unlabelled as negatives less ``prior`` times that of the positives, where the latter difference must not fall below
    zero: when it does, the step goes the other way and undoes the overfit. The unlabelled texts hold toxic ones too.
    ``names`` are the places with a weight, ascending; texts are given by these places only. Full-batch Adam from zero, so
    reruns agree."""
    if not positive or not unlabelled:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    docs, p, u = [*positive, *unlabelled], len(positive), len(unlabelled)
    row = np.repeat(np.arange(p + u, dtype=np.int32), [len(d) for d in docs])
    column = np.searchsorted(names, np.concatenate(docs))
    theta, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    moment, spread = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, theta[column], p + u)
        chance = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        as_negative = np.logaddexp(0, z)
        push = np.empty(p + u)
        if as_negative[p:].mean() >= prior * as_negative[:p].mean():
            push[:p] = prior * (chance[:p] - 1) / p - prior * chance[:p] / p
            push[p:] = chance[p:] / u
        else:
            push[:p], push[p:] = prior * chance[:p] / p, -chance[p:] / u
        slope = np.append(np.bincount(column, push[row], len(names)) + decay * theta, push.sum())
        moment = 0.9 * moment + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope ** 2
        move = rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.999 ** step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model(dict(zip(names.tolist(), theta.tolist())), float(bias), prior)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, positive, ids) of the labelled rows to fit on: of those the fold allows, by a hash of the id, at most
    ``MAX_POSITIVE`` confirmed toxic ones, and at most ``MAX_UNLABELLED`` of all, whose labels go unread. A null or twofold
    label confirms nothing."""
    known = (labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.coalesce(F.min("toxic"), F.lit(0)).alias("toxic")))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = (known.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive"))
              .union(known.orderBy(*order).limit(MAX_UNLABELLED).select("doc_id", F.lit(False))))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([term_ids(t) for t in texts])

    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "positive", ids("text").alias("ids")).groupBy("doc_id", "positive").agg(F.min("ids").alias("ids"))


def telling_places(rows: DataFrame, p: int, u: int) -> np.ndarray:
    """The places, ascending, whose frequency among the ``p`` positive texts differs from that among the ``u`` unlabelled ones
    by ``MIN_SIGMA`` standard errors; there are ``DIMENSIONS`` at most."""
    held, usual = F.col("held") / F.lit(float(p)), F.col("usual") / F.lit(float(u))
    seen = rows.select("positive", F.explode(F.array_distinct("ids")).alias("place")).groupBy("place").agg(
        F.count_if("positive").alias("held"), F.count_if(~F.col("positive")).alias("usual"))
    error = F.sqrt(F.greatest(usual, F.lit(1 / u)) * F.greatest(1 - usual, F.lit(1 / u)) / F.lit(float(p)))
    telling = seen.where((F.col("held") + F.col("usual") >= MIN_DOCS) & (F.abs(held - usual) >= MIN_SIGMA * error))
    return np.sort(np.array([r["place"] for r in telling.select("place").collect()], np.int32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on confirmed toxic texts and on other texts taken as unlabelled. The class prior is the share of toxic rows
    among all labels that the fold allows. Places are chosen by Spark from all words of these texts; only the ids of chosen ones
    come to the driver, for at most ``MAX_POSITIVE`` + ``MAX_UNLABELLED`` rows."""
    share = (labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .agg(F.avg(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("double"))).first()[0])
    prior = min(max(share or 0.01, 0.001), 0.5)
    rows = materialise(training_rows(docs, labels))
    p, u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not p or not u:
        return fit([], [], np.empty(0, np.int32), prior)
    names = telling_places(rows, p, u)

    @F.pandas_udf("binary")
    def chosen(ids: pd.Series) -> pd.Series:
        known = np.zeros(DIMENSIONS, bool)
        known[names] = True
        return pd.Series([i[known[i]].astype(np.int32).tobytes() for i in ids])

    found = rows.select("doc_id", "positive", chosen("ids").alias("ids")).collect()
    found.sort(key=lambda r: r["doc_id"])
    sets = {kind: [np.frombuffer(r["ids"], np.int32) for r in found if r["positive"] == kind] for kind in (True, False)}
    return fit(sets[True], sets[False], names, prior)


def score(text: Column, model: Model) -> Column:
    """Chance of toxicity, 0 to 1, from the words of the whole text; texts without words score the bias alone."""
    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, float] = {}
        get, weights = known.get, model.weights
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                z = model.bias
                for t in sorted(terms(text)):
                    w = get(t)
                    if w is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        w = known[t] = sum(weights.get(i, 0.0) for i in features(t))
                    z += w
                out[i] = z
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return chance(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts score the bias; whole texts count,
    however long; repeated rows score alike; a null id is not held out; without labels every text scores the assumed
    share; an empty table gives no rows. Other columns are ignored."""
    model = train(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged; for rows as in ``toxicity``."""
    chance = unused("score", docs)
    return docs.withColumn(chance, score(F.col("text"), train(docs, labels))).where(F.col(chance) < THRESHOLD).drop(chance)
