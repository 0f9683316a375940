"""Boosted-tree models on Spark ML: training, evaluation, scoring.

Tree counts, depths and rates default to the published settings. All trees are
fitted, on all training plays: the published fits stop at no validation figure.
Frames that several fits read are fixed in the shared folder first.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import OneVsRest
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from downfield.constants import (CLASS_FEATURES, EP_FEATURES, PASS_LABELS, PRESSURE_FEATURES, RUN_LABELS,
                                 SCORING_FEATURES, SCORING_TARGETS)
from downfield.models.boosting import BoostedClassifier, BoostedRegressor
from downfield.models.metrics import accuracy, auc, classification_report, regression_metrics
from downfield.functions.clean import coerce_zero
from downfield.operators.numbering import running
from downfield.operators.features import prepare_class, prepare_ep, prepare_pressure, prepare_scoring
from downfield.operators.summary import class_weight
from downfield.session import materialise, shared_dir

SEED = 42
TRAIN_SHARE = 0.8
VECTOR = "feature_vector"
# Plays in a task of a fit: with fewer, starting the task costs more than it saves; with more, its kept block gets too large.
LEAST_PLAYS, MOST_PLAYS = 10_000, 1_000_000
# Up to so many plays all fits of a set run at a time; each keeps its own binned plays.
FEW_PLAYS = 5_000_000


def split_point(keys: list[str], seed: int = SEED) -> Column:
    """A number in [0, 1) that depends only on the keys, so the split does not
    change with the partitioning, and copies of a play stay on one side."""
    text = F.concat_ws("|", F.lit(str(seed)), *keys)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_split(df: DataFrame, keys: tuple[str, ...] = ("game_id", "play_id")) -> DataFrame:
    """Mark 80 % of the plays for training. The marks are independent of the label, so each label keeps its share, up to
    sampling."""
    return df.withColumn("is_train", split_point(list(keys)) < TRAIN_SHARE)


def with_exact_split(df: DataFrame, label: str, keys: tuple[str, ...] = ("game_id", "play_id")) -> DataFrame:
    """Mark four fifths, rounded down, of the plays of each label for training; ``df`` plus ``is_train``.

    Plays are ordered within a label by a hash of their keys and cut there. Plays are counted by label and the first bits of
    the hash, which tells the bucket that each label's cut lies in; only the plays of that bucket are ranked, over range
    partitions, as copies of one play may fill it. So no sort sees all plays, and one label may hold most of them. A null label is
    a label. Copies of a play with one label follow each other; only those at the cut can fall on both sides. The result is
    written, so that training and test plays come from one reading."""
    if clash := {"part", "before", "rank", "held", "held_rows"} & {c.lower() for c in df.columns}:
        raise ValueError(f"rename these columns before: {sorted(clash)}")
    hashed = F.md5(F.concat_ws("|", F.lit(str(SEED)), *keys))
    base = materialise(df.withColumns({"_stratum": F.to_json(F.struct(F.col(label).alias("label"))),
                                       "_bucket": F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int")}))
    counts = base.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_plays"))
    whole = Window.partitionBy("_stratum")
    upto = F.sum("_plays").over(whole.orderBy("_bucket"))
    wanted = F.floor(F.sum("_plays").over(whole) * 4 / 5)
    cuts = materialise(counts.select("_stratum", "_bucket", (wanted - upto + F.col("_plays")).alias("_open"), (upto > wanted).alias("_over"))
                       .filter("_over").groupBy("_stratum").agg(F.min(F.struct("_bucket", "_open")).alias("_cut")))
    placed = base.join(cuts, "_stratum")
    at = placed.filter("_bucket = _cut._bucket").withColumns({"_hash": hashed, "_tie": F.xxhash64(*df.columns), "_one": F.lit(1)})
    ranked = running(materialise(at), ["_stratum"], [F.col("_hash"), F.col("_tie")], "_one")
    columns = [F.col(c) for c in df.columns]
    return materialise(placed.filter("_bucket <> _cut._bucket").select(*columns, F.expr("_bucket < _cut._bucket").alias("is_train"))
                       .unionByName(ranked.select(*columns, F.expr("rank < _cut._open").alias("is_train"))))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("is_train"), df.filter("not is_train")


def dealt(df: DataFrame, at_once: int = 1) -> DataFrame:
    """Plays dealt evenly over the cores that each of ``at_once`` fits can use. As they were written, all of them may lie in
    one row group, and one task alone would then pass over them for every level of every tree."""
    cores = -(-df.sparkSession.sparkContext.defaultParallelism // at_once)
    rows = df.count()
    waves = -(-rows // (cores * MOST_PLAYS))
    return df.repartition(max(1, min(cores * waves, rows // LEAST_PLAYS)))


def few(df: DataFrame) -> bool:
    return df.count() <= FEW_PLAYS


def _fit(df: DataFrame, columns: list[str], estimator) -> PipelineModel:
    shared_dir(df.sparkSession)  # fitted trees are written there
    assembler = VectorAssembler(inputCols=columns, outputCol=VECTOR)
    return Pipeline(stages=[assembler, estimator]).fit(df)


def _trees(kind, label: str, trees: int, depth: int, rate: float, at_once: int = 1, **more):
    """Boosted trees, ``trees`` of them, one of ``at_once`` fits at a time."""
    estimator = kind(featuresCol=VECTOR, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED, **more)
    estimator.at_once = at_once
    return estimator


def with_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the feature vector; the columns it is made of stay as they are. Missing columns and values count as 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [coerce_zero(c, kinds[c]) if c in kinds else F.lit(0.0) for c in columns]
    return df.withColumn(VECTOR, array_to_vector(F.array(*values)))


def _apply(model: PipelineModel, df: DataFrame, output: str, proba: bool = False) -> DataFrame:
    """Add one model's answer to a frame that has its vector."""
    scored = model.stages[-1].transform(df)
    value = vector_to_array("probability")[1] if proba else F.col("prediction")
    made = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn("_value", value).drop(*made).withColumnRenamed("_value", output)


def apply_model(model: PipelineModel, df: DataFrame, output: str, proba: bool = False) -> DataFrame:
    """Add a model's prediction, or its chance of class 1, as a plain column; all others stay as they are."""
    if model is None:
        raise ValueError("Model not trained")
    return _apply(model, with_vector(df, model.stages[0].getInputCols()), output, proba).drop(VECTOR)


def apply_models(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """One column per model, by name. Models over the same features share one vector."""
    columns = None
    for name, model in models.items():
        if model is None:
            raise ValueError("Models not trained")
        if model.stages[0].getInputCols() != columns:
            columns = model.stages[0].getInputCols()
            df = with_vector(df.drop(VECTOR), columns)
        df = _apply(model, df, name)
    return df.drop(VECTOR)


def importance(model: PipelineModel, top: int = 10) -> DataFrame:
    """The features a tree model leans on most."""
    names, trees = model.stages[0].getInputCols(), model.stages[-1]
    pairs = list(zip(names, (float(v) for v in trees.featureImportances.toArray())))
    return (SparkSession.active().createDataFrame(pairs, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(top))


def train_ep(df: DataFrame, trees: int = 500, depth: int = 6) -> tuple[PipelineModel, DataFrame]:
    """Expected-points regressor; metrics are those of the test plays."""
    train, test = train_test(materialise(with_split(prepare_ep(df))))
    model = _fit(dealt(train), EP_FEATURES, _trees(BoostedRegressor, "ep", trees, depth, 0.05, subsamplingRate=0.8,
                                            featureSubsetStrategy="0.8", minInstancesPerNode=10))
    return model, regression_metrics(apply_model(model, test, "ep_pred"), "ep", "ep_pred")


def train_scoring(df: DataFrame, trees: int = 300, depth: int = 5,
                  targets: list[str] = SCORING_TARGETS, parallelism: int | None = None,
                  ) -> tuple[dict[str, PipelineModel], DataFrame]:
    """One regressor per scoring outcome, all over the same fixed frame.

    ``parallelism`` fits run at a time, by default all of them over few plays and four over many: between the
    levels of a tree a fit leaves executors idle that another one can use.
    """
    train, test = train_test(materialise(with_split(prepare_scoring(df))))
    parallelism = parallelism or (len(targets) if few(train) else 4)
    shares = dealt(train, min(parallelism, len(targets)))

    def fit(target: str) -> tuple[PipelineModel, DataFrame]:
        model = _fit(shares, SCORING_FEATURES, _trees(
            BoostedRegressor, target, trees, depth, 0.05, min(parallelism, len(targets)), subsamplingRate=0.8,
            featureSubsetStrategy="0.8", minInstancesPerNode=10))
        quality = regression_metrics(apply_model(model, test, "pred"), target, "pred")
        return model, quality.select(F.lit(target).alias("target"), "*")

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), targets))
    return ({t: model for t, (model, _) in zip(targets, fitted)},
            reduce(DataFrame.unionByName, [quality for _, quality in fitted]))


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale the columns of a row to sum to 1, where their sum is positive."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.withColumn("_total", total).withColumns({
        c: F.when(F.col("_total") > 0, F.col(c) / F.col("_total")).otherwise(F.col(c)) for c in columns
    }).drop("_total")


def score_outcomes(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """All scoring outcomes as ``<target>_pred``, summing to 1 per play."""
    if not models:
        raise ValueError("Models not trained")
    df = apply_models({f"{target}_pred": model for target, model in models.items()}, df)
    return normalise(df, [f"{t}_pred" for t in models])


def _run_pass(train: DataFrame, trees: int, depth: int, at_once: int = 1) -> tuple:
    """What ``_fit`` takes for this stage, dealt for ``at_once`` fits at a time; so for the others."""
    return dealt(train, at_once), CLASS_FEATURES, _trees(BoostedClassifier, "is_pass", trees, depth, 0.05, at_once)


def train_run_pass(train: DataFrame, trees: int = 300, depth: int = 6) -> PipelineModel:
    return _fit(*_run_pass(train, trees, depth))


def _run_type(train: DataFrame, trees: int, depth: int, at_once: int = 1) -> tuple:
    runs = train.filter("run_type is not null").withColumn(
        "is_outside", (F.col("run_type") == RUN_LABELS[1]).cast("int"))
    return dealt(runs, at_once), CLASS_FEATURES, _trees(BoostedClassifier, "is_outside", trees, depth, 0.05, at_once)


def train_run_type(train: DataFrame, trees: int = 300, depth: int = 6) -> PipelineModel:
    return _fit(*_run_type(train, trees, depth))


def _label_indexer() -> StringIndexerModel:
    return StringIndexerModel.from_labels(PASS_LABELS, "pass_type", "pass_index", handleInvalid="error")


def _pass_type(train: DataFrame, trees: int, depth: int, at_once: int = len(PASS_LABELS)) -> tuple:
    passes = _label_indexer().transform(train.filter("pass_type is not null"))
    trees_of = _trees(BoostedClassifier, "pass_index", trees, depth, 0.03, at_once)
    return dealt(passes, at_once), CLASS_FEATURES, OneVsRest(
        classifier=trees_of, featuresCol=VECTOR, labelCol="pass_index", parallelism=len(PASS_LABELS))


def train_pass_type(train: DataFrame, trees: int = 400, depth: int = 7) -> PipelineModel:
    """Three pass kinds; Spark's boosted trees are binary, so one model per kind."""
    return _fit(*_pass_type(train, trees, depth))


def predict_class(models: dict[str, PipelineModel], df: DataFrame, output: str = "predicted_class") -> DataFrame:
    """Run or pass first, then the kind of it; all three models as columns."""
    df = apply_models({f"_{stage}": models.get(stage) for stage in ("run_pass", "run_type", "pass_type")}, df)
    thrown = F.get(F.array(*[F.lit(x) for x in PASS_LABELS]), F.col("_pass_type").cast("int"))
    run = F.when(F.col("_run_type") == 1, RUN_LABELS[1]).otherwise(RUN_LABELS[0])
    return (df.withColumn(output, F.when(F.col("_run_pass") == 1, thrown).otherwise(run))
            .drop("_run_pass", "_run_type", "_pass_type"))


def train_classifier(df: DataFrame, trees: tuple[int, int, int] = (300, 300, 400),
                     depths: tuple[int, int, int] = (6, 6, 7)) -> tuple[dict[str, PipelineModel], DataFrame]:
    """All three stages on one split, so no test play was trained on by any stage. Over few plays the stages are fitted
    at a time: none needs another's answers, and between the levels of its trees each leaves executors idle."""
    spark = df.sparkSession
    train, test = train_test(materialise(with_split(prepare_class(df))))
    stages = (("run_pass", _run_pass), ("run_type", _run_type), ("pass_type", _pass_type))
    together = {"at_once": len(stages) - 1 + len(PASS_LABELS)} if few(train) else {}
    with ThreadPoolExecutor(len(stages) if together else 1) as pool:
        # Each stage is counted and dealt while those before it run.
        fits = {name: pool.submit(inheritable_thread_target(spark)(lambda *of: _fit(*of)), *stage(train, t, d, **together))
                for (name, stage), t, d in zip(stages, trees, depths)}
        models = {name: fit.result() for name, fit in fits.items()}
    return models, classification_report(predict_class(models, test), "class_5", "predicted_class")


def train_pressure(df: DataFrame, trees: int = 500, depth: int = 4) -> tuple[PipelineModel, DataFrame]:
    """Pressure classifier; pressured plays weigh as much as the others in total. The report has a row per class
    (precision, recall, F1, support) with accuracy and area under the ROC curve of all test plays."""
    train, test = train_test(materialise(with_split(prepare_pressure(df))))
    weight = class_weight(train, "pressure").first()["weight"] or 1.0
    weighted = train.withColumn("weight", F.when(F.col("pressure") == 1, weight).otherwise(1.0))
    model = _fit(dealt(weighted), PRESSURE_FEATURES, _trees(
        BoostedClassifier, "pressure", trees, depth, 0.01, subsamplingRate=0.7, featureSubsetStrategy="0.7",
        minInstancesPerNode=5, minInfoGain=0.0, weightCol="weight"))
    scored = materialise(apply_model(model, test, "chance", proba=True).withColumn(
        "hit", (F.col("chance") > 0.5).cast("int")))
    share = accuracy(scored, "pressure", "hit").select("accuracy")
    report = classification_report(scored, "pressure", "hit").crossJoin(F.broadcast(share))  # one row
    return model, report.withColumn("auc", F.lit(auc(scored, "pressure", "chance")))


def save(model: PipelineModel, path: str) -> None:
    """The pipeline keeps its feature list in the assembler, so both go together."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_set(spark: SparkSession, models: dict[str, PipelineModel], path: str, labels: dict[str, list[str]] | None = None) -> None:
    """Models by name in folders below ``path``, with their order, features and, if given, label lists."""
    for name, model in models.items():
        save(model, f"{path}/{name}")
    rows = [(i, name, list(m.stages[0].getInputCols()), (labels or {}).get(name)) for i, (name, m) in enumerate(models.items())]
    (spark.createDataFrame(rows, "place int, name string, features array<string>, labels array<string>").coalesce(1)
     .write.mode("overwrite").json(f"{path}/_set"))


def load_set(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, list[str]]]:
    """The models of a set in their order, and their labels."""
    rows = spark.read.schema("place int, name string, features array<string>, labels array<string>").json(
        f"{path}/_set").orderBy("place").collect()
    models = {r["name"]: load(f"{path}/{r['name']}") for r in rows}
    for r in rows:
        if list(models[r["name"]].stages[0].getInputCols()) != r["features"]:
            raise ValueError(f"{path}: {r['name']} was saved with other features")
    return models, {r["name"]: r["labels"] for r in rows if r["labels"]}


CLASS_LABELS = {"run_pass": ["run", "pass"], "run_type": RUN_LABELS, "pass_type": PASS_LABELS}
