"""Models: what must hold whatever the trees look like."""

import hashlib
import threading
import time

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from downfield.constants import PASS_LABELS, RUN_LABELS, SCORING_TARGETS
from downfield.models import boosting, metrics, training
from downfield.operators.features import apply_scaler, fit_scaler, prepare_ep, scaled_features
from downfield.session import SETTINGS, configure, held, materialise, release, shared_dir
from downfield.sources import testdata as data


@pytest.fixture(scope="module")
def plays(spark, sf):
    return training.materialise(data.history(spark, sf))


@pytest.fixture(scope="module")
def ep(plays):
    return training.train_ep(plays, trees=5, depth=3)


def test_untrained_model_is_an_error(plays):
    with pytest.raises(ValueError):
        training.apply_model(None, plays, "p")
    with pytest.raises(ValueError):
        training.score_outcomes({}, plays)
    with pytest.raises(ValueError):
        training.predict_class({}, plays)


def test_ep_beats_the_mean_and_survives_saving(spark, plays, ep, tmp_path):
    model, quality = ep
    assert quality.first().r2 > 0.5
    training.save(model, str(tmp_path / "m"))
    again = training.load(str(tmp_path / "m"))
    one = spark.createDataFrame([(1, 10, 75)], "down int, ydstogo int, yardline_100 int")
    a, b = (training.apply_model(m, one, "p").first().p for m in (model, again))
    assert isinstance(a, float) and a == b
    top = training.importance(model, 1).collect()
    assert [r.feature for r in top] == ["yardline_100"]


def test_scored_rows_are_all_rows(plays, ep):
    assert training.apply_model(ep[0], plays, "p").filter("p is not null").count() == plays.count()


def test_scoring_leaves_the_input_alone(plays, ep):
    scored = training.apply_model(ep[0], plays, "p")
    assert scored.drop("p").schema == plays.schema
    assert scored.filter("down is null").count() == plays.filter("down is null").count() > 0


def test_sets_survive_saving(spark, plays, ep, tmp_path):
    path = str(tmp_path / "set")
    training.save_set(spark, {"b": ep[0], "a": ep[0]}, path, {"a": ["x", "y"]})
    models, labels = training.load_set(spark, path)
    assert list(models) == ["b", "a"] and labels == {"a": ["x", "y"]}
    scored = training.apply_models({**models, "own": ep[0]}, plays)
    assert scored.filter("a <> own or b <> own or a is null").count() == 0


def test_outcomes_sum_to_one(plays):
    models, quality = training.train_scoring(plays, trees=2, depth=2, targets=SCORING_TARGETS[:4])
    assert {r.target for r in quality.collect()} == set(SCORING_TARGETS[:4])
    scored = training.score_outcomes(models, plays.limit(200))
    total = sum((F.col(f"{t}_pred") for t in SCORING_TARGETS[:4]), F.lit(0.0))
    assert scored.select(F.max(F.abs(total - 1))).first()[0] < 1e-9


def test_normalise_leaves_rows_without_a_positive_sum(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in training.normalise(df, ["a", "b"]).collect()] == [(0.25, 0.75), (0.0, 0.0)]


def test_class_follows_the_three_stages(plays):
    models, report = training.train_classifier(plays, trees=(2, 2, 2), depths=(2, 2, 2))
    stages = plays
    for name in ("run_pass", "run_type", "pass_type"):
        stages = training.apply_model(models[name], stages, f"by_{name}")
    got = training.predict_class(models, stages).groupBy("by_run_pass", "by_run_type", "by_pass_type",
                                                         "predicted_class").count().collect()
    assert got
    for r in got:
        thrown, run = PASS_LABELS[int(r.by_pass_type)], RUN_LABELS[int(r.by_run_type)]
        assert r.predicted_class == (thrown if r.by_run_pass == 1 else run)
    assert report.agg(F.sum("support")).first()[0] > 0


def test_pressure_chances(plays):
    model, quality = training.train_pressure(plays, trees=3, depth=3)
    assert {r["class"] for r in quality.collect()} == {0, 1}
    for row in quality.collect():
        assert 0.5 < row.auc <= 1.0 and 0 <= row.accuracy <= 1 and 0 <= row.f1 <= 1
    chances = training.apply_model(model, plays, "p", proba=True).agg(F.min("p"), F.max("p")).first()
    assert 0 <= chances[0] <= chances[1] <= 1


def test_all_trees_are_fitted(plays):
    assert training.train_pressure(plays, trees=12, depth=2)[0].stages[-1].getNumTrees == 12
    assert training.train_ep(plays, trees=30, depth=2)[0].stages[-1].getNumTrees == 30
    train = training.train_test(training.materialise(training.with_split(training.prepare_class(plays))))[0]
    assert training.train_run_pass(train, 12, 2).stages[-1].getNumTrees == 12
    assert training.train_run_type(train, 12, 2).stages[-1].getNumTrees == 12


def _of_known_sums(spark):
    rows = [(float(i % 5), ((i * 7919) % 1000) / 1000 - 0.5, float((i * 31) % 60), 0.0, float(1 + i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, weight double").withColumns(
        {"y": F.sin(F.col("b") * 6) * F.col("a") + F.col("c") / 20, "label": (F.col("b") * F.col("a") > 0.1).cast("int")})
    return VectorAssembler(inputCols=["a", "b", "c", "same"], outputCol="features").transform(df.repartition(3))


@pytest.mark.parametrize("ours, sparks, more", [
    (boosting.BoostedRegressor, GBTRegressor, {"labelCol": "y", "minInstancesPerNode": 10}),
    (boosting.BoostedClassifier, GBTClassifier, {"weightCol": "weight", "minInstancesPerNode": 5}),
    (boosting.BoostedRegressor, GBTRegressor, {"labelCol": "y", "maxBins": 8})])
def test_trees_are_those_of_spark(spark, monkeypatch, ours, sparks, more):
    monkeypatch.setattr(boosting, "TASK_PLAYS", 500)  # four tasks
    monkeypatch.setattr(boosting, "CELLS", 100)
    df = _of_known_sums(spark)
    own, want = (kind(maxIter=8, maxDepth=4, stepSize=0.1, seed=42, **more).fit(df) for kind in (ours, sparks))
    assert own.treeWeights == want.treeWeights and own.totalNumNodes == want.totalNumNodes
    assert own.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    answer = F.col("prediction") if sparks is GBTRegressor else vector_to_array("probability")[1]
    got = own.transform(want.transform(df).select("features", answer.alias("want"))).withColumn("got", answer)
    assert got.filter(F.abs(F.col("got") - F.col("want")) > 1e-9).count() == 0


def test_a_fit_takes_few_jobs_however_many_trees(spark, plays):
    def jobs(trees: int) -> int:
        spark.sparkContext.setJobGroup(f"fit {trees}", "")
        training.train_run_pass(training.train_test(training.with_split(training.prepare_class(plays)))[0], trees, 3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {trees}"))

    assert jobs(40) <= jobs(2) + 3


def test_fits_refuse_what_spark_refuses(spark):
    df = _of_known_sums(spark)
    for wrong in (df.withColumn("label", F.lit(2)), df.withColumn("label", F.lit(None).cast("int")), df.filter("false")):
        with pytest.raises(Exception):
            boosting.BoostedClassifier(maxIter=2).fit(wrong)


def test_values_beyond_the_kept_ones_cut_plays_evenly():
    import numpy as np
    values = np.arange(100_000) / 7
    kept, weights = boosting._thinned(values, np.ones(len(values)))
    assert len(kept) <= boosting.VALUES and weights.sum() == len(values)
    cuts = boosting.thresholds(kept, weights, 32)
    parts = np.diff(np.searchsorted(values, [-1, *cuts, 1e9]))
    assert len(cuts) == 31 and parts.max() < 1.1 * len(values) / 32


def test_without_barrier_stages_sparks_own_fit_runs(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_mounted", lambda *_: None)
    monkeypatch.setattr(boosting, "booster", None)
    assert boosting.BoostedRegressor(labelCol="y", maxIter=3).fit(_of_known_sums(spark)).getNumTrees == 3


def test_registered_pass_stages_ask_for_the_published_trees(spark, sf, monkeypatch):
    from downfield.plans import model_queries
    asked, fit = [], training._fit

    def short(df, columns, estimator):
        one = estimator.getClassifier() if hasattr(estimator, "getClassifier") else estimator
        asked.append((one.getLabelCol(), one.getMaxIter(), one.getMaxDepth(), one.getStepSize()))
        one.setMaxIter(1).setMaxDepth(1)
        return fit(df, columns, estimator)

    monkeypatch.setattr(training, "_fit", short)
    model_queries.q_ml_passtype(spark, sf)
    model_queries.q_hier_predict(spark, sf)
    stage = ("pass_index", 400, 7, 0.03)
    assert asked == [stage, ("is_pass", 300, 6, 0.05), ("is_outside", 300, 6, 0.05), stage]


def _dealt_sizes(plays, monkeypatch, train) -> list[list[int]]:
    """Plays per task of each fit that ``train`` asks for, when all plays come from one file."""
    sizes, fit = [], training._fit

    def short(df, columns, estimator):
        sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        one = estimator.getClassifier() if hasattr(estimator, "getClassifier") else estimator
        one.setMaxIter(1).setMaxDepth(1)
        return fit(df, columns, estimator)

    monkeypatch.setattr(training, "LEAST_PLAYS", 50)
    monkeypatch.setattr(training, "_fit", short)
    train(training.materialise(plays.coalesce(1)))
    return sizes


@pytest.mark.parametrize("train", [training.train_ep, training.train_pressure])
def test_single_fits_deal_their_plays_over_the_cores(spark, plays, monkeypatch, train):
    (sizes,) = _dealt_sizes(plays, monkeypatch, train)
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)


@pytest.mark.parametrize("train, at_once", [(training.train_run_pass, 1), (training.train_run_type, 1), (training.train_pass_type, 3)])
def test_class_fits_deal_their_plays_over_the_cores(spark, plays, monkeypatch, train, at_once):
    (sizes,) = _dealt_sizes(training.with_split(training.prepare_class(plays)).filter("is_train"), monkeypatch, train)
    parts = -(-spark.sparkContext.defaultParallelism // at_once)
    assert len(sizes) == parts and max(sizes) - min(sizes) <= parts


def test_scoring_fits_deal_their_plays(spark, plays, monkeypatch):
    sizes = _dealt_sizes(plays, monkeypatch, lambda df: training.train_scoring(df, targets=SCORING_TARGETS[:4]))
    parts = -(-spark.sparkContext.defaultParallelism // 4)
    assert [len(s) for s in sizes] == [parts] * 4 and max(map(max, sizes)) - min(map(min, sizes)) <= parts


@pytest.mark.parametrize("limit, together", [(10**9, 3), (10, 1)])
def test_stages_are_fitted_together_over_few_plays(plays, monkeypatch, limit, together):
    begun, most, lock, fit = [], [], threading.Lock(), training._fit

    def counted(df, columns, estimator):
        with lock:
            begun.append(estimator.getLabelCol())
            most.append(len(begun))
        model = fit(df, columns, estimator)
        time.sleep(5)
        with lock:
            begun.remove(estimator.getLabelCol())
        return model

    monkeypatch.setattr(training, "FEW_PLAYS", limit)
    monkeypatch.setattr(training, "_fit", counted)
    models, _ = training.train_classifier(plays, trees=(1, 1, 1), depths=(1, 1, 1))
    assert max(most) == together and list(models) == ["run_pass", "run_type", "pass_type"]


@pytest.mark.parametrize("limit, together", [(10**9, 7), (10, 4)])
def test_scoring_fits_run_together_over_few_plays(plays, monkeypatch, limit, together):
    at_once = []
    monkeypatch.setattr(training, "FEW_PLAYS", limit)
    monkeypatch.setattr(training, "dealt", lambda df, n=1: at_once.append(n) or df)
    training.train_scoring(plays, trees=1, depth=1)
    assert at_once == [together]


def test_dealt_plays_are_all_plays(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, None if i % 3 else "x") for i in range(1000)], "a int, b string").coalesce(1)
    assert training.dealt(df).rdd.getNumPartitions() == 1  # too few to share out
    monkeypatch.setattr(training, "LEAST_PLAYS", 10)
    cores = spark.sparkContext.defaultParallelism
    for at_once, most, parts in ((1, 1000, cores), (3, 1000, -(-cores // 3)), (1, 50, cores * -(-1000 // (50 * cores)))):
        monkeypatch.setattr(training, "MOST_PLAYS", most)
        got = training.dealt(df, at_once)
        assert got.rdd.getNumPartitions() == parts
        assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    assert training.dealt(df.where("false")).count() == 0


def test_split_is_stable_and_keeps_copies_together(plays):
    split = training.with_split(prepare_ep(plays))
    sides = split.groupBy("game_id", "play_id").agg(F.count_distinct("is_train").alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 1
    share = split.agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.77 < share < 0.83
    other = training.with_split(prepare_ep(plays.repartition(3)))
    assert split.exceptAll(other).count() == 0


def test_exact_split_cuts_each_label_at_four_fifths(spark):
    rows = [(f"g{i % 7}", i, "a" if i < 90 else "b" if i < 101 else None) for i in range(104)] + [("g", 1, "c")] * 10
    df = spark.createDataFrame(rows, "game_id string, play_id int, kind string")
    got = training.with_exact_split(df, "kind")
    counts = {r.kind: (r.n, r.t) for r in got.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()}
    assert counts == {"a": (90, 72), "b": (11, 8), None: (3, 2), "c": (10, 8)}
    assert got.columns == [*df.columns, "is_train"]
    assert got.exceptAll(training.with_exact_split(df.repartition(3), "kind")).isEmpty()
    assert training.with_exact_split(df.where("false"), "kind").isEmpty()
    with pytest.raises(ValueError):
        training.with_exact_split(df.withColumn("Rank", F.lit(1)), "kind")


def test_exact_split_ranks_only_the_plays_at_the_cuts(spark, monkeypatch):
    ranked, running = [], training.running
    monkeypatch.setattr(training, "running", lambda df, *more: ranked.append(df.count()) or running(df, *more))
    rows = [(f"g{i % 7}", i, "a" if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "game_id string, play_id int, kind string")
    got = training.with_exact_split(df, "kind")
    assert sum(ranked) < 30
    order = {k: sorted(hashlib.md5(f"42|{g}|{i}".encode()).hexdigest() for g, i, x in rows if x == k) for k in ("a", None)}
    train = {k: order[k][:len(order[k]) * 4 // 5] for k in order}
    want = {(g, i, k): hashlib.md5(f"42|{g}|{i}".encode()).hexdigest() <= train[k][-1] for g, i, k in rows}
    assert {(r.game_id, r.play_id, r.kind): r.is_train for r in got.collect()} == want


def test_auc_frame_by_group(spark):
    rows = [("x", 0, .1), ("x", 1, .4), ("x", 0, .4), ("x", 1, .8), ("x", 0, .2), ("x", 1, .2), (None, 1, .5), (None, 0, .5),
            ("y", 1, .3), ("y", 1, None), ("y", None, .9)]
    df = spark.createDataFrame(rows, "g string, y int, s double")

    def pairs(of):
        pos, neg = [s for y, s in of if y == 1], [s for y, s in of if y == 0]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None

    known = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {g: pairs([(y, s) for h, y, s in known if h == g]) for g in ("x", "y", None)}
    got = {r.g: r.auc for r in metrics.auc_frame(df, "y", "s", "g").collect()}
    assert got == pytest.approx(want, abs=1e-12)
    whole = metrics.auc_frame(df, "y", "s").first().auc
    assert whole == pytest.approx(pairs([(y, s) for _, y, s in known]), abs=1e-12)


def test_scaler_keeps_the_figures_it_was_fitted_on(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "down double")
    other = spark.createDataFrame([(10.0,), (None,)], "down double")
    training.save(fit_scaler(train, ["down"]), str(tmp_path / "s"))
    got = apply_scaler(training.load(str(tmp_path / "s")), other).select(vector_to_array("features")[0].alias("v")).collect()
    mean, deviation = 4 / 3, (((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (4 / 3) ** 2) / 2) ** .5
    assert sorted(r.v for r in got) == pytest.approx([-mean / deviation, (10 - mean) / deviation])


def test_auc_against_pairs(spark):
    rows = [(0, .1), (1, .4), (0, .4), (1, .8), (0, .2), (1, .2)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s") - want) < 1e-12


def test_scaled_features_are_centred(plays):
    from pyspark.ml.functions import vector_to_array
    v = scaled_features(plays).select(vector_to_array("features")[1].alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(v[0]) < 1e-9 and abs(v[1] - 1) < 1e-9


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settings_reach_any_session(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    configure(other)
    assert {k: other.conf.get(k) for k in SETTINGS} == SETTINGS


def test_release_removes_later_tables(spark):
    before = held(spark)
    kept = materialise(spark.range(3))
    own = held(spark)
    gone = materialise(spark.range(5))
    release(spark, own)
    assert kept.count() == 3 and held(spark) == own == before + 1
    with pytest.raises(Exception):
        gone.count()
