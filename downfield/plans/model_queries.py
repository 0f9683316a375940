"""Registered queries over models, splits and quality measures.

Fits run with the published settings and fit all their trees. What a fitted model must give whatever its trees look like
is stated by the oracles: the test plays and labels, an answer for every one of
them, and errors no worse than those of a constant.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from downfield.constants import EP_FEATURES, SCORING_TARGETS, VECTOR_FEATURES
from downfield.models import metrics, training
from downfield.operators.features import apply_scaler, fit_scaler, prepare_class, prepare_ep, prepare_scoring
from downfield.operators.score import score_batch
from downfield.plans.play_queries import (CLASS_FEATURES_SQL, EP_BATCH, EP_SQL, FROM_PLAYS, KEYS, PASS_BATCH, PLAY_BATCH,
                                          PRESSURE_SQL)
from downfield.plans.registry import query
from downfield.session import new_dir
from downfield.sources import testdata as data

TRAIN_SQL = "('0x' || substr(md5('42|' || game_id || '|' || play_id), 1, 8))::bigint / 4294967296e0 < 8e-1"


@query("train_test_split", f"""select {KEYS}, {TRAIN_SQL} as is_train
 from ({EP_SQL}) t""")
def q_train_test_split(spark, sf):
    return training.with_split(prepare_ep(data.history(spark, sf))).select("game_id", "play_id", "is_train")


@query("exact_split", f"""select {KEYS}, class_5,
 row_number() over (partition by class_5 order by md5('42|' || game_id || '|' || play_id))
 <= count(*) over (partition by class_5) * 4 // 5 as is_train from ({CLASS_FEATURES_SQL}) t where class_5 is not null""")
def q_exact_split(spark, sf):
    labels = prepare_class(data.history(spark, sf)).select("game_id", "play_id", "class_5")
    return training.with_exact_split(labels, "class_5")


def _scaled_by_training(c: str) -> str:
    kept = f"case when {TRAIN_SQL} then coalesce({c}, 0) end"
    return f"round((coalesce({c}, 0) - avg({kept}) over ()) / stddev_samp({kept}) over (), 6) + 0.0 as {c}"


@query("scaled_by_training", f"""select {KEYS}, {", ".join(VECTOR_FEATURES)} from (select {KEYS}, {TRAIN_SQL} as is_train,
 {", ".join(_scaled_by_training(c) for c in VECTOR_FEATURES)} {FROM_PLAYS}) t where not is_train""")
def q_scaled_by_training(spark, sf):
    """Test plays scaled by the means and deviations of the training plays, by a model that was saved and loaded again."""
    train, test = training.train_test(training.with_split(data.plays(spark, sf)))
    path = new_dir(spark, "scaler")
    training.save(fit_scaler(train), path)
    scaled = apply_scaler(training.load(path), test).select("game_id", "play_id", vector_to_array("features").alias("v"))
    return scaled.select("game_id", "play_id", *[
        (F.round(F.col("v")[i], 6) + F.lit(0.0)).alias(c) for i, c in enumerate(VECTOR_FEATURES)])


@query("metric_regression", f"""select count(*) as n, round(sqrt(avg((ep - p) * (ep - p))), 6) as rmse,
 round(1 - avg((ep - p) * (ep - p)) / var_pop(ep), 6) as r2 from (select ep, {EP_BATCH} as p {FROM_PLAYS}) t""")
def q_metric_regression(spark, sf):
    scored = score_batch(data.plays(spark, sf))
    return metrics.regression_metrics(scored, "ep", "expected_points").withColumns(
        {c: F.round(c, 6) for c in ("rmse", "r2")})


CALLS_SQL = f"select play_type as label, {PLAY_BATCH} as predicted {FROM_PLAYS}"


@query("metric_confusion", f"select label, predicted, count(*) as n from ({CALLS_SQL}) t group by all")
def q_metric_confusion(spark, sf):
    return metrics.confusion(score_batch(data.plays(spark, sf)), "play_type", "predicted_play")


@query("metric_report", f"""with cells as (select label, predicted, count(*) as n from ({CALLS_SQL}) t group by all),
 kinds as (select label as class from cells union select predicted from cells),
 sums as (select class, coalesce((select sum(n) from cells where label = class and predicted = class), 0)::double as tp,
  coalesce((select sum(n) from cells where predicted = class), 0)::double as called,
  coalesce((select sum(n) from cells where label = class), 0)::bigint as support from kinds),
 shares as (select *, case when called = 0 then 0 else tp / called end as p,
  case when support = 0 then 0 else tp / support end as r from sums)
 select class, p as precision, r as recall, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1, support
 from shares""")
def q_metric_report(spark, sf):
    return metrics.classification_report(score_batch(data.plays(spark, sf)), "play_type", "predicted_play")


@query("metric_auc", f"""select round((sum(case when y = 1 then rank end)
  - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2e0)
 / (count(*) filter (where y = 1) * cast(count(*) filter (where y = 0) as double)), 9) as auc
 from (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as rank
 from (select {PASS_BATCH} as p, case when play_type = 'pass' then 1 else 0 end as y {FROM_PLAYS}) a) b""")
def q_metric_auc(spark, sf):
    scored = score_batch(data.plays(spark, sf)).withColumn("y", (F.col("play_type") == "pass").cast("int"))
    return metrics.auc_frame(scored, "y", "pass_probability").select(F.round("auc", 9).alias("auc"))


@query("metric_auc_by_season", f"""with ranked as (select season, y, rank() over (partition by season order by p)
  + (count(*) over (partition by season, p) - 1) / 2e0 as rank
  from (select season, {PASS_BATCH} as p, case when play_type = 'pass' then 1 else 0 end as y {FROM_PLAYS}) a),
 sums as (select season, sum(case when y = 1 then rank else 0 end) as ranks, count(*) filter (where y = 1) as pos,
  cast(count(*) filter (where y = 0) as double) as neg from ranked group by season)
 select season, round((ranks - pos * (pos + 1) / 2e0) / nullif(pos * neg, 0), 9) as auc from sums""")
def q_metric_auc_by_season(spark, sf):
    scored = score_batch(data.plays(spark, sf)).withColumn("y", (F.col("play_type") == "pass").cast("int"))
    return metrics.auc_frame(scored, "y", "pass_probability", "season").withColumn("auc", F.round("auc", 9))


@query("scoring_normalise", f"""select {KEYS}, {", ".join(f"round({c} / total, 9) as {c}" for c in SCORING_TARGETS)}
 from (select *, {" + ".join(SCORING_TARGETS)} as total from ({EP_SQL}) a where td_prob is not null) t""")
def q_scoring_normalise(spark, sf):
    rows = training.normalise(prepare_scoring(data.history(spark, sf)), SCORING_TARGETS)
    return rows.select("game_id", "play_id", *[F.round(c, 9).alias(c) for c in SCORING_TARGETS])


def _ep_model(spark, sf) -> str:
    """The expected-points model and its test figures, fitted once per session and saved."""
    def write(path: str) -> None:
        model, quality = training.train_ep(data.history(spark, sf))
        training.save_set(spark, {"ep_pred": model}, f"{path}/models")
        quality.write.parquet(f"{path}/quality")
    return data.staged(spark, sf, "ep_model", write)


def _no_worse_than_mean():
    """Of test rows (n, rmse, r2); a constant target has no r2."""
    return F.coalesce(F.col("r2") >= 0, F.col("rmse") < 1e-6).alias("no_worse_than_mean")


@query("ml_ep", f"select count(*) as n, true as no_worse_than_mean from ({EP_SQL}) t where ep is not null and not {TRAIN_SQL}")
def q_ml_ep(spark, sf):
    quality = spark.read.parquet(f"{_ep_model(spark, sf)}/quality")
    return quality.select("n", _no_worse_than_mean())


@query("ml_scoring", f"""select unnest([{", ".join(f"'{t}'" for t in SCORING_TARGETS)}]) as target, n, true as no_worse_than_mean
 from (select count(*) as n from ({EP_SQL}) t where td_prob is not null and not {TRAIN_SQL}) c""")
def q_ml_scoring(spark, sf):
    quality = training.train_scoring(data.history(spark, sf))[1]
    return quality.select("target", "n", _no_worse_than_mean())


def _stage(spark, sf, fit, label: str):
    """One stage of the classifier on the test plays: per label their number, and how many got a valid answer."""
    plays = training.materialise(training.with_split(prepare_class(data.history(spark, sf))))
    train, test = training.train_test(plays.filter(f"{label} is not null"))
    scored = training.apply_model(fit(train), test, "p")
    return scored.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("support"), F.count_if(F.col("p").isin(0.0, 1.0, 2.0)).alias("answered"))


def _stage_sql(label: str) -> str:
    return f"""select {label} as label, count(*) as support, count(*) as answered from ({CLASS_FEATURES_SQL}) t
 where {label} is not null and class_5 is not null and not {TRAIN_SQL} group by {label}"""


@query("ml_runpass", _stage_sql("is_pass"))
def q_ml_runpass(spark, sf):
    return _stage(spark, sf, training.train_run_pass, "is_pass")


@query("ml_runtype", _stage_sql("run_type"))
def q_ml_runtype(spark, sf):
    return _stage(spark, sf, training.train_run_type, "run_type")


@query("ml_passtype", _stage_sql("pass_type"))
def q_ml_passtype(spark, sf):
    return _stage(spark, sf, training.train_pass_type, "pass_type")


@query("hier_predict", f"""select class_5 as class, count(*) as support, true as sound from ({CLASS_FEATURES_SQL}) t
 where class_5 is not null and not {TRAIN_SQL} group by class_5""")
def q_hier_predict(spark, sf):
    """The three stages, saved as a set and loaded again, on the test plays."""
    path = new_dir(spark, "classifier")
    models, report = training.train_classifier(data.history(spark, sf))
    training.save_set(spark, models, path, training.CLASS_LABELS)
    again, labels = training.load_set(spark, path)
    plays = prepare_class(data.history(spark, sf))
    same = (training.predict_class(again, plays).select("game_id", "play_id", "predicted_class")
            .exceptAll(training.predict_class(models, plays).select("game_id", "play_id", "predicted_class")).isEmpty())
    sound = F.col("f1").between(0, 1) & F.lit(same and labels == training.CLASS_LABELS)
    return report.filter("support > 0").select("class", "support", sound.alias("sound"))


@query("ml_pressure", f"""select pressure as class, count(*) as support, true as sound from ({PRESSURE_SQL}) t
 where not {TRAIN_SQL} group by pressure""")
def q_ml_pressure(spark, sf):
    report = training.train_pressure(data.history(spark, sf))[1]
    sound = F.col("auc").between(0.5, 1) & F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)
    return report.filter("support > 0").select(F.col("class").cast("int").alias("class"), "support", sound.alias("sound"))


@query("ml_importance", f"select 'yardline_100' as top, {len(EP_FEATURES)} as features, true as sums_to_one")
def q_ml_importance(spark, sf):
    model = training.load_set(spark, f"{_ep_model(spark, sf)}/models")[0]["ep_pred"]
    rows = training.importance(model, len(EP_FEATURES))
    return rows.agg(F.max_by("feature", "importance").alias("top"), F.count("*").cast("int").alias("features"),
                    (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


@query("ml_score", f"select {KEYS}, down, ydstogo, ep, true as scored {FROM_PLAYS}")
def q_ml_score(spark, sf):
    """Every play scored by a set that was saved and loaded again; its own columns stay as they were."""
    models, _ = training.load_set(spark, f"{_ep_model(spark, sf)}/models")
    return training.apply_models(models, data.history(spark, sf)).select(
        "game_id", "play_id", "down", "ydstogo", "ep", F.col("ep_pred").isNotNull().alias("scored"))
