"""Job flows (R1-R7).  Each returns lazy DataFrames (and writes where the step persists output).

Small inputs that are read more than once (splits, predictions) are written once as Parquet into the
shared folder named by ``spark.checkpoint.dir``; the panel itself is read where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.models import boosted as bst
from panelspark.models import jointembed as je
from panelspark.models import textscore
from panelspark.operators import augment as aug
from panelspark.operators import compare as cmpo
from panelspark.operators import evaluate as ev
from panelspark.operators import features as feat
from panelspark.operators import split as spl
from panelspark.operators.exploration import Exploration
from panelspark.session import stored
from panelspark.sources import io


def job_exploration(panel: DataFrame) -> dict[str, DataFrame]:
    """Profile tables of a panel, from two scans of it."""
    return Exploration(panel).tables()


def job_augment(real: DataFrame, n: int | None = None, seed: int = 42, out: str | None = None, fitted: bool = False) -> DataFrame:
    """R2: generate ``n`` subjects (default: as many as real ones) and append them, from the published priors or
    (``fitted``) from the real panel's own."""
    spark = real.sparkSession
    if n is None:
        n = real.select("subject_id").distinct().count()
    priors = stored(aug.fitted_priors(real), "priors") if fitted else None
    combined = aug.union_real_generated(real, aug.generate_panel(spark, n, seed, priors))
    if out:
        io.write_augmented_panel(combined, out)
    return combined


def job_preprocess(panel: DataFrame, out: str | None = None, leakage_free: bool = False) -> DataFrame:
    """Impute -> features + labels -> exact split (-> partitioned write)."""
    extra = ("synthetic",) if "synthetic" in panel.columns else ()
    imputer = feat.GroupMedianImputer()
    if leakage_free:
        s0 = spl.train_test_split(feat.participant_features(panel, extra_static=extra)).select("subject_id", "split")
        imputer.fit(panel.join(s0.where("split = 'train'"), "subject_id", "left_semi"))
    else:
        imputer.fit(panel)
    split = stored(spl.train_test_split(feat.participant_features(panel, extra_static=extra, imputer=imputer)))
    if out:
        io.write_feature_splits(split, out)
    return split


def job_text_scoring(test: DataFrame, factory=textscore.mmse_rule_predictor_factory, **kw) -> dict[str, DataFrame]:
    """Prompt -> predictor -> parse -> accuracy by group."""
    scored = textscore.score_text_batch(test, factory, **kw)
    pred = scored.select(F.lit("text").alias("model"), "subject_id", "participant_group",
                         F.col("cdr_worsened_after_v2").alias("y"), F.col("text_prediction").alias("yhat"),
                         F.col("text_prediction").cast("double").alias("score"))
    return {"scored": scored, "predictions": pred, "accuracy_by_group": ev.accuracy_by_group(pred, "text")}


def _persist_results(res: dict, out: str | None) -> dict:
    """Long predictions partitioned by model, one metrics row per model."""
    if out:
        io.write_predictions(res["predictions"], f"{out.rstrip('/')}/predictions")
        io.write_metrics(res["metrics"], f"{out.rstrip('/')}/metrics")
    return res


def job_boosted(train: DataFrame, test: DataFrame, out: str | None = None, **kw) -> dict:
    """Fit, score, metrics, feature importance."""
    model = bst.fit_boosted(train, **kw)
    pred = bst.score_boosted(model, test)
    return _persist_results({"model": model, "predictions": pred, "metrics": ev.classification_metrics(pred),
                             "importance": bst.feature_importance_topk(model)}, out)


def job_joint_embedding(train_all: DataFrame, test: DataFrame, out: str | None = None, **kw) -> dict:
    """standardise/encode on train, validation cut, fit with early stopping, score, metrics."""
    v = spl.train_validation_split(train_all)
    tr, va = v.where("split = 'train'").drop("split"), v.where("split = 'validation'").drop("split")
    w = feat.class_weight_value(tr)
    trp, (vap, tep) = je.prepare_features(tr, [va, test])
    model = je.JointEmbeddingEstimator(**kw).fit(trp, vap, w)
    pred = model.transform(tep)
    return _persist_results({"model": model, "predictions": pred, "metrics": ev.classification_metrics(pred)}, out)


def job_comparison(pred: DataFrame, panel: DataFrame, models=cmpo.MODELS, out: str | None = None) -> dict[str, DataFrame]:
    """Comparison table, metrics, error analysis, ROC data and trajectories."""
    p = stored(pred)
    cmp = cmpo.compare_predictions(p, models)
    res = {
        "comparison": cmp,
        "metrics": ev.metrics_summary(p),
        "notes": cmpo.comparison_notes(cmp, models),
        "positive_outcomes": cmpo.positive_case_outcomes(cmp, models),
        "false_alarms": cmpo.false_alarms(cmp, models),
        "disagreements": cmpo.disagreements_on_positives(cmp, models),
        "roc": ev.roc_curve_table(p),
        "positive_trajectories": cmpo.positive_case_trajectories(cmp, panel, models),
        "missed_signals": cmpo.missed_case_signals(cmp, panel, models),
    }
    if out:
        io.write_comparison(cmp, out)
    return res
