"""Model-side queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelspark.plans import oracle as O
from panelspark.plans.queries.common import (
    BASE, PANEL_ONLY, TRAIN, features, panel, query, split_features, sql, train_test,
)
from panelspark.models import boosted as bst
from panelspark.models import jointembed as je
from panelspark.operators import evaluate as ev
from panelspark.operators import features as feat
from panelspark.operators import split as spl
from panelspark.session import checkpoint_dir, stored
from panelspark.spec import LABEL


# ── model side (A13, A14, F6-F9, P5, P6, M1-M6) ──────────────────────────────


@query("class_weight", sql(*TRAIN, body="""
SELECT count(*) FILTER (WHERE cdr_worsened_after_v2 = 0) AS n_negative, count(*) FILTER (WHERE cdr_worsened_after_v2 = 1) AS n_positive,
       count(*) FILTER (WHERE cdr_worsened_after_v2 = 0)::double / count(*) FILTER (WHERE cdr_worsened_after_v2 = 1)::double AS class_weight
FROM train_"""))
def q_class_weight(spark, sf):
    return feat.class_weight(train_test(spark, sf)[0])


MOMENT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}::double), 6) AS mean, round(stddev_samp({c}::double), 6) AS std FROM train_"
    for c in feat.STANDARDISED_COLUMNS)


@query("column_moments", sql(*TRAIN, body=MOMENT_SQL))
def q_column_moments(spark, sf):
    m = feat.column_moments(train_test(spark, sf)[0])
    return m.select(F.col("column").alias("column_name"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("label_encode", sql(*TRAIN, body="""
, codes_ AS (SELECT sex, dense_rank() OVER (ORDER BY sex) - 1 AS sex_encoded FROM (SELECT DISTINCT sex FROM train_ WHERE sex IS NOT NULL))
SELECT s.subject_id, s.sex, c.sex_encoded FROM split1 s JOIN codes_ c USING (sex)"""))
def q_label_encode(spark, sf):
    s = split_features(spark, sf)
    enc = feat.LabelEncoder("sex", "sex_encoded").fit(s.where("split = 'train'"))
    return enc.transform(s).select("subject_id", "sex", F.col("sex_encoded").cast("long").alias("sex_encoded"))


STD_SQL = ", ".join(
    f"round(CASE WHEN (SELECT stddev_samp({c}::double) FROM train_) > 0 THEN ({c}::double - (SELECT avg({c}::double) FROM train_)) / "
    f"(SELECT stddev_samp({c}::double) FROM train_) ELSE {c}::double END, 6) AS {c}" for c in feat.STANDARDISED_COLUMNS)


@query("standardise", sql(*TRAIN, body=f"SELECT subject_id, split, {STD_SQL} FROM split1"))
def q_standardise(spark, sf):
    s = split_features(spark, sf)
    std = feat.Standardiser().fit(s.where("split = 'train'"))
    out = std.transform(s)
    return out.select("subject_id", "split", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in feat.STANDARDISED_COLUMNS])


@query("feature_projection", sql(*BASE, body=f"SELECT subject_id, {', '.join(feat.NUMERIC_FEATURES + ['sex', 'handedness'])}, cdr_worsened_after_v2 FROM features"))
def q_feature_projection(spark, sf):
    return feat.visit_feature_projection(features(spark, sf))


_MOD_ROWS = " UNION ALL ".join(
    f"SELECT subject_id, '{name}' AS modality, {v} AS visit, {i + 1} AS pos, cast({c} AS float) AS value FROM enc_"
    for name, (c1, c2) in feat.MODALITIES.items() for v, cols in ((1, c1), (2, c2)) for i, c in enumerate(cols))


@query("modality_arrays", sql(*BASE, body=f"""
, codes_ AS (SELECT sex, dense_rank() OVER (ORDER BY sex) - 1 AS sex_encoded FROM (SELECT DISTINCT sex FROM features WHERE sex IS NOT NULL)),
enc_ AS (SELECT f.*, c.sex_encoded FROM features f JOIN codes_ c USING (sex))
{_MOD_ROWS}"""))
def q_modality_arrays(spark, sf):
    f = features(spark, sf)
    f = feat.LabelEncoder("sex", "sex_encoded").fit(f).transform(f)
    arr = feat.modality_arrays(f)
    cols = []
    for name in feat.MODALITIES:
        for v in (1, 2):
            cols.append(F.struct(F.lit(name).alias("modality"), F.lit(v).alias("visit"), F.col(f"{name}_v{v}").alias("a")))
    long = arr.select("subject_id", F.explode(F.array(*cols)).alias("m"))
    return long.select("subject_id", "m.modality", "m.visit",
                       F.posexplode("m.a").alias("p", "value")).select(
        "subject_id", "modality", "visit", (F.col("p") + 1).alias("pos"), "value")


@query("trajectory_change_table", sql(*BASE, body="""
SELECT subject_id, participant_group, cast(mmse_v1 AS varchar) || ' -> ' || cast(mmse_v2 AS varchar) AS mmse_change,
       cast(cdr_v1 AS varchar) || ' -> ' || cast(cdr_v2 AS varchar) AS cdr_change,
       cast(nwbv_v1 AS varchar) || ' -> ' || cast(nwbv_v2 AS varchar) AS nwbv_change, cdr_worsened_after_v2
FROM features"""))
def q_trajectory_change_table(spark, sf):
    return feat.trajectory_change_table(features(spark, sf))


@query("delta_inspection", sql(*BASE, body="""
SELECT subject_id, participant_group, mmse_v1, mmse_v2, nwbv_v1, nwbv_v2, cdr_v1, cdr_v2,
       mmse_delta_v1_v2, nwbv_delta_v1_v2, cdr_delta_v1_v2, age_delta_v1_v2, cdr_worsened_after_v2
FROM features"""))
def q_delta_inspection(spark, sf):
    return feat.delta_inspection(features(spark, sf))


@query("feature_build_report", sql(*PANEL_ONLY, O.ROLLUP_CTE.format(src="panel"), body="""
, st_ AS (SELECT s.subject_id,
                 CASE WHEN a.subject_id IS NULL OR b.subject_id IS NULL THEN 'no_v1_or_v2'
                      WHEN f.subject_id IS NULL THEN 'no_followup' ELSE 'included' END AS status,
                 cast(coalesce(f.max_after > b.cdr, false) AS integer) AS y
          FROM subj_ s LEFT JOIN v1_ a USING (subject_id) LEFT JOIN v2_ b USING (subject_id) LEFT JOIN after_ f USING (subject_id))
SELECT status, count(*) AS subjects, count(*) FILTER (WHERE status = 'included' AND y = 1) AS label_1,
       count(*) FILTER (WHERE status = 'included' AND y = 0) AS label_0 FROM st_ GROUP BY status"""))
def q_feature_build_report(spark, sf):
    return feat.feature_build_report(panel(spark, sf))


def boosted_frames(spark, sf):
    """(training rows, test rows) of the split, stored once for the fit and all that reads beside it."""
    s = stored(split_features(spark, sf), "boosted-split")
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def boosted_model(spark, sf, frames=None, **kw):
    """(model, test rows).  The model of the training rows is kept in the shared folder under a key of their content, so the
    queries of one application that ask for the same model fit it once."""
    tr, te = frames or boosted_frames(spark, sf)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/panelspark-{spark.sparkContext.applicationId}/models"
    return bst.fit_boosted_once(tr, folder, **kw), te


@query("boosted_trees_score_rows")
def q_boosted_trees_score_rows(spark, sf):
    """M2: the score and the label of every test subject."""
    model, te = boosted_model(spark, sf)
    return bst.score_boosted(model, te)


@query("feature_importance_rows")
def q_feature_importance_rows(spark, sf):
    """The ten most important features."""
    model, _ = boosted_model(spark, sf)
    return bst.feature_importance_topk(model, 10)


@query("boosted_trees_score", sql(*TRAIN, body="""
SELECT count(*) AS n_scored, true AS in_range, true AS labels_match, true AS better_than_chance FROM test_"""))
def q_boosted_trees_score(spark, sf):
    """M2, as facts that hold for any right model: every test row is scored, the scores are
    probabilities, the hard label follows from them, and the AUC is well above chance."""
    model, te = boosted_model(spark, sf)
    pred = stored(bst.score_boosted(model, te), "boosted-scores")
    facts = pred.agg(F.count(F.lit(1)).alias("n_scored"),
                     F.coalesce(F.bool_and(F.col("score").between(0.0, 1.0)), F.lit(True)).alias("in_range"),
                     F.coalesce(F.bool_and((F.col("score") > 0.5).cast("int") == F.col("yhat")), F.lit(True)).alias("labels_match"))
    auc = ev.auc_roc(pred).agg(F.coalesce(F.min("auc_roc") > 0.6, F.lit(True)).alias("better_than_chance"))
    return facts.withColumn("k", F.lit(1)).join(auc.withColumn("k", F.lit(1)), "k").drop("k")      # one row each


@query("feature_importance_topk", sql(*TRAIN, body="""
SELECT cast(10 AS bigint) AS n_features, true AS known, true AS descending, true AS shares, true AS none_of_constants,
       count(*) AS n_train, count(*) FILTER (WHERE cdr_worsened_after_v2 = 1) AS n_positive FROM train_"""))
def q_feature_importance_topk(spark, sf):
    """W6, as facts: ten known features in descending order with shares between 0 and 1, nothing for a feature that is the
    same in all training rows, and how many rows the model has seen."""
    frames = boosted_frames(spark, sf)
    model, _ = boosted_model(spark, sf, frames)
    tr = frames[0]
    top = bst.feature_importance_topk(model, 10)
    seen = tr.agg(F.count(F.lit(1)).alias("n_train"), F.count_if(F.col(LABEL) == 1).alias("n_positive"),
                  *[F.approx_count_distinct(c).alias(f"d_{c}") for c in feat.NUMERIC_FEATURES]).first()
    constant = [c for c in feat.NUMERIC_FEATURES if seen[f"d_{c}"] <= 1]
    top = top.withColumn("n_train", F.lit(seen["n_train"]).cast("long")).withColumn("n_positive", F.lit(seen["n_positive"]).cast("long"))
    return top.groupBy("n_train", "n_positive").agg(F.coalesce(F.bool_and(~F.col("feature").isin(constant) | (F.col("importance") == 0)), F.lit(True)).alias("none_of_constants"),
                   F.count(F.lit(1)).alias("n_features"), F.bool_and(F.col("feature").isin(bst.feature_names())).alias("known"),
                   (F.array_sort(F.collect_list(-F.col("importance"))) == F.collect_list(-F.col("importance"))).alias("descending"),
                   (F.bool_and(F.col("importance") >= 0) & (F.sum("importance") <= 1 + 1e-9)).alias("shares"))


def joint_frames(spark, sf):
    """(training, validation, test) rows as the network takes them, and the positive-class weight."""
    s = stored(split_features(spark, sf), "joint-split")                  # read by every fit below
    tr_all, te = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    v = stored(spl.train_validation_split(tr_all), "joint-validation")
    tr, va = v.where("split = 'train'").drop("split"), v.where("split = 'validation'").drop("split")
    w = feat.class_weight_value(tr)
    (trp, [vap, tep]) = je.prepare_features(tr, [va, te])
    return trp, vap, tep, w


def joint_model(spark, sf):
    trp, vap, tep, w = joint_frames(spark, sf)
    return je.JointEmbeddingEstimator().fit(trp, vap, w), tep


@query("joint_embedding_score")
def q_joint_embedding_score(spark, sf):
    model, tep = joint_model(spark, sf)
    return model.transform(tep)


@query("visit_embedding")
def q_visit_embedding(spark, sf):
    """M4 on visits 1 and 2 of every split row, training, validation and test."""
    trp, vap, tep, w = joint_frames(spark, sf)
    model = je.JointEmbeddingEstimator().fit(trp, vap, w)
    rows = reduce(DataFrame.unionByName, [d.select("subject_id", *je.INPUT_COLS) for d in (trp, vap, tep)])
    visits = [model.embeddings(rows, v).select("subject_id", F.lit(v).alias("visit"), "embedding") for v in (1, 2)]
    return visits[0].unionByName(visits[1])
