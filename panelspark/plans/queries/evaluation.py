"""Evaluation and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import oracle as O
from panelspark.plans.queries.common import (
    PRED, panel, predictions, query, sql,
)
from panelspark.session import stored
from panelspark.operators import compare as cmpo
from panelspark.operators import evaluate as ev
from panelspark.operators import scoresketch as sk


# ── evaluation (A15-A18, W4, W5, U3, C2, C10, M7, M8, P11) ───────────────────


POINTS_CTE = """
sc_ AS (SELECT model, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
        FROM predictions WHERE score IS NOT NULL GROUP BY model, score),
pt_ AS (SELECT model, score, pos, neg,
               coalesce(sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pa,
               coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na,
               lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS np_,
               lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nn_,
               sum(pos) OVER (PARTITION BY model) AS P_, sum(neg) OVER (PARTITION BY model) AS N_
        FROM sc_),
roc_ AS (SELECT model, NULL::double AS threshold, 0.0::double AS fpr, 0.0::double AS tpr FROM (SELECT DISTINCT model FROM sc_)
         UNION ALL
         SELECT model, score, (na + neg) / N_::double, (pa + pos) / P_::double FROM pt_
         WHERE (pa = 0 AND na = 0) OR np_ IS NULL OR NOT (np_ = pos AND nn_ = neg)),
trap_ AS (SELECT model, sum((fpr - pf) * (tpr + pt) / 2) AS auc_trapezoid
          FROM (SELECT *, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM roc_
                WINDOW w AS (PARTITION BY model ORDER BY threshold DESC NULLS FIRST))
          GROUP BY model),
auc_ AS (SELECT model, round(sum(neg * (pa + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM pt_ GROUP BY model),
cm_ AS (SELECT model, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS true_negatives,
               count(*) FILTER (WHERE y = 0 AND yhat = 1) AS false_positives,
               count(*) FILTER (WHERE y = 1 AND yhat = 0) AS false_negatives,
               count(*) FILTER (WHERE y = 1 AND yhat = 1) AS true_positives FROM predictions GROUP BY model),
met_ AS (SELECT model,
                CASE WHEN true_positives + true_negatives + false_positives + false_negatives = 0 THEN 0.0
                     ELSE (true_positives + true_negatives)::double / (true_positives + true_negatives + false_positives + false_negatives)::double END AS accuracy,
                CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0.0
                     ELSE (2 * true_positives)::double / (2 * true_positives + false_positives + false_negatives)::double END AS f1,
                CASE WHEN true_positives + false_negatives = 0 THEN 0.0
                     ELSE true_positives::double / (true_positives + false_negatives)::double END AS sensitivity,
                CASE WHEN true_negatives + false_positives = 0 THEN 0.0
                     ELSE true_negatives::double / (true_negatives + false_positives)::double END AS specificity,
                true_positives, false_positives, true_negatives, false_negatives, auc_roc
         FROM cm_ LEFT JOIN auc_ USING (model))"""
EVAL = PRED + [POINTS_CTE]


@query("confusion_matrix", sql(*EVAL, body="SELECT * FROM cm_"))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(predictions(spark, sf))


@query("auc_roc", sql(*EVAL, body="SELECT * FROM auc_"))
def q_auc_roc(spark, sf):
    return ev.auc_roc(predictions(spark, sf)).select("model", F.round("auc_roc", 6).alias("auc_roc"))


@query("roc_points", sql(*EVAL, body="SELECT * FROM roc_"))
def q_roc_points(spark, sf):
    return ev.roc_points(predictions(spark, sf))


@query("roc_auc_trapezoid", sql(*EVAL, body="SELECT model, round(auc_trapezoid, 6) AS auc_trapezoid FROM trap_"))
def q_roc_auc_trapezoid(spark, sf):
    return ev.roc_auc_trapezoid(predictions(spark, sf)).select("model", F.round("auc_trapezoid", 6).alias("auc_trapezoid"))


@query("classification_metrics", sql(*EVAL, body="SELECT * FROM met_"))
def q_classification_metrics(spark, sf):
    return ev.classification_metrics(predictions(spark, sf))


@query("union_metrics", sql(*EVAL, body="SELECT * FROM met_"))
def q_union_metrics(spark, sf):
    # hard-label model scored by its labels (score = yhat in the binding), all models in one aggregate
    p = predictions(spark, sf)
    p = p.withColumn("score", F.when(F.col("model") == "text", F.col("yhat").cast("double")).otherwise(F.col("score")))
    return ev.classification_metrics(p)


@query("metrics_summary", sql(*EVAL, body="""
SELECT model, round(auc_roc, 3) AS auc_roc, round(accuracy, 3) AS accuracy, round(sensitivity, 3) AS sensitivity,
       round(specificity, 3) AS specificity, round(f1, 3) AS f1 FROM met_"""))
def q_metrics_summary(spark, sf):
    return ev.metrics_summary(predictions(spark, sf))


@query("accuracy_by_group", sql(*PRED, body="""
SELECT participant_group, grouping(participant_group) = 1 AS is_total, count(*) AS n, count(*) FILTER (WHERE yhat = y) AS n_correct,
       count(*) FILTER (WHERE yhat = y) / count(*) AS accuracy
FROM predictions WHERE model = 'text' GROUP BY ROLLUP (participant_group)"""))
def q_accuracy_by_group(spark, sf):
    return ev.accuracy_by_group(predictions(spark, sf), "text")


@query("roc_curve_table", sql(*EVAL, body="""
SELECT r.*, model || ' (AUC = ' || printf('%.3f', auc_trapezoid) || ')' AS label FROM roc_ r JOIN trap_ USING (model)"""))
def q_roc_curve_table(spark, sf):
    return ev.roc_curve_table(predictions(spark, sf))


@query("threshold_labels", sql(*PRED, body="""
SELECT model, subject_id, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS yhat_t FROM predictions"""))
def q_threshold_labels(spark, sf):
    p = predictions(spark, sf).select("model", "subject_id", "score")
    return ev.threshold_labels(p, "score", 0.5, "yhat_t")


@query("weighted_bce", sql(*PRED, body="""
, cw_ AS (SELECT model, count(*) FILTER (WHERE y = 0)::double / count(*) FILTER (WHERE y = 1)::double AS w FROM predictions GROUP BY model),
z_ AS (SELECT p.model, p.y, cw_.w, ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS z
       FROM predictions p JOIN cw_ USING (model))
SELECT model, round(avg(w * y * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + (1 - y) * (greatest(z, 0) + ln(1 + exp(-abs(z))))), 6) AS bce,
       count(*) AS n FROM z_ GROUP BY model"""))
def q_weighted_bce(spark, sf):
    p = predictions(spark, sf)
    cw = p.groupBy("model").agg((F.count_if(F.col("y") == 0).cast("double") / F.count_if(F.col("y") == 1).cast("double")).alias("w"))
    pc = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    from panelspark.operators.small import bounded
    z = p.join(bounded(cw), "model").withColumn("z", F.log(pc / (F.lit(1.0) - pc)))
    return ev.weighted_bce(z, "z", "y", "w")


@query("rounded_scores", sql(*PRED, body="SELECT model, subject_id, participant_group, y, yhat, round(score, 3) AS score FROM predictions"))
def q_rounded_scores(spark, sf):
    return ev.rounded_scores(predictions(spark, sf))


# ── comparison (J2, P8, P9, C1, C3-C5, C8, C9, W7) ───────────────────────────

def _of(model: str, column: str) -> str:
    return f"max({column}) FILTER (WHERE model = '{model}')"


CMP_CTE = f"""
cmp AS (SELECT subject_id, {_of('text', 'participant_group')} AS participant_group, {_of('text', 'y')} AS cdr_worsened_after_v2,
               {_of('text', 'yhat')} AS text_prediction, {_of('text', 'score')} AS text_score,
               {_of('boosted', 'yhat')} AS boosted_prediction, {_of('boosted', 'score')} AS boosted_score,
               {_of('joint', 'yhat')} AS joint_prediction, {_of('joint', 'score')} AS joint_score
        FROM predictions WHERE model IN ('text', 'boosted', 'joint') GROUP BY subject_id HAVING count(DISTINCT model) = 3)"""
CMP = PRED + [CMP_CTE]
CMP_P = [O.PANEL_CTE, O.features_cte("rawfeatures", imputed=False), O.PREDICTIONS_CTE, CMP_CTE]


def comparison(spark, sf):
    return cmpo.compare_predictions(predictions(spark, sf))


@query("compare_predictions", sql(*CMP, body="SELECT * FROM cmp"))
def q_compare_predictions(spark, sf):
    return comparison(spark, sf)


@query("positive_negative_cases", sql(*CMP, body="""
SELECT *, CASE cdr_worsened_after_v2 WHEN 1 THEN 'positive' ELSE 'negative' END AS case_side FROM cmp WHERE cdr_worsened_after_v2 IN (0, 1)"""))
def q_positive_negative_cases(spark, sf):
    """Both sides, each through its own operator."""
    c = stored(comparison(spark, sf), "comparison")
    return cmpo.positive_cases(c).withColumn("case_side", F.lit("positive")) \
        .unionByName(cmpo.negative_cases(c).withColumn("case_side", F.lit("negative")))


@query("all_models_missed", sql(*CMP, body="""
SELECT * FROM cmp WHERE cdr_worsened_after_v2 = 1 AND text_prediction = 0 AND boosted_prediction = 0 AND joint_prediction = 0"""))
def q_all_models_missed(spark, sf):
    return cmpo.all_models_missed(comparison(spark, sf))


@query("comparison_notes", sql(*CMP, body="""
SELECT subject_id, participant_group, cdr_worsened_after_v2, text_prediction, boosted_prediction, joint_prediction,
       CASE WHEN text_prediction <> cdr_worsened_after_v2 AND boosted_prediction <> cdr_worsened_after_v2
                 AND joint_prediction <> cdr_worsened_after_v2 THEN 'all models wrong'
            WHEN text_prediction <> cdr_worsened_after_v2 AND boosted_prediction = cdr_worsened_after_v2
                 AND joint_prediction = cdr_worsened_after_v2 THEN 'text wrong, others right'
            WHEN NOT (text_prediction = boosted_prediction AND boosted_prediction = joint_prediction)
                 AND cdr_worsened_after_v2 = 1 THEN 'models disagree on positive case'
            ELSE '' END AS note
FROM cmp"""))
def q_comparison_notes(spark, sf):
    return cmpo.comparison_notes(comparison(spark, sf))


@query("positive_case_outcomes", sql(*CMP, body="""
SELECT subject_id, participant_group,
       CASE WHEN text_prediction = 1 THEN 'correct' ELSE 'MISSED' END AS text_result,
       CASE WHEN boosted_prediction = 1 THEN 'correct' ELSE 'MISSED' END AS boosted_result,
       CASE WHEN joint_prediction = 1 THEN 'correct' ELSE 'MISSED' END AS joint_result
FROM cmp WHERE cdr_worsened_after_v2 = 1"""))
def q_positive_case_outcomes(spark, sf):
    return cmpo.positive_case_outcomes(comparison(spark, sf))


@query("false_alarms", sql(*CMP, body="""
SELECT subject_id, participant_group,
       concat_ws(', ', CASE WHEN text_prediction = 1 THEN 'text' END, CASE WHEN boosted_prediction = 1 THEN 'boosted' END,
                 CASE WHEN joint_prediction = 1 THEN 'joint' END) AS false_alarm_from
FROM cmp WHERE cdr_worsened_after_v2 = 0 AND (text_prediction = 1 OR boosted_prediction = 1 OR joint_prediction = 1)"""))
def q_false_alarms(spark, sf):
    return cmpo.false_alarms(comparison(spark, sf))


@query("disagreements_on_positives", sql(*CMP, body="""
SELECT subject_id, participant_group, text_prediction, boosted_prediction, joint_prediction FROM cmp
WHERE cdr_worsened_after_v2 = 1 AND NOT (text_prediction = boosted_prediction AND boosted_prediction = joint_prediction)"""))
def q_disagreements_on_positives(spark, sf):
    return cmpo.disagreements_on_positives(comparison(spark, sf))


@query("sorted_by_group", sql(*CMP, body="SELECT * FROM cmp ORDER BY participant_group, subject_id"))
def q_sorted_by_group(spark, sf):
    return cmpo.sorted_by_group(comparison(spark, sf))


@query("positive_case_trajectories", sql(*CMP_P, body="""
, pos_ AS (SELECT subject_id, participant_group, text_prediction, boosted_prediction, joint_prediction FROM cmp WHERE cdr_worsened_after_v2 = 1),
rows_ AS (SELECT subject_id, visit, mmse FROM panel WHERE subject_id IN (SELECT subject_id FROM pos_)),
mins_ AS (SELECT subject_id, min(mmse) AS min_mmse FROM rows_ GROUP BY subject_id)
SELECT p.subject_id, p.participant_group, r.visit, r.mmse, r.visit > 2 AS after_cutoff, m.min_mmse,
       CASE WHEN text_prediction = 1 THEN '✓' ELSE '✗' END AS text_mark,
       CASE WHEN boosted_prediction = 1 THEN '✓' ELSE '✗' END AS boosted_mark,
       CASE WHEN joint_prediction = 1 THEN '✓' ELSE '✗' END AS joint_mark,
       m.min_mmse IS NULL AS no_raw_data
FROM pos_ p LEFT JOIN rows_ r USING (subject_id) LEFT JOIN mins_ m USING (subject_id)"""))
def q_positive_case_trajectories(spark, sf):
    return cmpo.positive_case_trajectories(comparison(spark, sf), panel(spark, sf))


@query("missed_case_signals", sql(*CMP_P, body="""
, m_ AS (SELECT subject_id, participant_group FROM cmp
         WHERE cdr_worsened_after_v2 = 1 AND text_prediction = 0 AND boosted_prediction = 0 AND joint_prediction = 0),
r_ AS (SELECT p.*, m_.participant_group FROM panel p JOIN m_ USING (subject_id))
SELECT subject_id, participant_group, 'mmse' AS signal, visit, mmse AS value, visit > 2 AS after_cutoff, visit IN (1, 2) AS annotated FROM r_
UNION ALL SELECT subject_id, participant_group, 'nwbv', visit, nwbv, visit > 2, visit IN (1, 2) FROM r_
UNION ALL SELECT subject_id, participant_group, 'cdr', visit, cdr, visit > 2, visit IN (1, 2) FROM r_"""))
def q_missed_case_signals(spark, sf):
    return cmpo.missed_case_signals(comparison(spark, sf), panel(spark, sf))


# ── score sketch: W4, C10 and A17 from at most k points ──────────────────────

SKETCH = [*PRED, f"""
bins_ AS (SELECT model, cast(floor(score / {sk.WIDTH!r}::double) AS bigint) AS bin, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
          FROM predictions WHERE score IS NOT NULL GROUP BY ALL),
grp_ AS (SELECT model, (coalesce(sum(pos + neg) OVER (PARTITION BY model ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 64)
                       // sum(pos + neg) OVER (PARTITION BY model) AS g_, bin, pos, neg FROM bins_),
cut_ AS (SELECT model, g_, min(bin) AS low, sum(pos) AS pos, sum(neg) AS neg FROM grp_ GROUP BY model, g_),
acc_ AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pa, coalesce(sum(neg) OVER w, 0) AS na FROM cut_
         WINDOW w AS (PARTITION BY model ORDER BY g_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""]


@query("roc_sketch_points", sql(*SKETCH, body=f"""
SELECT model, NULL::double AS threshold, 0.0::double AS fpr, 0.0::double AS tpr FROM (SELECT DISTINCT model FROM bins_)
UNION ALL SELECT model, low * {sk.WIDTH!r}::double, (na + neg)::double / sum(neg) OVER (PARTITION BY model)::double,
                 (pa + pos)::double / sum(pos) OVER (PARTITION BY model)::double FROM acc_"""))
def q_roc_sketch_points(spark, sf):
    """W4 from a sketch of at most 64 points a model, merged from two halves of the subjects."""
    p = predictions(spark, sf)
    half = F.pmod(F.xxhash64("subject_id"), F.lit(2))
    return sk.sketch_points(sk.merge_sketches(sk.score_sketch(p.where(half == 0)), sk.score_sketch(p.where(half == 1))), 64)


@query("roc_sketch_auc", sql(*SKETCH, body="""
SELECT model, count(*) AS n_points, round(sum(neg * (pa + pos / 2.0)) / (sum(pos) * sum(neg))::double, 6) AS auc_roc,
       round(sum(pos * neg) / 2.0 / (sum(pos) * sum(neg))::double, 6) AS max_error FROM acc_ GROUP BY model"""))
def q_roc_sketch_auc(spark, sf):
    """A17 from the sketch, with its error bound."""
    a = sk.sketch_auc(sk.score_sketch(predictions(spark, sf)), 64)
    return a.select("model", "n_points", F.round("auc_roc", 6).alias("auc_roc"), F.round("max_error", 6).alias("max_error"))
