"""Classification metrics, AUC and ROC points over a long prediction table (A15-A18, W4, W5, U3,
C2, C10, M7, M8, P11).

Predictions are long: (model, subject_id, participant_group, y, yhat, score).  Everything is
grouped by ``model``; AUC and ROC need running sums over the distinct scores of a model, done
with bucketed prefix sums so no model's scores meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.exprs import softplus
from panelspark.operators.small import bounded
from panelspark.session import stored

MODEL, Y, YHAT, SCORE = "model", "y", "yhat", "score"


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Tn, fp, fn, tp per model."""
    y, p = F.col(Y), F.col(YHAT)
    return pred.groupBy(MODEL).agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )


def score_table(pred: DataFrame) -> DataFrame:
    """(model, score, y, yhat, n): prediction rows per distinct outcome, written once.  The confusion
    counts, AUC and ROC of all models derive from it, so the predictions run once."""
    return stored(pred.groupBy(MODEL, SCORE, Y, YHAT).agg(F.count(F.lit(1)).alias("n")), "scores")


def _confusion(scores: DataFrame) -> DataFrame:
    def n(y, p):
        return F.coalesce(F.sum(F.when((F.col(Y) == y) & (F.col(YHAT) == p), F.col("n"))), F.lit(0))
    return scores.groupBy(MODEL).agg(n(0, 0).alias("true_negatives"), n(0, 1).alias("false_positives"),
                                     n(1, 0).alias("false_negatives"), n(1, 1).alias("true_positives"))


BUCKET_ROWS = 65536              # distinct scores a running-sum task should hold


def score_points(pred: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return _points(score_table(pred), bucket_rows)


def _points(scores: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per (model, distinct score): pos, neg, and pos_above / neg_above = counts at strictly
    higher scores, plus the (pos, neg) of the next lower distinct score (NULL on the last).

    Ties collapse in the first aggregate (which is also the tie rule of ROC/AUC).  Scores are cut at
    approximate quantiles of all models' distinct scores, into as many buckets as their number asks
    for; a bucket index is monotone in the score, so running sums are (sum over higher buckets) +
    (running sum inside the bucket), and the bucket count does not change the result."""
    def n(y):
        return F.coalesce(F.sum(F.when(F.col(Y) == y, F.col("n"))), F.lit(0))
    d = stored(scores.where(F.col(SCORE).isNotNull()).groupBy(MODEL, SCORE).agg(n(1).alias("pos"), n(0).alias("neg")), "points")
    n_buckets = min(max(-(-d.count() // bucket_rows), 1), 1024)
    cuts = []
    if n_buckets > 1:
        cuts = sorted(set(d.agg(F.percentile_approx(SCORE, [i / n_buckets for i in range(1, n_buckets)], 20 * n_buckets)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda b: b < F.col(SCORE))) if cuts else F.lit(0)
    d = d.withColumn("_b", bucket).withColumn("_k", F.struct(MODEL, "_b"))
    top = F.max_by(F.struct("pos", "neg"), SCORE)
    bt = d.groupBy("_k").agg(F.sum("pos").alias("_bpos"), F.sum("neg").alias("_bneg"), top.alias("_top"))
    wb = Window.partitionBy(f"_k.{MODEL}").orderBy(F.desc("_k._b"))
    above = wb.rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("_k", F.coalesce(F.sum("_bpos").over(above), F.lit(0)).alias("_pa"),
                   F.coalesce(F.sum("_bneg").over(above), F.lit(0)).alias("_na"),
                   F.lead("_top").over(wb).alias("_next_top"))
    j = d.repartition("_k").join(bt.hint("merge"), "_k", "inner")
    wi = Window.partitionBy("_k").orderBy(F.desc(SCORE))
    before = wi.rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.lead(F.struct("pos", "neg")).over(wi)
    return j.select(
        MODEL, SCORE, "pos", "neg",
        (F.col("_pa") + F.coalesce(F.sum("pos").over(before), F.lit(0))).alias("pos_above"),
        (F.col("_na") + F.coalesce(F.sum("neg").over(before), F.lit(0))).alias("neg_above"),
        F.coalesce(nxt, F.col("_next_top")).alias("_next"),
    )


def auc_roc(pred: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Area under the ROC curve per model, ties counted 1/2 (Mann-Whitney form).
    NULL when a model has only one class."""
    return _auc(score_points(pred, bucket_rows))


def _auc(pts: DataFrame) -> DataFrame:
    return pts.groupBy(MODEL).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)),
                     (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc_roc"))


def roc_points(pred: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(model, threshold, fpr, tpr) at each distinct score, descending, collinear points
    dropped (a point is kept if the next point's (pos, neg) step differs), plus the start
    point (threshold NULL, 0, 0)."""
    return _roc(stored(score_points(pred, bucket_rows), "roc-steps"))


def _roc(pts: DataFrame) -> DataFrame:
    tot = pts.groupBy(MODEL).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = pts.join(bounded(tot), MODEL, "inner")        # one row per model
    first = (F.col("pos_above") == 0) & (F.col("neg_above") == 0)
    last = F.col("_next").isNull()
    same = (F.col("_next.pos") == F.col("pos")) & (F.col("_next.neg") == F.col("neg"))
    kept = j.where(first | last | ~same)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    pts_out = kept.select(MODEL, F.col(SCORE).alias("threshold"),
                          F.try_divide(fp.cast("double"), F.col("_N").cast("double")).alias("fpr"),
                          F.try_divide(tp.cast("double"), F.col("_P").cast("double")).alias("tpr"))
    start = tot.select(MODEL, F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts_out)


def roc_auc_trapezoid(pred: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Trapezoid area under the ROC points.  Each distinct score adds the trapezoid between
    its point and the previous one: (neg / N) * (tp_prev + tp) / (2P); dropping collinear points
    does not change the area, so the sum runs over all distinct scores (no ordered pass)."""
    return _trapezoid(score_points(pred, bucket_rows))


def _trapezoid(pts: DataFrame) -> DataFrame:
    return pts.groupBy(MODEL).agg(
        F.try_divide(F.sum(F.col("neg") * (2 * F.col("pos_above") + F.col("pos"))),
                     (2 * F.sum("pos") * F.sum("neg")).cast("double")).alias("auc_trapezoid"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Per model accuracy, F1 (0 if undefined), sensitivity and specificity (0 on an
    empty class), AUC (NULL on a single class) and the four counts."""
    scores = score_table(pred)
    cm = _confusion(scores)
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    m = cm.select(
        MODEL,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        "true_positives", "false_positives", "true_negatives", "false_negatives")
    auc = _auc(_points(scores)).select(MODEL, F.round("auc_roc", 6).alias("auc_roc"))
    # both sides have one row per model
    return m.join(auc, MODEL, "left")


def metrics_summary(pred: DataFrame) -> DataFrame:
    """Model, AUC, accuracy, sensitivity, specificity, F1 to 3 decimals."""
    m = classification_metrics(pred)
    return m.select(MODEL, *[F.round(c, 3).alias(c) for c in ("auc_roc", "accuracy", "sensitivity", "specificity", "f1")])


def accuracy_by_group(pred: DataFrame, model: str | None = "text") -> DataFrame:
    """Correct / total per group, and overall with ``is_total`` true (group NULL), for one model.
    Rows without a group are a group of their own (``is_total`` false)."""
    p = pred.where(F.col(MODEL) == model) if model else pred
    return p.rollup("participant_group").agg(
        (F.grouping("participant_group") == 1).alias("is_total"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(YHAT) == F.col(Y)).alias("n_correct"),
        (F.count_if(F.col(YHAT) == F.col(Y)) / F.count(F.lit(1))).alias("accuracy"))


def roc_curve_table(pred: DataFrame) -> DataFrame:
    """ROC points of every model with 'model (AUC = x.xxx)' labels."""
    pts = stored(score_points(pred), "roc-steps")
    auc = _trapezoid(pts)
    label = F.concat(F.col(MODEL), F.lit(" (AUC = "), F.format_string("%.3f", F.col("auc_trapezoid")), F.lit(")"))
    return _roc(pts).join(bounded(auc.select(MODEL, label.alias("label"))), MODEL, "inner")


def threshold_labels(df: DataFrame, score: str = SCORE, threshold: float = 0.5, out: str = "yhat") -> DataFrame:
    """M8: score >= threshold -> 1."""
    return df.withColumn(out, (F.col(score) >= F.lit(threshold)).cast("int"))


def weighted_bce(df: DataFrame, logit: str, label: str = Y, pos_weight=1.0, by: str | None = MODEL) -> DataFrame:
    """M7: mean of w*y*softplus(-z) + (1-y)*softplus(z) (BCE with logits and a positive weight)."""
    z, y = F.col(logit), F.col(label).cast("double")
    w = F.lit(float(pos_weight)) if isinstance(pos_weight, (int, float)) else F.col(pos_weight)
    loss = w * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(F.round(F.avg(loss), 6).alias("bce"), F.count(F.lit(1)).alias("n"))


def rounded_scores(pred: DataFrame, digits: int = 3) -> DataFrame:
    """Prediction rows with the score rounded."""
    return pred.withColumn(SCORE, F.round(SCORE, digits))
