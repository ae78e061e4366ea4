"""A mergeable sketch of prediction scores: ROC points and area from few points, with a stated error.

The sketch counts positives and negatives in score bins of fixed width, ``floor(score / width)``.  The bins do not
depend on the data, so sketches of parts, days or clusters are merged by adding their counts, and a sketch
is as large as the range of the scores over the width (65,537 rows a model for probabilities), however many
predictions and distinct scores there are.

``sketch_points`` joins neighbouring bins into at most ``k`` groups of about equal weight.  Inside a group the order of
its scores is unknown: its pairs of a positive and a negative add between none and all of them to the area, and the
straight line counts half.  So the area is off by at most ``sum(pos * neg) / (2 P N)`` over the groups, which
``sketch_auc`` returns beside it.  The exact path is ``evaluate.auc_roc`` and ``evaluate.roc_points``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.operators.evaluate import MODEL, SCORE, Y

WIDTH = 2.0 ** -16
POINTS = 256


def score_sketch(pred: DataFrame, width: float = WIDTH) -> DataFrame:
    """(model, bin, pos, neg): counts of both labels in each score bin; rows without a score are left out."""
    b = F.floor(F.col(SCORE) / F.lit(float(width))).cast("long").alias("bin")
    return (pred.where(F.col(SCORE).isNotNull() & ~F.isnan(SCORE)).groupBy(MODEL, b)
            .agg(F.count_if(F.col(Y) == 1).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg")))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows together (the sketches must have one width)."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy(MODEL, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _groups(sketch: DataFrame, k: int) -> DataFrame:
    """(model, low, pos, neg, pos_above, neg_above): at most k groups of neighbouring bins a model."""
    if k < 1:
        raise ValueError("a sketch is cut into one group at least")
    by = Window.partitionBy(MODEL)                                       # a sketch holds a bounded number of bins a model
    higher = by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("pos") + F.col("neg")
    g = sketch.where(weight > 0).withColumn("_before", F.coalesce(F.sum(weight).over(higher), F.lit(0))).withColumn("_all", F.sum(weight).over(by))
    g = g.withColumn("_g", F.call_function("div", F.col("_before") * k, F.col("_all")))
    out = g.groupBy(MODEL, "_g").agg(F.min("bin").alias("low"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy(MODEL).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(MODEL, "low", "pos", "neg", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_above"),
                      F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("neg_above"))


def sketch_points(sketch: DataFrame, k: int = POINTS, width: float = WIDTH) -> DataFrame:
    """(model, threshold, fpr, tpr): at most k points a model and the start point (threshold NULL).

    A point counts the scores from its threshold on, exactly.  NULL rates where a model has one class only."""
    g = _groups(sketch, k)
    all_ = Window.partitionBy(MODEL)
    rate = lambda part, c: F.try_divide((F.col(f"{c}_above") + F.col(c)).cast("double"), part.cast("double"))
    points = g.withColumn("_P", F.sum("pos").over(all_)).withColumn("_N", F.sum("neg").over(all_)).select(
        MODEL, (F.col("low") * F.lit(float(width))).alias("threshold"), rate(F.col("_N"), "neg").alias("fpr"), rate(F.col("_P"), "pos").alias("tpr"))
    start = sketch.select(MODEL).distinct().select(MODEL, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def sketch_auc(sketch: DataFrame, k: int = POINTS) -> DataFrame:
    """(model, n_points, auc_roc, max_error): the area is within ``max_error`` of the exact one.  NULL with one class."""
    pairs = (F.sum("pos") * F.sum("neg")).cast("double")
    return _groups(sketch, k).groupBy(MODEL).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)), pairs).alias("auc_roc"),
        F.try_divide(F.sum(F.col("pos") * F.col("neg")) / 2.0, pairs).alias("max_error"))
