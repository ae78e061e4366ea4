"""Split exactness and evaluation rules."""

import math

from pyspark.sql import functions as F

from panelspark.operators import evaluate as ev
from panelspark.operators import split as spl


def _features(spark, n=2000):
    return spark.range(n).select(
        F.format_string("S%05d", F.col("id")).alias("subject_id"),
        F.when(F.col("id") % 10 < 2, "Converted").when(F.col("id") % 10 < 6, "Demented").otherwise("Nondemented").alias("participant_group"),
        (F.col("id") % 3 == 0).cast("int").alias("cdr_worsened_after_v2"),
        (F.col("id") % 7 != 0).alias("synthetic"))


def test_split_exact_disjoint_complete(spark):
    f = _features(spark)
    s = spl.train_test_split(f)
    rows = s.collect()
    assert len(rows) == 2000 and len({r["subject_id"] for r in rows}) == 2000
    forced = [r for r in rows if not r["synthetic"] and r["cdr_worsened_after_v2"] == 1]
    assert all(r["split"] == "test" for r in forced)
    rest = [r for r in rows if not (not r["synthetic"] and r["cdr_worsened_after_v2"] == 1)]
    n_test = sum(r["split"] == "test" for r in rest)
    assert n_test == math.ceil(0.2 * len(rest))


def test_split_stable_under_repartition(spark):
    f = _features(spark)
    a = {r["subject_id"]: r["split"] for r in spl.train_test_split(f).collect()}
    b = {r["subject_id"]: r["split"] for r in spl.train_test_split(f.repartition(13)).collect()}
    assert a == b


def test_quota_largest_remainder(spark):
    counts = spark.createDataFrame([("A", 18), ("B", 15), ("C", 7)], "participant_group string, n long")
    q = {r["participant_group"]: r["quota"] for r in spl.stratum_quotas(counts, "participant_group", 0.2).collect()}
    assert sum(q.values()) == math.ceil(0.2 * 40)


def _pred(spark, rows):
    return spark.createDataFrame([("m", f"s{i}", "g", y, int(s >= 0.5), float(s)) for i, (y, s) in enumerate(rows)],
                                 "model string, subject_id string, participant_group string, y int, yhat int, score double")


def test_auc_ties(spark):
    p = _pred(spark, [(1, .9), (0, .9), (1, .2), (0, .1)])
    assert ev.auc_roc(p).first()["auc_roc"] == 0.625
    assert abs(ev.roc_auc_trapezoid(p).first()["auc_trapezoid"] - 0.625) < 1e-12


def test_single_class_metrics(spark):
    m = ev.classification_metrics(_pred(spark, [(0, .9), (0, .1)])).first()
    assert m["sensitivity"] == 0.0 and m["f1"] == 0.0 and m["auc_roc"] is None


def test_auc_matches_evaluator_many_buckets(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.range(5000).select(
        F.lit("m").alias("model"), F.col("id").cast("string").alias("subject_id"), F.lit("g").alias("participant_group"),
        (F.rand(3) < 0.4).cast("int").alias("y"))
    df = df.withColumn("score", F.round(F.rand(5) * 0.5 + F.col("y") * 0.3, 3)).withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    ours = ev.auc_roc(df, bucket_rows=7).first()["auc_roc"]
    trap = ev.roc_auc_trapezoid(df, bucket_rows=7).first()["auc_trapezoid"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(
        df.withColumn("y", F.col("y").cast("double")))
    assert abs(ours - ref) < 1e-9 and abs(trap - ref) < 1e-9


def test_roc_points_drop_collinear(spark):
    # scores .9 .8 .7 each with one positive: the middle point is collinear
    p = _pred(spark, [(1, .9), (1, .8), (1, .7), (0, .1)])
    pts = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(p).collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_bounded_broadcast_fallback(spark):
    from panelspark.operators.small import bounded
    df = spark.range(10)
    assert bounded(df, 100).count() == 10
    assert bounded(df, 5) is df          # above the bound: no hint, the planner decides


def test_positive_trajectories_flag_missing_raw_data(spark):
    from panelspark.operators import compare as cmpo
    from tests.conftest import make_panel
    cmp = spark.createDataFrame(
        [("a", "N", 1, 1, 0.9, 0, 0.2, 1, 0.8), ("ghost", "N", 1, 0, 0.0, 1, 0.7, 0, 0.1), ("b", "N", 0, 0, 0.0, 0, 0.1, 0, 0.2)],
        "subject_id string, participant_group string, cdr_worsened_after_v2 int, text_prediction int, text_score double, "
        "boosted_prediction int, boosted_score double, joint_prediction int, joint_score double")
    panel = make_panel(spark, [("a", 1, 0.0, "N", 29.0), ("a", 2, 0.0, "N", 27.0), ("a", 3, 0.5, "N", 25.0)])
    rows = cmpo.positive_case_trajectories(cmp, panel).collect()
    ghost = [r for r in rows if r["subject_id"] == "ghost"]
    assert len(ghost) == 1 and ghost[0]["no_raw_data"] and ghost[0]["visit"] is None
    a = sorted((r for r in rows if r["subject_id"] == "a"), key=lambda r: r["visit"])
    assert [r["after_cutoff"] for r in a] == [False, False, True] and a[0]["min_mmse"] == 25.0
    assert a[0]["text_mark"] == "✓" and a[0]["boosted_mark"] == "✗"


def test_hard_label_auc_is_mean_of_sensitivity_and_specificity(spark):
    rows = [(1, 1), (1, 0), (1, 1), (0, 0), (0, 1), (0, 0), (0, 0)]
    p = _pred(spark, [(y, float(h)) for y, h in rows])
    m = ev.classification_metrics(p).first()
    assert abs(m["auc_roc"] - (m["sensitivity"] + m["specificity"]) / 2) < 1e-6


def test_null_stratum_is_its_own_stratum(spark):
    f = _features(spark, 500).withColumn(
        "participant_group", F.when(F.col("subject_id") < "S00100", F.lit(None)).otherwise(F.col("participant_group")))
    s = spl.stratified_split(f, 0.2, "participant_group", None, salt="t")
    rows = s.collect()
    assert len(rows) == 500
    nulls = [r for r in rows if r["participant_group"] is None]
    assert len(nulls) == 100 and 15 <= sum(r["split"] == "test" for r in nulls) <= 25
    assert sum(r["split"] == "test" for r in rows) == 100
