"""Edge rules of the participant feature row and label (FIXTURES §3)."""

from pyspark.sql import functions as F

from panelspark.operators import features as feat
from tests.conftest import make_panel


def _labels(spark, rows):
    f = feat.participant_features(make_panel(spark, rows))
    return {r["subject_id"]: r for r in f.collect()}


def test_label_rules(spark):
    rows = [
        ("worsens", 1, 0.0, "N", 28.0), ("worsens", 2, 0.0, "N", 28.0), ("worsens", 3, 0.5, "N", 27.0),
        ("back", 1, 0.0, "N", 28.0), ("back", 2, 0.0, "N", 28.0), ("back", 3, 0.5, "N", 28.0), ("back", 4, 0.0, "N", 28.0),
        ("better", 1, 0.5, "D", 25.0), ("better", 2, 1.0, "D", 24.0), ("better", 3, 0.5, "D", 24.0),
        ("two", 1, 0.0, "N", 29.0), ("two", 2, 0.0, "N", 29.0),
        ("gap", 1, 0.0, "N", 29.0), ("gap", 3, 0.5, "N", 29.0),
        ("late", 2, 0.0, "N", 29.0), ("late", 3, 0.0, "N", 29.0),
        ("nullfu", 1, 0.0, "N", 29.0), ("nullfu", 2, 0.0, "N", 29.0), ("nullfu", 3, None, "N", 29.0),
        ("nullv2", 1, 0.0, "N", 29.0), ("nullv2", 2, None, "N", 29.0), ("nullv2", 3, 1.0, "N", 29.0),
        ("override", 1, 0.0, "N", 29.0), ("override", 2, 0.0, "N", 29.0), ("override", 3, 0.0, "Converted", 29.0),
    ]
    got = _labels(spark, rows)
    assert got["worsens"]["cdr_worsened_after_v2"] == 1
    assert got["back"]["cdr_worsened_after_v2"] == 1
    assert got["better"]["cdr_worsened_after_v2"] == 0
    assert got["better"]["cdr_delta_v1_v2"] == 0.5
    for excluded in ("two", "gap", "late"):
        assert excluded not in got
    assert got["nullfu"]["cdr_worsened_after_v2"] == 0
    assert got["nullv2"]["cdr_worsened_after_v2"] == 0
    assert got["override"]["participant_group"] == "Converted"
    assert got["worsens"]["participant_group"] == "N"


def test_build_report_statuses(spark):
    rows = [("two", 1, 0.0, "N", 29.0), ("two", 2, 0.0, "N", 29.0), ("gap", 1, 0.0, "N", 29.0),
            ("gap", 3, 0.5, "N", 29.0), ("ok", 1, 0.0, "N", 29.0), ("ok", 2, 0.0, "N", 29.0), ("ok", 3, 0.5, "N", 29.0)]
    rep = {r["status"]: r for r in feat.feature_build_report(make_panel(spark, rows)).collect()}
    assert rep["no_followup"]["subjects"] == 1
    assert rep["no_v1_or_v2"]["subjects"] == 1
    assert rep["included"]["label_1"] == 1


def test_duplicate_visit_takes_lowest_visit_id(spark):
    p = make_panel(spark, [("d", 1, 0.0, "N", 20.0), ("d", 2, 0.0, "N", 21.0), ("d", 3, 0.0, "N", 22.0)])
    dup = spark.createDataFrame([("d", "d_1_000a", "N", 1, 0, "F", "R", 71, 12, 2.0, 29.0, 0.0, 1500, 0.69, 0.953)], p.schema)
    f = feat.participant_features(p.unionByName(dup)).first()
    # visit ids: 'd_1_000' < 'd_1_000a' -> the first row (MMSE 20) wins
    assert f["mmse_v1"] == 20.0


def test_imputation_rules(spark):
    rows = [("a", 1, 0.0, "D", 28.0), ("a", 2, 0.0, "D", None), ("b", 1, 0.0, "D", 27.0), ("b", 2, 0.0, "D", 29.0),
            ("c", 1, 0.0, None, None), ("x", 1, 0.0, "X", None), ("x", 2, 0.0, "X", None)]
    p = make_panel(spark, rows)
    out = feat.impute_group_median(p, ("mmse",))
    got = {(r["subject_id"], r["visit"]): r["mmse"] for r in out.collect()}
    assert got[("a", 2)] == 28.0          # median of 28, 27, 29
    assert got[("c", 1)] is None          # NULL group stays NULL
    assert got[("x", 1)] is None          # all-NULL group stays NULL


def test_standardise_leaves_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "mmse_v1 double, etiv_v1 double")
    s = feat.Standardiser(["mmse_v1", "etiv_v1"]).fit(df)
    rows = s.transform(df).collect()
    assert [r["etiv_v1"] for r in rows] == [5.0, 5.0]
    assert abs(rows[0]["mmse_v1"] + 0.7071067811865475) < 1e-12


def test_label_encoder_unseen_raises(spark):
    import pytest
    tr = spark.createDataFrame([("F",), ("M",)], "sex string")
    te = spark.createDataFrame([("X",)], "sex string")
    enc = feat.LabelEncoder("sex", "code").fit(tr)
    assert [r["code"] for r in enc.transform(tr).orderBy("sex").collect()] == [0, 1]
    with pytest.raises(Exception):
        enc.transform(te).collect()


def test_class_weight_without_positives_raises(spark):
    import pytest
    df = spark.createDataFrame([(0,), (0,)], "cdr_worsened_after_v2 int")
    with pytest.raises(ValueError):
        feat.class_weight_value(df)
    assert feat.class_weight(df).first()["class_weight"] is None


def test_imputing_the_feature_row_equals_imputing_the_panel(spark):
    from panelspark.operators import features as feat
    rows = [(s, v, 0.5 * (v % 3), g, m) for s, g, ms in [("A", "Demented", [None, 20.0, 21.0]), ("B", "Demented", [24.0, None, None]),
            ("C", "Nondemented", [None, None, 29.0]), ("D", None, [None, 22.0, 23.0]), ("E", "Converted", [None, None, None])] for v, m in enumerate(ms, 1)]
    rows += [("F", 1, 0.0, "Demented", None), ("F", 2, 0.5, "Converted", None), ("F", 3, 1.0, "Demented", 10.0)]
    p = make_panel(spark, rows).withColumn("ses", F.when(F.col("subject_id").isin("A", "C"), F.lit(None).cast("double")).otherwise(F.col("ses")))
    for columns in (("mmse", "ses"), ("mmse",), ("nwbv", "ses")):
        imputer = feat.GroupMedianImputer(columns).fit(p)
        want = feat.participant_features(imputer.transform(p))
        got = feat.participant_features(p, imputer=imputer)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
