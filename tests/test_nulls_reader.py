"""NULL ids, NULL groups, and the study reader's missing values, types and columns."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import cohort as coh, evaluate as ev, features as feat, profile as prof, split as spl
from panelspark.sources import io
from panelspark.spec import CSV_HEADER_TO_PANEL, PANEL_SCHEMA
from tests.conftest import make_panel


def _panel(spark):
    rows = [("a", 1, 0.0, "N", 30.0), ("a", 2, 0.0, "N", 29.0), ("a", 3, 0.5, "N", 28.0),
            ("b", 1, 0.0, "D", 27.0), ("b", 2, 0.5, "D", 26.0), ("b", 3, 0.5, "D", 25.0)]
    return make_panel(spark, rows)


def test_null_visit_id_is_a_visit(spark):
    p = _panel(spark)
    nulled = p.withColumn("visit_id", F.when(F.col("subject_id") == "a", F.lit(None)).otherwise(F.col("visit_id")))
    for f in (feat.participant_features, feat.features_wide, feat.worsened_after_cutoff, feat.feature_build_report):
        assert sorted(f(nulled).collect()) == sorted(f(p).collect())
    assert {r.subject_id for r in coh.visit_rows(nulled, 1).collect()} == {"a", "b"}


def test_totals_differ_from_null_groups(spark):
    pred = spark.createDataFrame([("text", "s1", None, 1, 1, 1.0), ("text", "s2", "D", 1, 0, 0.0)],
                                 "model string, subject_id string, participant_group string, y int, yhat int, score double")
    got = {(r.participant_group, r.is_total): r.n for r in ev.accuracy_by_group(pred).collect()}
    assert got == {(None, False): 1, ("D", False): 1, (None, True): 2}
    split = spark.createDataFrame([("train", None, 1), ("train", "D", 0), (None, "D", 0)], "split string, participant_group string, cdr_worsened_after_v2 int")
    got = {(r.split, r.participant_group, r.is_total): r.n for r in spl.split_breakdown(split).collect()}
    assert got == {("train", None, False): 1, ("train", "D", False): 1, ("train", None, True): 2, (None, "D", False): 1, (None, None, True): 1}


def test_encoder_keeps_nulls_and_orders_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("aa",), ("b",)], "sex string")
    got = feat.LabelEncoder("sex", "code").fit(df).transform(df)
    assert {(r.sex, r.code) for r in got.collect()} == {("a", 0), ("aa", 1), ("b", 2), (None, None)}
    assert dict(got.dtypes)["code"] == "int"
    same = feat.LabelEncoder("sex").fit(df).transform(df)
    assert same.columns == ["sex"] and {r.sex for r in same.collect()} == {0, 1, 2, None}


def test_exploration_summary_of_awkward_panels(spark):
    p = _panel(spark).withColumn("grp", F.when(F.col("visit") > 1, F.col("grp")))
    got = prof.exploration_summary(p).first()
    assert (got.n_subjects, got.n_rows, got.group_labels) == (2, 6, "D, N")
    empty = prof.exploration_summary(p.where("false")).first()
    assert (empty.n_subjects, empty.n_rows, empty.group_labels) == (0, 0, "")


def test_outliers_are_the_points_beyond_the_fences(spark):
    rows = [(f"s{i}", 1, 0.0, "N", float(v)) for i, v in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 5, 99])]
    p = make_panel(spark, rows)
    out = prof.baseline_outliers(p, metrics=("mmse",)).collect()
    assert [(r.subject_id, r.value) for r in out] == [("s9", 99.0)]
    assert prof.baseline_box_stats(p, metrics=("mmse",)).first().n_outliers == 1


HEADER = list(CSV_HEADER_TO_PANEL)[:len(PANEL_SCHEMA.fields)]
ROW = ["S1", "S1_1", "N", "1", "0", "F", "R", "70", "12", "2", "30", "0.5", "1500", "0.7", "0.95"]


def _csv(tmp_path, header, *rows):
    path = tmp_path / "panel.csv"
    path.write_text("\n".join(",".join(r) for r in [header, *rows]) + "\n")
    return str(path)


@pytest.mark.parametrize("token", io.MISSING_TOKENS + [" NA "])
def test_missing_value_tokens(spark, tmp_path, token):
    row = list(ROW)
    for name in ("MMSE", "Age", "Group"):
        row[HEADER.index(name)] = token
    got = io.read_panel(spark, _csv(tmp_path, [f" {h} " for h in HEADER], row)).first()
    assert (got.mmse, got.age, got.grp) == (None, None, None) and (got.visit, got.cdr) == (1, 0.5)


def test_extra_missing_and_unreadable_columns(spark, tmp_path):
    got = io.read_panel(spark, _csv(tmp_path, [*HEADER, "Site", "synthetic"], [*ROW, "Oslo", "true"], [*ROW[:7], "71.0", *ROW[8:], "", "false"]))
    assert got.columns == [f.name for f in PANEL_SCHEMA.fields] + ["synthetic", "Site"]
    assert [(r.age, r.Site, r.synthetic) for r in got.orderBy("age").collect()] == [(70, "Oslo", True), (71, None, False)]
    with pytest.raises(ValueError, match="asf"):
        io.read_panel(spark, _csv(tmp_path, HEADER[:-1], ROW[:-1]))
    for bad in ("7x", "70.5", "1e30"):
        with pytest.raises(Exception, match="age: cannot read"):
            io.read_panel(spark, _csv(tmp_path, HEADER, [*ROW[:7], bad, *ROW[8:]])).collect()
