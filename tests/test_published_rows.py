"""The published per-subject predictions, replayed through the metrics and the comparison."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import compare as C, evaluate as E
from panelspark.plans.jobs import job_comparison
from tests.conftest import make_panel

# The 43 published rows in their order: group, label, text prediction, boosted
# prediction, boosted score, joint prediction, joint score.
ROWS = [
    ("Converted", 1, 0, 0, 0.003178946, 0, 0.31753775),
    ("Converted", 1, 0, 0, 0.023926409, 0, 0.27779543),
    ("Converted", 1, 0, 0, 0.006151826, 0, 0.29530102),
    ("Demented", 1, 1, 1, 0.61422753, 1, 0.60203147),
    ("Converted", 0, 1, 1, 0.54010594, 1, 0.56513375),
    ("Nondemented", 0, 0, 0, 0.010583523, 0, 0.33465162),
    ("Demented", 0, 1, 1, 0.9179599, 0, 0.48661307),
    ("Nondemented", 0, 0, 0, 0.011399575, 0, 0.39662248),
    ("Demented", 1, 0, 0, 0.04137446, 1, 0.60972345),
    ("Nondemented", 0, 0, 0, 0.015276723, 0, 0.475779),
    ("Nondemented", 0, 0, 0, 0.013277142, 0, 0.32520327),
    ("Demented", 0, 0, 0, 0.07944275, 1, 0.56499076),
    ("Nondemented", 0, 0, 0, 0.013480573, 0, 0.39334497),
    ("Demented", 0, 1, 0, 0.39425477, 1, 0.58177906),
    ("Nondemented", 0, 0, 0, 0.008634099, 0, 0.3701982),
    ("Converted", 0, 1, 0, 0.027120695, 0, 0.3801553),
    ("Converted", 1, 1, 0, 0.45689884, 1, 0.5269027),
    ("Nondemented", 0, 0, 0, 0.008829572, 0, 0.30550808),
    ("Demented", 0, 1, 0, 0.25930578, 0, 0.35063487),
    ("Converted", 0, 1, 0, 0.03080701, 0, 0.4442278),
    ("Demented", 1, 1, 1, 0.7568845, 1, 0.65700155),
    ("Demented", 0, 1, 1, 0.53705776, 1, 0.5721439),
    ("Demented", 0, 0, 0, 0.042065434, 1, 0.5779528),
    ("Demented", 1, 0, 1, 0.6262511, 1, 0.5601351),
    ("Demented", 0, 1, 0, 0.4097611, 1, 0.5360729),
    ("Demented", 0, 0, 0, 0.039403625, 1, 0.58364475),
    ("Converted", 1, 1, 1, 0.6879197, 0, 0.44729272),
    ("Demented", 0, 0, 0, 0.12441446, 1, 0.6421878),
    ("Nondemented", 0, 0, 0, 0.001646861, 0, 0.28249124),
    ("Converted", 1, 1, 1, 0.90462464, 1, 0.52752614),
    ("Nondemented", 0, 0, 0, 0.102006495, 1, 0.5079185),
    ("Converted", 1, 1, 0, 0.41521022, 0, 0.46057692),
    ("Nondemented", 0, 0, 0, 0.09297307, 0, 0.32346573),
    ("Nondemented", 0, 0, 0, 0.021036616, 0, 0.39959553),
    ("Demented", 0, 0, 0, 0.29676566, 0, 0.46916613),
    ("Nondemented", 0, 0, 0, 0.0032955362, 0, 0.39331913),
    ("Nondemented", 0, 0, 0, 0.0025159603, 0, 0.2918816),
    ("Nondemented", 0, 0, 0, 0.0012934518, 0, 0.28039363),
    ("Nondemented", 0, 0, 0, 0.013972229, 0, 0.37912527),
    ("Nondemented", 0, 0, 0, 0.004673373, 0, 0.30912927),
    ("Demented", 0, 1, 0, 0.21308918, 0, 0.47873783),
    ("Nondemented", 0, 0, 0, 0.005300942, 0, 0.34844244),
    ("Nondemented", 0, 0, 1, 0.69334006, 0, 0.37736055),
]


@pytest.fixture(scope="module")
def predictions(spark):
    long = []
    for i, (group, y, text, boosted, boosted_score, joint, joint_score) in enumerate(ROWS):
        for model, yhat, score in (("text", text, float(text)), ("boosted", boosted, boosted_score), ("joint", joint, joint_score)):
            long.append((model, f"p{i:02d}", group, y, yhat, score))
    return spark.createDataFrame(long, "model string, subject_id string, participant_group string, y int, yhat int, score double")


def by_model(df):
    return {r["model"]: r for r in df.collect()}


def test_counts_and_auc(predictions):
    want = {"text": (6, 9, 23, 5, 0.6321022727), "boosted": (5, 4, 28, 6, 0.7102272727), "joint": (6, 9, 23, 5, 0.6051136364)}
    got, cm, auc, trap = (by_model(f(predictions)) for f in (E.classification_metrics, E.confusion_matrix, E.auc_roc, E.roc_auc_trapezoid))
    for m, (tp, fp, tn, fn, area) in want.items():
        for row in (got[m], cm[m]):
            assert (row.true_positives, row.false_positives, row.true_negatives, row.false_negatives) == (tp, fp, tn, fn)
        assert auc[m].auc_roc == pytest.approx(area, abs=1e-9) and trap[m].auc_trapezoid == pytest.approx(area, abs=1e-9)
        assert got[m].auc_roc == pytest.approx(area, abs=1e-6)
    table = by_model(E.metrics_summary(predictions))
    assert [table["boosted"][c] for c in ("auc_roc", "accuracy", "sensitivity", "specificity", "f1")] == [0.71, 0.767, 0.455, 0.875, 0.5]
    assert [table["text"][c] for c in ("auc_roc", "accuracy", "sensitivity", "specificity", "f1")] == [0.632, 0.674, 0.545, 0.719, 0.462]
    assert [table["joint"][c] for c in ("auc_roc", "accuracy", "sensitivity", "specificity", "f1")] == [0.605, 0.674, 0.545, 0.719, 0.462]


def test_roc_steps_span_the_unit_square(predictions):
    pts = E.roc_points(predictions).collect()
    for m in ("text", "boosted", "joint"):
        own = sorted((r.fpr, r.tpr) for r in pts if r["model"] == m)
        assert own[0] == (0.0, 0.0) and own[-1] == (1.0, 1.0)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(own, own[1:]))
        assert area == pytest.approx(by_model(E.auc_roc(predictions))[m].auc_roc, abs=1e-9)
    labels = {r.label for r in E.roc_curve_table(predictions).collect()}
    assert labels == {"text (AUC = 0.632)", "boosted (AUC = 0.710)", "joint (AUC = 0.605)"}


def test_comparison(spark, predictions):
    cmp = C.compare_predictions(predictions)
    notes = {r.note: r.n for r in C.comparison_notes(cmp).groupBy("note").agg(F.count("*").alias("n")).collect()}
    assert notes == {"all models wrong": 5, "text wrong, others right": 5, "models disagree on positive case": 4, "": 29}
    assert C.false_alarms(cmp).count() == 15 and C.disagreements_on_positives(cmp).count() == 5
    assert C.positive_cases(cmp).count() == 11 and C.negative_cases(cmp).count() == 32
    assert C.all_models_missed(cmp).count() == sum(r[1] == 1 and r[2] + r[3] + r[5] == 0 for r in ROWS)
    groups = {r.participant_group: (r.n, r.n_correct) for r in E.accuracy_by_group(predictions, "text").collect() if not r.is_total}
    assert groups == {g: (sum(r[0] == g for r in ROWS), sum(r[0] == g and r[1] == r[2] for r in ROWS)) for g in {r[0] for r in ROWS}}


def test_comparison_job(spark, predictions):
    panel = make_panel(spark, [("p00", v, 0.0, "Converted", 30.0) for v in (1, 2, 3)])
    res = job_comparison(predictions, panel)
    assert res["comparison"].count() == 43 and res["false_alarms"].count() == 15
    rows = res["positive_trajectories"].collect()
    assert sum(r.no_raw_data for r in rows) == 10 and sum(r.subject_id == "p00" for r in rows) == 3

