"""The score sketch against the exact area and points; generator priors fitted on a panel."""

import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import functions as F

from panelspark.operators import augment as aug, evaluate as ev, scoresketch as sk
from panelspark.plans import jobs
from panelspark.spec import GROUP
from tests.conftest import make_panel

DDL = "model string, subject_id string, participant_group string, y int, yhat int, score double"


def _pred(spark, rows):
    return spark.createDataFrame([("m", str(i), None, y, 0, s) for i, (y, s) in enumerate(rows)], DDL)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.floats(-3, 3), st.sampled_from([0.0, 0.5, 1.0]))), min_size=1, max_size=80), st.integers(1, 12))
def test_area_is_within_the_stated_error(spark, rows, k):
    p = _pred(spark, rows)
    got = sk.sketch_auc(sk.score_sketch(p, 2.0 ** -10), k).first()
    exact = ev.auc_roc(p).first().auc_roc
    assert got.n_points <= k and (exact is None) == (got.auc_roc is None)
    if exact is not None:
        assert abs(got.auc_roc - exact) <= got.max_error + 1e-12


def test_many_points_reach_the_exact_area_and_every_point_is_exact(spark):
    rows = [(int((i * 7919) % 101 < 50 + i % 37), (i * 31 % 1000) / 1000) for i in range(3000)]
    p = _pred(spark, rows)
    errors = [sk.sketch_auc(sk.score_sketch(p), k).first().max_error for k in (4, 16, 64, 2000)]
    assert errors == sorted(errors, reverse=True) and errors[2] < 0.01
    exact = ev.auc_roc(p).first().auc_roc
    fine = sk.sketch_auc(sk.score_sketch(p), 3000).first()
    assert abs(fine.auc_roc - exact) < 1e-9                           # one bin a score
    pos = sum(y for y, _ in rows)
    for r in sk.sketch_points(sk.score_sketch(p), 16).where("threshold is not null").collect():
        assert r.tpr == pytest.approx(sum(y for y, s in rows if s >= r.threshold) / pos)
        assert r.fpr == pytest.approx(sum(1 - y for y, s in rows if s >= r.threshold) / (len(rows) - pos))


def test_merging_equals_one_sketch(spark):
    p = _pred(spark, [(i % 3 % 2, (i * 37 % 100) / 99) for i in range(500)] + [(1, None), (0, float("nan"))])
    half = F.col("subject_id").cast("int") % 3
    merged = sk.merge_sketches(*[sk.score_sketch(p.where(half == i)) for i in range(3)])
    whole = sk.score_sketch(p)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect())) and whole.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 500
    one = _pred(spark, [(1, 0.5), (1, 0.25)])
    assert sk.sketch_auc(sk.score_sketch(one)).first().auc_roc is None
    assert sk.sketch_points(sk.score_sketch(one.where("false"))).isEmpty()


def test_fitted_priors_fall_back_to_the_published_ones(spark):
    rows = [("A", 1, 0.5, "Demented", 20.0), ("A", 2, 0.5, "Demented", 18.0), ("B", 1, 1.0, "Demented", 24.0), ("B", 2, 1.0, "Demented", 24.0),
            ("C", 1, None, "Nondemented", None), ("D", 1, 3.0, None, 10.0), ("D", 2, 3.0, None, 11.0)]
    got = {r[GROUP]: r.asDict() for r in aug.fitted_priors(make_panel(spark, rows)).collect()}
    pub = aug.GROUP_PRIORS
    assert set(got) == set(pub)                                        # no row for the NULL group
    d, n, c = got["Demented"], got["Nondemented"], got["Converted"]
    assert d["mmse_v1_mean"] == 22.0 and d["cdr_v1_options"] == [0.5, 1.0] and d["cdr_v1_probs"] == [0.5, 0.5]
    assert d["mmse_annual_delta_mean"] == -1.0 and d["mmse_annual_delta_std"] == pytest.approx(2 ** 0.5, abs=1e-5)
    one = pub["Nondemented"]                                          # one subject, one visit, nothing measured
    assert n["mmse_v1_mean"] == one["mmse_v1_mean"] and n["age_mean"] == 71.0 and n["age_std"] == one["age_std"]
    assert n["mmse_annual_delta_std"] == one["mmse_annual_delta_std"] and n["cdr_v1_options"] == one["cdr_v1_options"]
    assert all(c[f] == pub["Converted"][f] for f in aug.PRIOR_FIELDS)                        # no subject at all
    empty = {r[GROUP]: r.asDict() for r in aug.fitted_priors(make_panel(spark, rows).where("false")).collect()}
    assert all(empty[g][f] == pub[g][f] for g in pub for f in aug.PRIOR_FIELDS)


def test_augment_job_with_fitted_priors(spark):
    real = make_panel(spark, [(f"S{i}", v, 2.0, "Demented", 10.0) for i in range(30) for v in (1, 2, 3)])
    out = jobs.job_augment(real, n=60, fitted=True)
    made = out.where(F.col("synthetic") & (F.col("grp") == "Demented") & (F.col("visit") == 1))
    assert made.count() == 24 and {(r.mmse, r.cdr) for r in made.collect()} == {(10.0, 2.0)}       # no spread in the real rows, none in the generated
