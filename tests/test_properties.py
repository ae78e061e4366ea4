"""Property tests against brute force on small random inputs."""

import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from panelspark.operators import evaluate as ev
from panelspark.operators import split as spl
from panelspark.operators.ranking import positions

SETTINGS = settings(max_examples=8, deadline=None)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=5), st.floats(0.05, 0.5))
def test_quotas_exact(spark, sizes, frac):
    counts = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(sizes) if n > 0] or [("g0", 1)],
                                   "participant_group string, n long")
    total = sum(r["n"] for r in counts.collect())
    q = {r["participant_group"]: r["quota"] for r in spl.stratum_quotas(counts, "participant_group", frac).collect()}
    n_test = math.ceil(frac * total)
    assert sum(q.values()) == n_test
    for r in counts.collect():
        exact = r["n"] * (total - n_test) / total
        assert abs((r["n"] - q[r["participant_group"]]) - exact) < 1 + 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60))
def test_auc_brute_force(spark, pairs):
    rows = [("m", f"s{i}", "g", y, int(s >= 3), s / 6.0) for i, (y, s) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "model string, subject_id string, participant_group string, y int, yhat int, score double")
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    got = ev.auc_roc(df, bucket_rows=2).first()["auc_roc"]
    if not pos or not neg:
        assert got is None
        return
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-12


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(1, 30)),
                          st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=80),
       st.sampled_from([1, 2, 3, 1024]))
def test_positions_equal_a_plain_window(spark, rows, width):
    """Any bucket width; NULL subjects, NULL visits, NULL carried values and duplicate visits."""
    data = [(None if s is None else f"s{s}", v, f"id{i:03d}", val) for i, (s, v, val) in enumerate(rows)]
    df = spark.createDataFrame(data, "subject_id string, visit int, visit_id string, val int")
    ours = positions(df, ["subject_id"], "visit", ["visit_id"], F.floor(F.col("visit") / width), carry=["val"])
    w = Window.partitionBy("subject_id").orderBy("visit", "visit_id")
    ref = df.select("visit_id", F.row_number().over(w).cast("long").alias("position"), F.lag("val").over(w).alias("prev_val"))
    a = {r["visit_id"]: (r["position"], r["prev_val"]) for r in ours.collect()}
    b = {r["visit_id"]: (r["position"], r["prev_val"]) for r in ref.collect()}
    assert a == b


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.floats(-50, 50, allow_nan=False))),
                min_size=1, max_size=120),
       st.lists(st.floats(0, 1), min_size=1, max_size=3), st.sampled_from([1, 5, 65536]))
def test_exact_quantiles_equal_percentile(spark, rows, probs, bucket_rows):
    from panelspark.operators.ranking import exact_quantiles
    df = spark.createDataFrame(rows, "g int, x double")
    ref = sorted(map(tuple, df.where("x IS NOT NULL").groupBy("g").agg(
        *[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate(probs)]).collect()), key=repr)
    assert sorted(map(tuple, exact_quantiles(df, ["g"], "x", probs, bucket_rows).collect()), key=repr) == ref
