"""Text operators, generator invariants, neural-model gradients and model quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import text as txt
from panelspark.models import jointembed as je
from panelspark.operators import augment as aug


def test_parse_responses(spark):
    cases = ["1", " 0\n", "1.", "Answer: 0", "10", "maybe", "", None, "\xa01　"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, text string")
    pred, status = txt.parse_response(F.col("text"))
    got = df.select("i", pred.alias("p"), status.alias("s")).orderBy("i").collect()
    assert [r["p"] for r in got] == [1, 0, 1, 0, 1, 0, 0, 0, 1]
    assert [r["s"] for r in got] == ["clean", "clean", "noisy", "noisy", "noisy", "unparseable", "unparseable",
                                     "missing", "clean"]


def test_prompt_formats_like_python(spark):
    row = dict(age_v1=80, mmse_v1=14.85, cdr_v1=0.5, nwbv_v1=0.7, education_years=12, sex="F", mr_delay_v2=700,
               age_v2=82, mmse_v2=21.1, cdr_v2=1.0, nwbv_v2=0.69, mmse_delta_v1_v2=6.25, nwbv_delta_v1_v2=-0.01,
               cdr_delta_v1_v2=0.5)
    df = spark.createDataFrame([row])
    p = txt.clinical_prompt(df).first()["prompt"]
    assert "- MMSE change: +6.2\n" in p          # Python rounds the exact tie half-even
    assert "- MMSE: 14.85\n" in p and "- Age: 80\n" in p and "(nWBV): 0.7000\n" in p
    assert "- CDR change: +0.5\n" in p and "nWBV change: -0.0100" in p


def test_generator_quotas_and_invariance(spark):
    n = 301
    a = aug.generate_panel(spark, n)
    rows = a.collect()
    subjects = {r["subject_id"]: r["grp"] for r in rows}
    assert len(subjects) == n
    counts = {g: sum(1 for v in subjects.values() if v == g) for g in ("Nondemented", "Demented", "Converted")}
    assert counts == {"Converted": 60, "Demented": 120, "Nondemented": 121}
    assert all(0 <= r["mmse"] <= 30 and 0.6 <= r["nwbv"] <= 0.85 and 60 <= r["age"] for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["subject_id"], []).append(r)
    for sid, vs in per.items():
        n_v = len(vs)
        assert (3 <= n_v <= 5) if subjects[sid] != "Nondemented" else (3 <= n_v <= 4)
        vs.sort(key=lambda r: r["visit"])
        assert vs[0]["mr_delay"] == 0 and all(365 <= b["mr_delay"] - a_["mr_delay"] <= 1460 for a_, b in zip(vs, vs[1:]))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = aug.generate_panel(spark, n).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, b.collect()))


def test_gradient_check():
    rng = np.random.default_rng(0)
    p = je.init_params(1)
    n = 4
    b = {f"{m}_v{v}": rng.normal(size=(n, d)) for m, d in je.MOD_DIMS.items() for v in (1, 2)}
    masks = je.dropout_masks(np.arange(n, dtype=np.uint64) + 5, 0, 0)
    y = np.array([1, 0, 1, 0.0])

    def loss(p):
        z, _ = je.forward(p, b, masks)
        return je.bce_loss_grad(z, y, 2.0)[0].mean()

    z, c = je.forward(p, b, masks)
    g = je.backward(p, c, je.bce_loss_grad(z, y, 2.0)[1] / n)
    for name, _ in je.PARAM_SHAPES:
        i = tuple(rng.integers(0, s) for s in p[name].shape)
        old = p[name][i]
        p[name][i] = old + 1e-6
        up = loss(p)
        p[name][i] = old - 1e-6
        dn = loss(p)
        p[name][i] = old
        num = (up - dn) / 2e-6
        assert abs(num - g[name][i]) <= 1e-5 * max(1.0, abs(num)), name
    assert je.N_PARAMS == 10609


def test_shared_encoder_swaps_with_visits():
    rng = np.random.default_rng(1)
    p = je.init_params(2)
    v1 = [rng.normal(size=(3, d)) for d in je.MOD_DIMS.values()]
    v2 = [rng.normal(size=(3, d)) for d in je.MOD_DIMS.values()]
    e1, _ = je.visit_embedding(p, *v1)
    e2, _ = je.visit_embedding(p, *v2)
    e2b, _ = je.visit_embedding(p, *v2)
    assert e1.shape == (3, 48) and np.allclose(e2, e2b)


def test_joint_embedding_learns_planted_signal(spark):
    from panelspark.operators import evaluate as ev
    cols = {c: F.rand(i).cast("double") for i, c in enumerate(je.INPUT_COLS)}
    base = spark.range(1200).select(F.col("id").cast("string").alias("subject_id"), F.lit("g").alias("participant_group"),
                                    *[v.alias(k) for k, v in cols.items()])
    df = base.withColumn("cdr_worsened_after_v2", (F.col("mmse_v2") - F.col("mmse_v1") < 0).cast("int"))
    tr, va, te = df.where("subject_id % 5 < 3"), df.where("subject_id % 5 = 3"), df.where("subject_id % 5 = 4")
    model = je.JointEmbeddingEstimator(epochs=40, patience=8).fit(tr, va, 1.0)
    auc = ev.auc_roc(model.transform(te)).first()["auc_roc"]
    assert auc > 0.8


def test_state_average_blockwise_equals_collect(spark):
    import pandas as pd
    rng = np.random.default_rng(3)
    rows = [(int(n), 2, float(rng.random()), rng.normal(size=3 * je.N_PARAMS).tobytes()) for n in (5, 9, 2, 11)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["n", "steps", "loss", "state"]))
    a = je.JointEmbeddingEstimator._average(df, parts=4, collect_limit=64)
    b = je.JointEmbeddingEstimator._average(df, parts=4, collect_limit=0, blocks=7)
    assert np.allclose(a[0], b[0], rtol=0, atol=1e-12) and a[1:] == b[1:]


def test_prompt_signed_zero_and_nulls(spark):
    row = dict(age_v1=80, mmse_v1=None, cdr_v1=0.5, nwbv_v1=0.7, education_years=12, sex="F", mr_delay_v2=700,
               age_v2=82, mmse_v2=21.1, cdr_v2=1.0, nwbv_v2=0.69, mmse_delta_v1_v2=-0.04, nwbv_delta_v1_v2=None,
               cdr_delta_v1_v2=0.0)
    df = spark.createDataFrame([row], "age_v1 int, mmse_v1 double, cdr_v1 double, nwbv_v1 double, education_years int, "
                                      "sex string, mr_delay_v2 int, age_v2 int, mmse_v2 double, cdr_v2 double, nwbv_v2 double, "
                                      "mmse_delta_v1_v2 double, nwbv_delta_v1_v2 double, cdr_delta_v1_v2 double")
    p = txt.clinical_prompt(df).first()["prompt"]
    assert "- MMSE change: -0.0\n" in p and "- MMSE: nan\n" in p and "nWBV change: +nan" in p and "CDR change: +0.0" in p


def test_visit_embedding_covers_both_visits_of_all_split_rows(spark, monkeypatch):
    from functools import partial
    from panelspark.plans.queries import models
    from panelspark.plans.queries.common import split_features
    from tests.conftest import SMALL
    monkeypatch.setattr(models.je, "JointEmbeddingEstimator", partial(je.JointEmbeddingEstimator, epochs=1))
    got = models.q_visit_embedding(spark, SMALL).collect()
    subjects = [r.subject_id for r in split_features(spark, SMALL).select("subject_id").collect()]
    assert sorted((r.subject_id, r.visit) for r in got) == sorted((s, v) for s in subjects for v in (1, 2))
    assert all(len(r.embedding) == 48 for r in got)
    by = {(r.subject_id, r.visit): r.embedding for r in got}
    assert any(by[s, 1] != by[s, 2] for s in subjects)


def test_fixed_digits_like_python(spark):
    """Ties, near-ties, carries, signed zeros and large values, digit for digit."""
    import random
    import struct

    from panelspark.functions.text import py_fixed
    rng = random.Random(11)
    xs = [0.0, -0.0, 0.05, 0.15, 0.25, 0.35, 6.25, -6.25, 0.95, 9.95, 0.99995, 0.00005, -0.04, 1e-300, 2.675, 1.005, 123456789.00005, 2.0 ** 52 + 0.5, 4e15 + 0.5]
    xs += [k / 20 for k in range(-200, 200)] + [k / 20000 for k in range(-3000, 3000, 7)] + [rng.uniform(-40, 40) for _ in range(2000)]
    xs += [round(rng.uniform(0, 2), 5) for _ in range(2000)] + [rng.randrange(1 << 40) / 1024 for _ in range(500)]
    near = [struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", abs(x)))[0] + d))[0] for x in xs[4:600] for d in (-1, 1)]
    df = spark.createDataFrame([(x,) for x in xs + [n for n in near if n == n]] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    specs = [(1, True), (4, False), (4, True), (2, False)]
    for r in df.select("x", *[py_fixed(F.col("x"), d, p).alias(f"s{d}{p}") for d, p in specs]).collect():
        for d, p in specs:
            want = format(float("nan") if r.x is None else r.x, f"{'+' if p else ''}.{d}f")
            assert r[f"s{d}{p}"] == want, (r.x, d, p, r[f"s{d}{p}"], want)


def test_partitions_side_by_side_equal_plain_training():
    """Stacked training of several partitions gives each one's own sequential Adam, bit for bit."""
    rng = np.random.default_rng(4)

    def shard(n):
        rows = {f"{m}_v{v}": rng.normal(size=(n, d)) for m, d in je.MOD_DIMS.items() for v in (1, 2)}
        return rng.integers(0, 1 << 60, n).astype(np.uint64), (rng.random(n) < 0.4).astype(float), rows

    shards = [shard(n) for n in (70, 300, 1, 64)]
    start = np.concatenate([je.flatten(je.init_params(3)), np.zeros(2 * je.N_PARAMS)])
    got = je.train_side_by_side(shards, start, 0, 1e-3, 2, 1.7, window=3)
    for (keys, y, rows), (n, steps, loss, end) in zip(shards, got):
        w, m, v = (x.copy() for x in np.split(start, 3))
        order = np.argsort(je.keyed_uniforms(keys, je.SEED, 2, 7)[:, 0], kind="stable")
        total = 0.0
        for t, s in enumerate(range(0, len(keys), je.BATCH), 1):
            i = order[s:s + je.BATCH]
            p = je.unflatten(w)
            z, cache = je.forward(p, {k: x[i] for k, x in rows.items()}, je.dropout_masks(keys[i], 2, s))
            part, dz = je.bce_loss_grad(z, y[i], 1.7)
            g = je.flatten(je.backward(p, cache, dz / len(i)))
            m = je.BETA1 * m + (1 - je.BETA1) * g
            v = je.BETA2 * v + (1 - je.BETA2) * g * g
            w = w - 1e-3 * (m / (1 - je.BETA1 ** t)) / (np.sqrt(v / (1 - je.BETA2 ** t)) + je.ADAM_EPS)
            total += float(part.sum())
        assert (n, steps) == (len(keys), -(-len(keys) // je.BATCH)) and loss == pytest.approx(total, rel=1e-12)
        assert np.allclose(end, np.concatenate([w, m, v]), rtol=0, atol=1e-13)


def test_boosting_deals_many_rows_to_many_tasks(spark, monkeypatch):
    """One file of all training rows would be read by one task in every boosting round."""
    from panelspark.models import boosted as bst
    seen = []
    monkeypatch.setattr(bst, "TASK_ROWS", 50)
    monkeypatch.setattr(bst, "boosted_pipeline", lambda **kw: type("P", (), {"fit": lambda self, df: seen.append(df)})())
    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("subject_id"), (F.col("id") % 3 == 0).cast("int").alias(bst.LABEL))
    bst.fit_boosted(rows)
    assert len(seen[0].inputFiles()) == 8 and seen[0].count() == 400
