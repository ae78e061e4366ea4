"""Readers/writers (S1-S8) and job flows (R1-R7) end to end on the small binding."""

import os
import tempfile

from pyspark.sql import functions as F

from panelspark.plans import catalog as C
from panelspark.plans import jobs
from panelspark.sources import io
from tests.conftest import SMALL


def _scratch():
    return tempfile.mkdtemp(prefix="panelspark-test-", dir="/tmp")


def test_read_panel_csv_strips_headers_and_types(spark):
    d = _scratch()
    path = os.path.join(d, "panel.csv")
    with open(path, "w") as fh:
        fh.write(" Subject ID ,MRI ID,Group,Visit,MR Delay,M/F,Hand,Age,EDUC,SES,MMSE,CDR,eTIV,nWBV,ASF\n")
        fh.write("OAS2_0001,OAS2_0001_MR1,Nondemented,1,0,M,R,87,14,2,27,0,1987,0.696,0.883\n")
        fh.write("OAS2_0001,OAS2_0001_MR2,Nondemented,2,457,M,R,88,14,,30,0,2004,0.681,0.876\n")
    df = io.read_panel(spark, path)
    assert df.columns[:4] == ["subject_id", "visit_id", "grp", "visit"]
    rows = df.orderBy("visit").collect()
    assert rows[0]["ses"] == 2.0 and rows[1]["ses"] is None and rows[1]["mr_delay"] == 457
    assert dict(df.dtypes)["ses"] == "double" and dict(df.dtypes)["age"] == "int"
    assert io.read_first_existing(spark, [os.path.join(d, "missing.csv"), path]).count() == 2


def test_split_write_read_prunes(spark):
    d = _scratch()
    s = C.split_features(spark, SMALL)
    io.write_feature_splits(s, os.path.join(d, "splits"))
    test = io.read_feature_splits(spark, os.path.join(d, "splits"), "test")
    assert test.count() == s.where("split = 'test'").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_jobs_end_to_end(spark):
    d = _scratch()
    panel = C.panel(spark, SMALL)
    ex = jobs.job_exploration(panel)
    assert ex["summary"].first()["n_subjects"] > 0
    aug = jobs.job_augment(panel, n=50, out=os.path.join(d, "aug"))
    assert aug.where("synthetic").select("subject_id").distinct().count() == 50
    split = jobs.job_preprocess(panel, out=os.path.join(d, "features"))
    tr, te = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    text = jobs.job_text_scoring(te)
    assert text["accuracy_by_group"].where("is_total").first()["n"] == te.count()
    boosted = jobs.job_boosted(tr, te, out=os.path.join(d, "boosted"), n_trees=10)
    assert boosted["metrics"].first()["auc_roc"] is not None
    joint = jobs.job_joint_embedding(tr, te, out=os.path.join(d, "boosted"), epochs=5)
    written = io.read_predictions(spark, os.path.join(d, "boosted", "predictions"))       # both models are there after two writes
    assert {r["model"]: r["count"] for r in written.groupBy("model").count().collect()} == {"boosted": te.count(), "joint": te.count()}
    assert io.read_metrics(spark, os.path.join(d, "boosted", "metrics")).count() == 2
    preds = text["predictions"].unionByName(boosted["predictions"]).unionByName(joint["predictions"])
    cmp = jobs.job_comparison(preds, panel, out=os.path.join(d, "cmp"))
    assert cmp["comparison"].count() == te.count()
    assert cmp["metrics"].count() == 3
    leak_free = jobs.job_preprocess(panel, leakage_free=True)
    assert leak_free.count() == split.count()


def test_incremental_files_adapter(spark):
    from panelspark.streaming import run_on_new_files
    d = _scratch()
    src = os.path.join(d, "incoming")
    p = C.panel(spark, SMALL)
    p.limit(200).write.parquet(os.path.join(src, "part1"))
    seen = []

    def handle(batch, batch_id):
        seen.append(batch.count())

    run_on_new_files(spark, os.path.join(src, "*"), handle, os.path.join(d, "ckpt"))
    assert sum(seen) == 200
    p.limit(50).write.parquet(os.path.join(src, "part2"))
    seen.clear()
    run_on_new_files(spark, os.path.join(src, "*"), handle, os.path.join(d, "ckpt"))
    assert sum(seen) == 50          # resumed from the checkpoint: only the new files


def test_text_scoring_store_skips_answered_prompts(spark):
    from panelspark.models import textscore
    calls = []

    def counting_factory():
        inner = textscore.mmse_rule_predictor_factory()

        def predict(prompts):
            calls.append(len(prompts))
            return inner(prompts)
        return predict

    store = os.path.join(_scratch(), "responses")
    f = C.features(spark, SMALL)
    first = textscore.score_text_batch(f, counting_factory, store=store).select("subject_id", "text_prediction")
    a = {r[0]: r[1] for r in first.collect()}
    def refusing_factory():
        def predict(prompts):
            if prompts:
                raise AssertionError("predictor called for an answered prompt")
            return []
        return predict

    again = textscore.score_text_batch(f, refusing_factory, store=store).select("subject_id", "text_prediction")
    assert {r[0]: r[1] for r in again.collect()} == a


def test_study_csv_flow(spark):
    """The switch-over path: a study CSV with its own header goes through every job."""
    import csv
    import importlib.util
    d = _scratch()
    rows = C.panel(spark, SMALL).where("subject_id < '300'").orderBy("subject_id", "visit").collect()
    header = [" Subject ID", "MRI ID", "Group", "Visit", "MR Delay", "M/F", "Hand", "Age", "EDUC", "SES", "MMSE",
              "CDR", "eTIV", "nWBV", "ASF "]
    path = os.path.join(d, "study.csv")
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for r in rows:
            w.writerow([r["subject_id"], r["visit_id"], r["grp"], r["visit"], r["mr_delay"], r["sex"], r["hand"],
                        r["age"], r["educ"], "" if r["ses"] is None else r["ses"], "" if r["mmse"] is None else r["mmse"],
                        r["cdr"], r["etiv"], r["nwbv"], r["asf"]])
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("study_flow", os.path.join(here, "examples", "study_flow.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    res = mod.run(spark, path, os.path.join(d, "out"), n_trees=5, epochs=3)
    assert res["metrics"].count() == 3
    assert spark.read.parquet(os.path.join(d, "out", "comparison")).count() == res["comparison"].count() > 0


def test_predictions_of_one_model_replace_only_their_own(spark):
    path = os.path.join(_scratch(), "predictions")
    ddl = "model string, subject_id string, participant_group string, y int, yhat int, score double"
    rows = lambda m, n, s: spark.createDataFrame([(m, str(i), None, 0, 1, s) for i in range(n)], ddl)
    io.write_predictions(rows("a", 3, 0.5), path)
    io.write_predictions(rows("b", 2, 0.25), path)
    io.write_predictions(rows("a", 1, 0.75), path)
    io.write_predictions(rows("a", 0, 0.0), path)
    got = sorted((r.model, r.subject_id, r.score) for r in io.read_predictions(spark, path).collect())
    assert got == [("a", "0", 0.75), ("b", "0", 0.25), ("b", "1", 0.25)]
    assert io.read_predictions(spark, path, ["b"]).count() == 2
