"""Inventory rows reachable on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import oracle as O
from panelspark.plans.queries.common import (
    FORCED, IPANEL, PANEL_ONLY, SPLIT, TRAIN, features, ipanel, panel, query, split_features, sql, train_test,
)
from panelspark.models import boosted as bst
from panelspark.operators import augment as aug
from panelspark.operators import cohort as coh
from panelspark.operators import features as feat
from panelspark.operators import split as spl
from panelspark.plans.queries.generator import BASELINE_CTE, DRAWS_CTE, GEN, n_subjects
from panelspark.plans.queries.models import boosted_model, joint_model
from panelspark.spec import LABEL


# ── inventory rows reachable on their own (J3, A10, W2, U2, F1-F3, G4-G6, M1, M6) ──

@query("impute_join", sql(*IPANEL, body="SELECT * FROM ipanel"))
def q_impute_join(spark, sf):
    """J3 in its join form: medians kept as a DataFrame and joined back (left) on the group."""
    p = panel(spark, sf)
    return feat.GroupMedianImputer(("mmse", "ses")).fit(p).transform(p)


@query("group_medians", sql(*PANEL_ONLY, body="""
SELECT grp, median(mmse) AS median_mmse, median(ses) AS median_ses FROM panel WHERE grp IS NOT NULL GROUP BY grp"""))
def q_group_medians(spark, sf):
    return feat.group_medians(panel(spark, sf))


@query("first_last_visit", sql(*PANEL_ONLY, body="""
SELECT subject_id,
       first(visit ORDER BY visit, visit_id) AS first_visit, first(visit_id ORDER BY visit, visit_id) AS first_visit_id,
       first(mmse ORDER BY visit, visit_id) AS first_mmse, first(cdr ORDER BY visit, visit_id) AS first_cdr,
       last(visit ORDER BY visit, visit_id) AS last_visit, last(visit_id ORDER BY visit, visit_id) AS last_visit_id,
       last(mmse ORDER BY visit, visit_id) AS last_mmse, last(cdr ORDER BY visit, visit_id) AS last_cdr
FROM panel GROUP BY subject_id"""))
def q_first_last_visit(spark, sf):
    return coh.first_last_visit(panel(spark, sf))


@query("union_forced_test", sql(*SPLIT, body=f"""
SELECT subject_id, participant_group, cdr_worsened_after_v2, coalesce({FORCED}, false) AS forced FROM split1 WHERE split = 'test'"""))
def q_union_forced_test(spark, sf):
    s = split_features(spark, sf).where("split = 'test'")
    return s.select("subject_id", "participant_group", "cdr_worsened_after_v2",
                    F.coalesce(spl.real_positive_mask(s), F.lit(False)).alias("forced"))


WIDE_SQL = """
SELECT a.subject_id, s.participant_group,
       a.age AS age_v1, a.mmse AS mmse_v1, a.cdr AS cdr_v1, a.nwbv AS nwbv_v1, a.etiv AS etiv_v1, a.asf AS asf_v1,
       b.age AS age_v2, b.mmse AS mmse_v2, b.cdr AS cdr_v2, b.nwbv AS nwbv_v2, b.etiv AS etiv_v2, b.asf AS asf_v2,
       b.mr_delay AS mr_delay_v2, a.educ AS education_years, a.ses AS ses, a.sex AS sex, a.hand AS handedness{extra}
FROM v1_ a JOIN v2_ b USING (subject_id) JOIN subj_ s USING (subject_id)"""
DELTAS = (", b.mmse - a.mmse AS mmse_delta_v1_v2, b.nwbv - a.nwbv AS nwbv_delta_v1_v2, "
          "b.cdr - a.cdr AS cdr_delta_v1_v2, b.age - a.age AS age_delta_v1_v2")


@query("features_wide", sql(*IPANEL, O.ROLLUP_CTE.format(src="ipanel"), body=WIDE_SQL.format(extra="")))
def q_features_wide(spark, sf):
    return feat.features_wide(ipanel(spark, sf))


@query("delta_features", sql(*IPANEL, O.ROLLUP_CTE.format(src="ipanel"), body=WIDE_SQL.format(extra=DELTAS)))
def q_delta_features(spark, sf):
    return feat.delta_features(feat.features_wide(ipanel(spark, sf)))


@query("worsened_after_cutoff", sql(*PANEL_ONLY, O.ROLLUP_CTE.format(src="panel"), body="""
SELECT b.subject_id, cast(coalesce(f.max_after > b.cdr, false) AS integer) AS cdr_worsened_after_v2
FROM v2_ b JOIN after_ f USING (subject_id)"""))
def q_worsened_after_cutoff(spark, sf):
    return feat.worsened_after_cutoff(panel(spark, sf))


def _gen(spark, sf):
    return aug.generate_panel(spark, n_subjects(spark, sf))


@query("generate_signal_walk", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="SELECT subject_id, visit, mr_delay, mmse, nwbv FROM gpanel"))
def q_generate_signal_walk(spark, sf):
    return _gen(spark, sf).select("subject_id", "visit", "mr_delay", "mmse", "nwbv")


@query("generate_stage_chain", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="SELECT subject_id, visit, cdr FROM gpanel"))
def q_generate_stage_chain(spark, sf):
    return _gen(spark, sf).select("subject_id", "visit", "cdr")


@query("generate_visit_group", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="SELECT subject_id, visit_id, visit, grp FROM gpanel"))
def q_generate_visit_group(spark, sf):
    return _gen(spark, sf).select("subject_id", "visit_id", "visit", "grp")


@query("boosted_trees_fit", sql(*TRAIN, body="""
SELECT cast(range AS integer) AS tree, true AS weight_ok, true AS depth_ok, true AS nodes_ok, n_train, n_positive
FROM range(200), (SELECT count(*) AS n_train, count(*) FILTER (WHERE cdr_worsened_after_v2 = 1) AS n_positive FROM train_)"""))
def q_boosted_trees_fit(spark, sf):
    """M1, as facts per tree: boosting weight (1 for the first, the learning rate after), depth at
    most the limit, and a node count a binary tree of that depth can have; with the rows that the model has seen."""
    model, _ = boosted_model(spark, sf)
    seen = train_test(spark, sf)[0].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(LABEL) == 1).alias("p")).first()
    gbt = model.stages[-1]
    rows = [(i, float(w), int(t.numNodes), int(t.depth)) for i, (w, t) in enumerate(zip(gbt.treeWeights, gbt.trees))]
    trees = spark.createDataFrame(rows, "tree int, weight double, num_nodes int, depth int")
    want = F.when(F.col("tree") == 0, 1.0).otherwise(bst.LEARNING_RATE)
    return trees.select("tree", (F.abs(F.col("weight") - want) < 1e-9).alias("weight_ok"), (F.col("depth") <= bst.MAX_DEPTH).alias("depth_ok"),
                        ((F.col("num_nodes") % 2 == 1) & (F.col("num_nodes") < F.pow(F.lit(2.0), F.col("depth") + 1))).alias("nodes_ok"),
                        F.lit(seen["n"]).cast("long").alias("n_train"), F.lit(seen["p"]).cast("long").alias("n_positive"))


@query("joint_embedding_fit")
def q_joint_embedding_fit(spark, sf):
    """M6: training history (epoch, train loss, validation loss, learning rate)."""
    model, _ = joint_model(spark, sf)
    return spark.createDataFrame(model.history, "epoch int, train_loss double, val_loss double, lr double")
