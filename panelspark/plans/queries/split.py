"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans.queries.common import (
    BASE_SYN, FORCED, PANEL_ONLY, SPLIT, VSPLIT, features, panel, query, split_features, sql,
)
from panelspark.operators import split as spl


@query("participant_features_synthetic", sql(*BASE_SYN, body="SELECT * FROM features"))
def q_features_synthetic(spark, sf):
    return features(spark, sf, extra_static=("synthetic",))


@query("real_positive_mask", sql(*BASE_SYN, body=f"SELECT subject_id, coalesce({FORCED}, false) AS real_positive FROM features"))
def q_real_positive_mask(spark, sf):
    f = features(spark, sf, extra_static=("synthetic",))
    return f.select("subject_id", F.coalesce(spl.real_positive_mask(f), F.lit(False)).alias("real_positive"))


@query("stratified_split_forced", sql(*SPLIT, body="SELECT * FROM split1"))
def q_stratified_split_forced(spark, sf):
    return split_features(spark, sf)


@query("train_validation_split", sql(*VSPLIT, body="SELECT * FROM split2"))
def q_train_validation_split(spark, sf):
    s = split_features(spark, sf)
    return spl.train_validation_split(s.where("split = 'train'").drop("split"))


@query("split_breakdown", sql(*SPLIT, body="""
SELECT split, participant_group, grouping(participant_group) = 1 AS is_total, count(*) AS n, count(*) FILTER (WHERE cdr_worsened_after_v2 = 1) AS n_label_1,
       count(*) FILTER (WHERE cdr_worsened_after_v2 = 0) AS n_label_0
FROM split1 GROUP BY ROLLUP (split, participant_group) HAVING grouping(split) = 0"""))
def q_split_breakdown(spark, sf):
    return spl.split_breakdown(split_features(spark, sf))


@query("group_quotas", sql(*PANEL_ONLY, body="""
SELECT n AS n_total, n - cast(floor(n * cast(0.2 AS double)) AS bigint) - cast(floor(n * cast(0.4 AS double)) AS bigint) AS n_nondemented,
       cast(floor(n * cast(0.4 AS double)) AS bigint) AS n_demented, cast(floor(n * cast(0.2 AS double)) AS bigint) AS n_converted
FROM (SELECT count(DISTINCT subject_id) AS n FROM panel)"""))
def q_group_quotas(spark, sf):
    n = panel(spark, sf).agg(F.count_distinct("subject_id").alias("n"))
    return spl.group_quotas(n)
