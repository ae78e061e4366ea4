"""Plan shape as it would be at scale (no broadcast of large sides): pruned scans, windows keyed
by (customer, day), one exchange for the per-subject aggregate."""

import re

from panelspark.plans import catalog as C
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_at_scale(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(C.raw_features(spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan) or re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    joined = " ".join(schemas)
    assert "c_name" not in joined and "c_acctbal" not in joined and "c_mktsegment" not in joined
    windows = [l for l in plan.splitlines() if "row_number()" in l and "windowspecdefinition" in l]
    assert windows and all("o_orderdate" in l.split("windowspecdefinition(")[1].split("ORDER BY")[0] for l in windows)
    assert "BroadcastHashJoin" not in plan


def test_feature_build_is_one_subject_aggregate(spark):
    plan = _plan(C.raw_features(spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(subject_id", plan)) == 1
