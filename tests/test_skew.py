"""One subject holding a third of all rows: results stay exact and the ordered operators
split it (their windows are keyed by (subject, bucket), never by subject alone)."""

from pyspark.sql import Window, functions as F

from panelspark.operators import cohort as coh
from panelspark.sources.bindings import _visit_numbers


def _skewed_panel(spark, hot_rows=6000, cold_subjects=300, visits=40):
    hot = spark.range(hot_rows).select(F.lit("HOT").alias("subject_id"), (F.col("id") + 1).cast("int").alias("visit"))
    cold = spark.range(cold_subjects * visits).select(
        F.concat(F.lit("C"), (F.col("id") % cold_subjects).cast("string")).alias("subject_id"),
        (F.floor(F.col("id") / cold_subjects) + 1).cast("int").alias("visit"))
    p = hot.unionByName(cold)
    return p.select("subject_id", F.concat_ws("_", "subject_id", F.col("visit").cast("string")).alias("visit_id"),
                    "visit", (F.col("visit") * 30).cast("int").alias("mr_delay"))


def _window_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


def test_positions_exact_and_split(spark):
    p = _skewed_panel(spark)
    ours = coh.visit_interval(p, width=256)
    w = Window.partitionBy("subject_id").orderBy("visit", "visit_id")
    ref = p.select("subject_id", "visit", "visit_id", F.row_number().over(w).cast("long").alias("visit_rank"),
                   (F.col("mr_delay") - F.lag("mr_delay").over(w)).alias("interval_days"))
    a = ours.select("subject_id", "visit", "visit_id", "visit_rank", "interval_days")
    assert a.exceptAll(ref).count() == 0 and ref.exceptAll(a).count() == 0
    big = [l for l in _window_keys(ours) if "row_number()" in l]
    assert big and all("_key" in l for l in big)


def test_binding_visit_numbers_hot_customer(spark):
    hot = spark.range(5000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"),
                                   F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 900 as int))").alias("o_orderdate"))
    cold = spark.range(5000, 8000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"),
                                          F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 97 as int))").alias("o_orderdate"))
    orders = hot.unionByName(cold)
    cust = spark.range(0, 60).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    ours = _visit_numbers(orders, cust).select("o_orderkey", F.col("visit").cast("long"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ref = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", F.row_number().over(w).cast("long").alias("visit"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0
    rn = [l for l in _window_keys(_visit_numbers(orders, cust)) if "row_number()" in l]
    assert rn and all("o_orderdate" in l.split("windowspecdefinition(")[1].split("ORDER BY")[0] for l in rn)


def test_subject_joins_give_both_sides_an_exchange(spark):
    """A hot subject can only be split when both join sides come straight from an exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _skewed_panel(spark, 50, 5, 4).withColumn("grp", F.lit("g"))
        for df in (coh.panel_with_subject_group(p), coh.subject_trajectories(p, p.select("subject_id"))):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            at = next(i for i, l in enumerate(lines) if "SortMergeJoin" in l)
            below = [l for l in lines[at + 1:] if "Exchange" in l or "HashAggregate" in l or "SortAggregate" in l or "ObjectHashAggregate" in l]
            assert "Exchange" in below[0] and sum("_join_key" in l for l in below if "Exchange" in l) == 2
            assert df.count() == p.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
