"""Heavy subjects, one-value subjects and very many strata: results stay exact and no task holds much more than its share."""

import math
import statistics

import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import Window, functions as F

from panelspark.operators import augment as aug, cohort as coh, split as spl
from panelspark.operators.ranking import global_rank, positions
from panelspark.operators.small import join_spread


@pytest.fixture
def plain(spark):
    """Adaptive execution off, 16 shuffle partitions, no broadcast joins by size."""
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _panel(spark, hot=40000, cold=800, visits=100):
    rows = spark.range(hot).select(F.lit("HOT").alias("subject_id"), (F.col("id") + 1).cast("int").alias("visit"))
    rows = rows.unionByName(spark.range(cold * visits).select(
        F.concat(F.lit("C"), (F.col("id") % cold).cast("string")).alias("subject_id"), (F.floor(F.col("id") / cold) + 1).cast("int").alias("visit")))
    return rows.select("*", F.concat_ws("_", "subject_id", "visit").alias("visit_id"), F.lit("Demented").alias("grp"), (F.col("visit") * 30).alias("mr_delay"))


def _task_rows(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_joins_on_a_heavy_subject(plain):
    p = _panel(plain)                                               # one subject holds a third of all rows
    j1, j4 = coh.panel_with_subject_group(p), coh.subject_trajectories(p, p.select("subject_id"))
    for df in (j1, j4):
        sizes = _task_rows(df)
        assert sum(sizes) == p.count() and max(sizes) <= 3 * statistics.median(sizes)
    want = p.join(coh.subject_group(p), "subject_id")
    assert j1.select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(j1.select(*want.columns)).isEmpty()
    only = coh.subject_trajectories(p, plain.createDataFrame([("HOT",), ("C7",), ("none",)], "subject_id string"))
    assert only.columns == p.columns and only.count() == 40100


def test_spread_join_keeps_null_keys_and_repeated_rows(plain):
    rows = plain.createDataFrame([(None, 1)] * 50 + [("a", 1)] * 3 + [("b", 2)], "k string, v int")
    per = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = join_spread(rows, per, "k", "n")
    assert got.columns == ["k", "v", "m"] and got.count() == 54 and got.where("k is null").count() == 50
    assert join_spread(rows.where("false"), per.where("false"), "k", "n").count() == 0


def test_one_subject_with_one_visit_number_is_split(plain):
    n = 200000
    p = plain.range(n).select(F.lit("S").alias("subject_id"), F.lit(1).alias("visit"), F.format_string("id%07d", F.col("id")).alias("visit_id"),
                              (F.col("id") % 91).cast("int").alias("mr_delay"))
    rows = coh.visit_interval(p, bucket_rows=4096)
    sizes = _task_rows(rows)
    assert len(sizes) > 8 and max(sizes) < n / 4
    w = Window.partitionBy("subject_id").orderBy("visit", "visit_id")
    want = p.select("visit_id", F.row_number().over(w).cast("long").alias("visit_rank"), (F.col("mr_delay") - F.lag("mr_delay").over(w)).alias("interval_days"))
    got = rows.select("visit_id", "visit_rank", "interval_days")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 40)), max_size=60), st.integers(1, 8))
def test_positions_with_pieces(spark, rows, size):
    df = spark.createDataFrame([(s, v, i, k) for k, (s, v, i) in enumerate(rows)], "s string, v int, t int, k int")
    got = positions(df, ["s"], "v", ["t", "k"], F.floor(F.col("v") / 2), carry=["k"], bucket_rows=size)
    w = Window.partitionBy("s").orderBy("v", "t", "k")
    want = df.select("k", F.row_number().over(w).cast("long").alias("position"), F.lag("k").over(w).alias("prev_k"))
    assert sorted(map(str, got.select("k", "position", "prev_k").collect())) == sorted(map(str, want.collect()))


def test_priors_of_a_heavy_subject(spark):
    from tests.conftest import make_panel
    p = make_panel(spark, [("A", 1 + i % 2, 0.5, "Demented", 20.0 + i % 7) for i in range(400)] + [("B", v, 0.0, "Demented", 25.0 - v) for v in (1, 2, 3)])
    p = p.withColumn("visit_id", F.concat("visit_id", F.format_string("%05d", F.monotonically_increasing_id())))
    p = spark.createDataFrame(p.collect(), p.schema)
    assert sorted(map(str, aug.fit_generation_priors(p, bucket_rows=16).collect())) == sorted(map(str, aug.fit_generation_priors(p).collect()))


def test_global_rank(plain):
    df = plain.range(50000).select((F.col("id") * 7919 % 50000).alias("x"), (F.col("id") % 5).alias("g"))
    got = global_rank(df, [F.desc("g"), F.asc("x")], "r")
    want = df.withColumn("r", F.row_number().over(Window.orderBy(F.desc("g"), "x")).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == 50000
    assert all("_range" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=3)), st.integers(1, 30), max_size=12), st.sampled_from([0.0, 0.15, 0.2, 0.5, 1.0]))
def test_quotas_do_not_depend_on_the_path(spark, counts, fraction):
    df = spark.createDataFrame(list(counts.items()), "g string, n long").select(F.struct(F.col("g").alias("v")).alias("s"), "n")
    small, large = (sorted(((r.s.v, r.quota) for r in spl.stratum_quotas(df, "s", fraction, small=k).collect()), key=str) for k in (100, -1))
    assert small == large
    total = sum(counts.values())
    assert sum(q for _, q in small) == math.ceil(fraction * total) and all(0 <= q <= counts[g] for g, q in small)


def test_every_subject_a_stratum(plain):
    n = 30000
    df = plain.range(n).select(F.col("id").cast("string").alias("subject_id"), F.col("id").alias("participant_group"), F.lit(0).alias("cdr_worsened_after_v2"))
    got = spl.train_validation_split(df)
    assert got.where("split = 'validation'").count() == math.ceil(0.15 * n) and got.count() == n
    quotas = spl.stratum_quotas(df.groupBy(F.struct(F.col("participant_group").alias("v")).alias("s")).agg(F.count("*").alias("n")), "s", 0.15)
    plan = quotas._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and quotas.agg(F.sum("quota")).first()[0] == math.ceil(0.15 * n)


def test_ids_beyond_int(spark):
    ids = spark.range(2 ** 31 - 2, 2 ** 31 + 1).select(F.format_string(aug.ID_FORMAT, F.col("id") + aug.FIRST_ID).alias("s"))
    assert [r.s for r in ids.collect()] == [f"SYN_{i + 1000}" for i in range(2 ** 31 - 2, 2 ** 31 + 1)]
    assert [r.subject_id for r in aug.generate_subjects(spark, 2).collect()] == ["SYN_1000", "SYN_1001"]
