"""Bind the TPC-H-style test tables to a longitudinal panel.

Subject = customer, visit = the customer's orders in date order (FIXTURES.md §2).  Every
derived column is a closed-form expression, so the same rows can be recomputed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.functions.exprs import days_between, keyed_uniform


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _visit_numbers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Number each customer's orders by (date, key) without a window per customer.

    A window partitioned by customer alone would put a hot customer (a third of all orders)
    into one task.  Instead (bucketed rank): count orders per (customer, day) -> a small table;
    a running sum over a customer's *days* gives each day's offset; the final row_number runs
    per (customer, day), which splits a hot customer across all of its days.  The customer
    join runs on the per-day table, not on the order rows.
    """
    per_day = orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_day.join(
        customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "inner")
    by_cust = Window.partitionBy("o_custkey")
    running = by_cust.orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_day.select(
        "o_custkey", "o_orderdate", "c_nationkey",
        (F.sum("_n").over(running) - F.col("_n")).alias("_offset"),
        F.min("o_orderdate").over(by_cust).alias("first_date"),
    )
    # Partition the order rows on (customer, day) explicitly: a window keyed (customer, day)
    # would otherwise accept a partitioning on customer alone and undo the split.
    # The per-day table is about as large as the orders, so a sort-merge join is the plan at
    # any scale; the hint keeps small inputs from broadcasting the order rows instead.
    joined = orders.repartition("o_custkey", "o_orderdate").join(
        offsets.hint("merge"), ["o_custkey", "o_orderdate"], "inner")
    in_day = Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    return joined.withColumn("visit", (F.col("_offset") + F.row_number().over(in_day)).cast("int"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows (subject_id, visit_id, grp, visit, mr_delay, sex, hand, age, educ, ses, mmse,
    cdr, etiv, nwbv, asf, synthetic) from ``orders`` and ``customer``."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = _visit_numbers(orders, customers)
    ck = F.col("o_custkey")
    ok = F.col("o_orderkey")
    delay = days_between("o_orderdate", "first_date")
    etiv = (F.lit(1100) + (ck * 7) % 801).cast("int")
    prio = F.substring("o_orderpriority", 1, 1)
    return o.select(
        ck.cast("string").alias("subject_id"),
        ok.cast("string").alias("visit_id"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "Converted")
        .when(F.col("o_orderstatus") == "F", "Demented").otherwise("Nondemented").alias("grp"),
        F.col("visit"),
        delay.cast("int").alias("mr_delay"),
        F.when(ck % 3 == 0, "M").otherwise("F").alias("sex"),
        F.when(ck % 10 == 0, "L").otherwise("R").alias("hand"),
        (F.lit(60) + ck % 30 + F.floor(delay / 365).cast("int")).cast("int").alias("age"),
        (F.lit(6) + ck % 18).cast("int").alias("educ"),
        F.when(ck % 13 == 0, F.lit(None).cast("double"))
        .otherwise((F.lit(1) + F.col("c_nationkey") % 5).cast("double")).alias("ses"),
        F.when(ok % 19 == 0, F.lit(None).cast("double"))
        .otherwise(F.floor(F.col("o_totalprice") / 1700).cast("double") / F.lit(10.0)).alias("mmse"),
        F.when(prio == "5", 0.0).when(prio == "4", 0.5).when(prio == "3", 1.0).when(prio == "2", 2.0)
        .otherwise(3.0).cast("double").alias("cdr"),
        etiv.alias("etiv"),
        ((F.lit(600) + ok % 251).cast("double") / F.lit(1000.0)).alias("nwbv"),
        F.round(F.lit(1430.0) / etiv.cast("double"), 3).alias("asf"),
        (ck % 4 != 0).alias("synthetic"),
    )


# Fixed values of the prediction binding: models and their planted-signal parameters.
PREDICTION_MODELS = ("text", "boosted", "joint")


def predictions(features: DataFrame) -> DataFrame:
    """Long prediction table (model, subject_id, participant_group, y, yhat, score) with a
    hard-label ``text`` model and two scored models with tied scores.

    One pass over the features: each row emits one struct per model and ``inline`` expands
    them, so the feature plan is not repeated per model (as a union of selects would do).
    """
    y = F.col("cdr_worsened_after_v2")
    sid = F.col("subject_id")
    u_text = keyed_uniform("text", sid)
    hard = F.when(u_text < F.lit(0.4) + F.lit(0.2) * y, 1).otherwise(0)
    rows = [F.struct(F.lit("text").alias("model"), hard.alias("yhat"), hard.cast("double").alias("score"))]
    for m in ("boosted", "joint"):
        s = F.floor((F.lit(0.7) * keyed_uniform(m, sid) + F.lit(0.3) * y) * 1000) / F.lit(1000.0)
        rows.append(F.struct(F.lit(m).alias("model"), F.when(s >= 0.5, 1).otherwise(0).alias("yhat"),
                             s.cast("double").alias("score")))
    out = features.select("subject_id", "participant_group", y.alias("y"), F.inline(F.array(*rows)))
    return out.select("model", "subject_id", "participant_group", "y", "yhat", "score")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second binding: ``events`` as a long panel with its own column names (subject = user_id,
    visit = position by (ts, event_id), group = event_type, signal = value, delay = whole days
    since the user's first event).  Visit positions use the bucketed rank with one bucket per
    (user, day), so a very active user is split over days."""
    from panelspark.operators.ranking import positions
    from panelspark.operators.small import join_per_key
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    pos = positions(ev, ["user_id"], "ts", ["event_id"], day, name="visit")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("_first"))
    # one row per user: joined back so that adaptive execution can split a hot user
    out = join_per_key(pos, first, "user_id").select(
        "user_id", "event_id", "event_type", F.col("visit").cast("int").alias("visit"),
        days_between("ts", "_first").alias("day"), "value")
    return out
