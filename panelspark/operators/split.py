"""Exact, reproducible stratified splits with forced members.

Order inside a stratum is ``md5(seed|salt|id)``: a pure function of the row, so the split
does not depend on partitioning and the same rows come out of plain SQL.  Quotas follow the
documented two-step stratified allocation: training quota per stratum by largest remainder of
``count * n_train / n`` (ties to the lower stratum name), test quota = count - training quota.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from panelspark.operators.ranking import first_k_by_hash, global_rank
from panelspark.session import stored
from panelspark.spec import GROUP, LABEL

SEED = 42


def real_positive_mask(df: DataFrame, synthetic_col: str | None = "synthetic", prefix: str = "SYN",
                       label: str = LABEL) -> Column:
    """Real subjects with a positive label.  With a ``synthetic`` flag the flag decides,
    else the id prefix does."""
    if synthetic_col and synthetic_col in df.columns:
        real = ~F.coalesce(F.col(synthetic_col), F.lit(False))
    else:
        real = ~F.col("subject_id").startswith(prefix)
    return real & (F.col(label) == 1)


SMALL_STRATA = 10000             # strata whose quotas the driver works out itself


def stratum_quotas(counts: DataFrame, stratum: str, test_fraction: float, small: int = SMALL_STRATA) -> DataFrame:
    """T3-style allocation on the per-stratum table (stratum, n) -> (stratum, quota).

    Up to ``small`` strata (checked) come to the driver.  Any number of them is ranked by ranges of
    (remainder, stratum) on executors (``global_rank``), with the same result; the table itself never meets in one task."""
    counts = stored(counts.select(stratum, "n"), "strata")
    some = counts.limit(small + 1).collect()
    spark, schema = counts.sparkSession, f"{stratum} {counts.schema[stratum].dataType.simpleString()}, quota long"
    if len(some) <= small:
        total = sum(r["n"] for r in some)
        n_train = total - math.ceil(float(test_fraction) * float(total))
        short = n_train - sum(r["n"] * n_train // total for r in some)
        rows = sorted(((-(r["n"] * n_train % total), _sortable(r[stratum]), r) for r in some), key=lambda x: x[:2])
        return spark.createDataFrame([(r[stratum], r["n"] - r["n"] * n_train // total - (i < short)) for i, (_, _, r) in enumerate(rows)], schema)
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    n_train = total - math.ceil(float(test_fraction) * float(total))
    t = counts.withColumn("_floor", F.expr(f"cast((cast(n as decimal(38,0)) * {n_train} - pmod(cast(n as decimal(38,0)) * {n_train}, {total})) / {total} as long)"))
    t = t.withColumn("_rem", F.expr(f"cast(pmod(cast(n as decimal(38,0)) * {n_train}, {total}) as long)"))
    short = n_train - (t.agg(F.sum("_floor")).first()[0] or 0)
    ranked = global_rank(t, [F.desc("_rem"), F.asc(stratum)], "_r")
    train_q = F.col("_floor") + F.when(F.col("_r") <= short, 1).otherwise(0)
    return ranked.select(stratum, (F.col("n") - train_q).cast("long").alias("quota"))


def _sortable(v):
    """A stratum value (a one-field row or a plain value) in Spark's order: NULL first."""
    v = v[0] if isinstance(v, Row) else v
    return (v is not None, v if v is not None else 0)


def stratified_split(df: DataFrame, test_fraction: float = 0.2, stratum: str = GROUP, forced: Column | None = None,
                     seed: int = SEED, salt: str = "test", id_col: str = "subject_id",
                     first: str = "test", second: str = "train", out: str = "split") -> DataFrame:
    """Add ``out`` in {first, second}.  Rows where ``forced`` holds go to ``first``; of the
    rest, an exact ``test_fraction`` per stratum (by the quotas above) goes to ``first`` too."""
    f = forced if forced is not None else F.lit(False)
    d = df.withColumn("_forced", F.coalesce(f, F.lit(False)))
    # read four times (quotas, the two selection branches, forced rows): one row per subject,
    # written once to the shared folder so the upstream plan runs once
    d = stored(d, "split-input")
    rest = d.where(~F.col("_forced"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col(id_col).cast("string")))
    # the stratum is wrapped in a one-field struct: a NULL stratum is then a stratum of its own
    # (structs with NULL fields group and join as equal)
    key = "_stratum"
    rest = rest.withColumn("_h", h).withColumn(key, F.struct(F.col(stratum).alias("v")))
    counts = rest.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    quotas = stratum_quotas(counts, key, test_fraction)
    picked = first_k_by_hash(rest, key, "_h", quotas, id_col)
    chosen = picked.withColumn(out, F.when(F.col("_selected"), first).otherwise(second)).drop("_selected", "_h", key)
    forced_rows = d.where(F.col("_forced")).withColumn(out, F.lit(first))
    return forced_rows.unionByName(chosen).drop("_forced")


def train_test_split(features: DataFrame, test_fraction: float = 0.2, seed: int = SEED,
                     synthetic_col: str | None = "synthetic") -> DataFrame:
    """Real positives forced into test, the rest split 80/20 stratified by group."""
    return stratified_split(features, test_fraction, GROUP, real_positive_mask(features, synthetic_col),
                            seed=seed, salt="test")


def train_validation_split(train: DataFrame, fraction: float = 0.15, seed: int = SEED) -> DataFrame:
    """Validation cut of the training rows, same stratification, another salt."""
    return stratified_split(train, fraction, GROUP, None, seed=seed, salt="validation",
                            first="validation", second="train")


def split_breakdown(split: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows, positives and negatives per (split, group), with the per-split total
    (``is_total`` true, group NULL) from a rollup; a NULL group of its own has ``is_total`` false."""
    y = F.col(LABEL)
    return split.rollup(split_col, GROUP).agg(
        (F.grouping(GROUP) == 1).alias("is_total"), F.grouping(split_col).alias("_all"),
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("n_label_1"),
        F.count_if(y == 0).alias("n_label_0")).where("_all = 0").drop("_all")


# Generated-subject shares per group.
CONVERTER_FRACTION = 0.20
DEMENTED_FRACTION = 0.40


def group_quotas(n_subjects: DataFrame, count_col: str = "n") -> DataFrame:
    """Converter and demented shares by floor, the remainder to nondemented."""
    n = F.col(count_col)
    c = F.floor(n * F.lit(CONVERTER_FRACTION)).cast("long")
    d = F.floor(n * F.lit(DEMENTED_FRACTION)).cast("long")
    return n_subjects.select(n.alias("n_total"), (n - c - d).alias("n_nondemented"), d.alias("n_demented"),
                             c.alias("n_converted"))
