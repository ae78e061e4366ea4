"""Panel profiling: structure, counts, missing values, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelspark.operators.cohort import panel_with_subject_group, subject_group
from panelspark.operators.ranking import exact_quantiles
from panelspark.operators.small import bounded
from panelspark.session import stored
from panelspark.spec import GROUP, PANEL, PanelSpec


def dataset_structure(df: DataFrame) -> DataFrame:
    """A1: (position, column_name, dtype, n_rows, n_columns).  Types come from the schema (one row
    per column); the row count is one distributed count."""
    return structure_of(df, df.count())


def structure_of(df: DataFrame, n: int) -> DataFrame:
    """A1 with a known row count."""
    rows = [(i, f.name, f.dataType.simpleString(), n, len(df.columns)) for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, dtype string, n_rows long, n_columns int"
    return df.sparkSession.createDataFrame(rows, schema)


def group_row_counts(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A2: visit rows per group, NULL group excluded."""
    return (panel.where(F.col(spec.group).isNotNull()).groupBy(spec.group)
            .agg(F.count(F.lit(1)).alias("n_rows")))


def subject_group_counts(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A4: subjects per subject-level group."""
    return subject_group(panel, spec).groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_subjects"))


def visit_counts(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A5: non-null visits per subject."""
    return panel.groupBy(spec.subject).agg(F.count(spec.visit).alias("num_visits"))


def visit_count_distribution(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Subjects per visit count; the rollup row (num_visits NULL) is the total."""
    return visit_counts(panel, spec).rollup("num_visits").agg(F.count(F.lit(1)).alias("n_subjects"))


def null_count(df: DataFrame, c: str) -> Column:
    """Aggregate: rows whose value of a column is missing (NULL, or NaN in a floating column)."""
    col = F.col(f"`{c}`")
    floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.count_if(col.isNull() | F.isnan(col) if floating else col.isNull())


def missing_value_audit(df: DataFrame) -> DataFrame:
    """Per column the NULL count and percentage of rows (2 decimals), columns with NULLs only.
    One scan for all columns, then an unpivot of the single result row."""
    aggs = [F.count(F.lit(1)).alias("__n"), *[null_count(df, c).alias(f"{c}__nulls") for c in df.columns]]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nulls`" for c in df.columns)
    long = wide.selectExpr("__n", f"stack({len(df.columns)}, {stack}) as (column_name, null_count)")
    return long.where(F.col("null_count") > 0).select(
        "column_name", "null_count",
        F.round(F.col("null_count") * 100.0 / F.col("__n"), 2).alias("null_pct"))


def exploration_summary(panel: DataFrame, spec: PanelSpec = PANEL, converted: str = "Converted") -> DataFrame:
    """Subjects, rows, converter subjects, subjects with >= 3 visits, missing MMSE and the
    sorted distinct group labels, from one per-subject aggregate."""
    parts = stored(panel.groupBy(spec.subject, spec.group).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(spec.visit).alias("_visits"),
        F.count_if(F.col(spec.mmse).isNull()).alias("_miss")), "subject-groups")
    return summary_of(parts, spec, converted)


def summary_of(parts: DataFrame, spec: PanelSpec = PANEL, converted: str = "Converted") -> DataFrame:
    """A9 from a rollup by (subject, group) with _rows, _visits and _miss.

    The labels are counted like any key and joined to one text by the same aggregate that makes the result's row;
    nothing but that row is as long as they are."""
    g = F.col(spec.group)
    per_subject = parts.groupBy(spec.subject).agg(
        F.sum("_rows").alias("_rows"), F.sum("_visits").alias("_visits"), F.bool_or(g == converted).alias("_conv"), F.sum("_miss").alias("_miss"))
    labels = parts.where(g.isNotNull()).select(g.cast("string").alias("_label")).distinct()
    both = per_subject.select(F.lit(1).alias("_one"), "_rows", "_visits", "_conv", "_miss").unionByName(labels, allowMissingColumns=True)
    return both.agg(
        F.count("_one").alias("n_subjects"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("_conv")).alias("n_converters"),
        F.count_if(F.col("_visits") >= 3).alias("n_subjects_3plus_visits"),
        F.coalesce(F.sum("_miss"), F.lit(0)).alias("n_missing_mmse"),
        F.array_join(F.array_sort(F.collect_list("_label")), ", ").alias("group_labels"),
    )


def split_nulls_check(panel: DataFrame, columns=("mmse", "ses"), spec: PanelSpec = PANEL) -> DataFrame:
    """NULLs left per column (after imputation)."""
    return panel.agg(*[F.count_if(F.col(spec.signal(c)).isNull()).alias(f"{c}_nulls") for c in columns])


def panel_cohort_counts(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Subjects and rows for real / generated panel rows and combined."""
    return cohorts_of(panel.groupBy(spec.synthetic, spec.subject).agg(F.count(F.lit(1)).alias("_rows")), spec)


def cohorts_of(per: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A20 from any rollup that holds the generated flag, the subject and _rows."""
    r = per.rollup(spec.synthetic).agg(F.count_distinct(spec.subject).alias("n_subjects"),
                                       F.sum("_rows").alias("n_rows"),
                                       F.grouping(spec.synthetic).alias("_total"))
    cohort = (F.when(F.col("_total") == 1, "combined")
              .when(F.col(spec.synthetic), "generated").otherwise("real"))
    return r.select(cohort.alias("cohort"), "n_subjects", "n_rows")


def _baseline_values(panel: DataFrame, metrics, spec: PanelSpec) -> DataFrame:
    return baseline_values_of(panel_with_subject_group(panel, spec), metrics, spec)


def baseline_values_of(labelled: DataFrame, metrics, spec: PanelSpec = PANEL) -> DataFrame:
    """(subject, participant_group, metric, value) at visit 1, NULLs dropped, stored."""
    base = labelled.where(F.col(spec.visit) == 1)
    return stored(base.select(F.col(spec.subject).alias("subject_id"), GROUP, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(spec.signal(m)).cast("double").alias("value")) for m in metrics
    ]))).where(F.col("value").isNotNull()), "baseline-values")


def _with_fences(long: DataFrame, approx: bool) -> DataFrame:
    """Baseline values with their box's count, quartiles and fences (1.5 IQR)."""
    counts = long.groupBy(GROUP, "metric").agg(F.count(F.lit(1)).alias("n"))
    if approx:
        qs = long.groupBy(GROUP, "metric").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("_q")) \
            .select(GROUP, "metric", *[F.col("_q")[i].alias(f"q{i}") for i in range(3)])
    else:
        # exact quartiles without one task per (group, metric) holding all its values
        qs = exact_quantiles(long, [GROUP, "metric"], "value", [0.25, 0.5, 0.75])
    # quartiles rounded to 6 decimals: interpolation formulas differ in the last bit between engines
    q = counts.join(qs, [GROUP, "metric"], "inner").select(
        GROUP, "metric", "n", F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("median"), F.round("q2", 6).alias("q3"),
        (F.round("q0", 6) - 1.5 * (F.round("q2", 6) - F.round("q0", 6))).alias("_lo"),
        (F.round("q2", 6) + 1.5 * (F.round("q2", 6) - F.round("q0", 6))).alias("_hi"))
    # the quartile table has one row per (group, metric): broadcast after the size check
    return long.join(bounded(q), [GROUP, "metric"], "inner")


def baseline_box_stats(panel: DataFrame, metrics=("mmse", "nwbv"), spec: PanelSpec = PANEL,
                       approx: bool = False) -> DataFrame:
    """Box-plot numbers per subject group and metric at visit 1, NULLs dropped: quartiles
    (linear interpolation), whiskers at the furthest point within 1.5 IQR, outlier count."""
    return box_stats_of(_baseline_values(panel, metrics, spec), approx)


def box_stats_of(long: DataFrame, approx: bool = False) -> DataFrame:
    """A21 from baseline values."""
    j, v = _with_fences(long, approx), F.col("value")
    return j.groupBy(GROUP, "metric", "n", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("n_outliers"),
    )


def baseline_outliers(panel: DataFrame, metrics=("mmse", "nwbv"), spec: PanelSpec = PANEL) -> DataFrame:
    """A21, the points beyond the whiskers: (participant_group, metric, subject_id, value)."""
    j, v = _with_fences(_baseline_values(panel, metrics, spec), False), F.col("value")
    return j.where((v < F.col("_lo")) | (v > F.col("_hi"))).select(GROUP, "metric", "subject_id", "value")


def first_n_features(features: DataFrame, n: int = 10) -> DataFrame:
    """P10 on the feature (test) frame: the first ``n`` rows by subject (a top-k: the limit is the feature)."""
    return features.orderBy("subject_id").limit(n)


def first_n_inspection(panel: DataFrame, n: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """P10: the first ``n`` panel rows in (subject, visit, visit_id) order (a top-k: the limit is
    the feature)."""
    return panel.orderBy(spec.subject, spec.visit, spec.visit_id).limit(n)
