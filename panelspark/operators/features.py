"""Participant feature rows, labels, imputation and model-side feature transforms.

F1-F9, A10, A12-A14, J3, P5, P6 of the operator inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.operators.ranking import positions, quantiles_of_counts, value_counts
from panelspark.operators.small import bounded, local_or_stored
from panelspark.session import stored
from panelspark.spec import (
    CATEGORICAL_FEATURES, FEATURE_COLUMNS, GROUP, LABEL, NUMERIC_FEATURES, PANEL, PanelSpec,
)

# Per-visit fields copied into the feature row (panel field -> feature stem).
VISIT_FIELDS = [("age", "age"), ("mmse", "mmse"), ("cdr", "cdr"), ("nwbv", "nwbv"), ("etiv", "etiv"), ("asf", "asf")]
CONVERTED = "Converted"


def subject_group_expr(spec: PanelSpec = PANEL, converted: str = CONVERTED) -> Column:
    """Aggregate: ``converted`` if any visit carries it, else the group of the first visit
    in (visit, visit_id) order."""
    g = F.col(spec.group)
    first = F.min_by(g, F.struct(F.col(spec.visit), F.col(spec.visit_id)))
    return F.when(F.bool_or(g == F.lit(converted)), F.lit(converted)).otherwise(first)


def _visit_struct(spec: PanelSpec, k: int, fields: list[str]) -> Column:
    """The row of visit number ``k`` (lowest visit_id among duplicates, NULL lowest), NULL if absent."""
    v = F.col(spec.visit)
    payload = F.struct(*[F.col(spec.signal(f)).alias(f) for f in fields])
    return F.min_by(payload, F.when(v == k, F.struct(spec.visit_id)))


def subject_rollup(panel: DataFrame, spec: PanelSpec = PANEL, first: int = 1, second: int = 2,
                   horizon: int | None = None, extra_static: tuple[str, ...] = (), keep_group: bool = False) -> DataFrame:
    """One row per subject with the visit-1 / visit-2 payloads, the follow-up maximum and a
    ``status`` (``included``, ``no_v1_or_v2``, ``no_followup``).  ``keep_group``: the payloads also hold the visit's own group.

    A single ``groupBy(subject)``: one shuffle, partial aggregation map-side.
    """
    v = F.col(spec.visit)
    after = v > second if horizon is None else (v > second) & (v <= horizon)
    f1 = ["age", "mmse", "cdr", "nwbv", "etiv", "asf", "educ", "ses", "sex", "hand", *extra_static]
    f2 = ["age", "mmse", "cdr", "nwbv", "etiv", "asf", "delay"]
    if keep_group:
        f1, f2 = [*f1, "group"], [*f2, "group"]
    agg = panel.groupBy(spec.subject).agg(
        subject_group_expr(spec).alias(GROUP),
        _visit_struct(spec, first, f1).alias("_v1"),
        _visit_struct(spec, second, f2).alias("_v2"),
        F.max(F.when(after, F.col(spec.cdr))).alias("_max_after"),
        F.count_if(after).alias("_n_after"),
    )
    status = (F.when(F.col("_v1").isNull() | F.col("_v2").isNull(), F.lit("no_v1_or_v2"))
              .when(F.col("_n_after") == 0, F.lit("no_followup"))
              .otherwise(F.lit("included")))
    return agg.withColumn("status", status)


def participant_features(panel: DataFrame, spec: PanelSpec = PANEL, first: int = 1, second: int = 2,
                         horizon: int | None = None, extra_static: tuple[str, ...] = (), imputer: "GroupMedianImputer | None" = None) -> DataFrame:
    """F1+F2+F3+A3: the wide participant row with deltas and the look-ahead label.

    Subjects need visit numbers ``first`` and ``second`` (by number, not rank) and at least one
    visit after ``second``.  Label = 1 if the maximum severity after ``second`` exceeds the
    severity at ``second``; NULL comparisons give 0.

    With a fitted ``imputer`` the rows equal those over the imputed panel (F5), but only the two visits that a feature row
    holds are imputed, on the subject's row: the visit rows do not meet the medians.  The label reads the severity, so that
    must not be one of the imputed columns.
    """
    filled = imputer.columns if imputer else ()
    if "cdr" in filled:
        raise ValueError("the severity that the label compares cannot be imputed on the feature row")
    r = subject_rollup(panel, spec, first, second, horizon, extra_static, keep_group=bool(filled)).where(F.col("status") == "included")
    a, b = ({f: F.col(f"_v{v}")[f] for f in ("age", "mmse", "cdr", "nwbv", "etiv", "asf", *more)}
            for v, more in ((1, ("educ", "ses", "sex", "hand", *extra_static)), (2, ("delay",))))
    for v, fields in ((1, a), (2, b)):
        here = [c for c in filled if c in fields]
        if here:
            medians = imputer.table.select(F.col(imputer.spec.group).alias(f"_g{v}"), *[F.col(f"median_{c}").alias(f"_m{v}_{c}") for c in here])
            r = r.join(medians, F.col(f"_v{v}")["group"] == F.col(f"_g{v}"), "left")
            fields.update({c: F.coalesce(fields[c], F.col(f"_m{v}_{c}")) for c in here})
    cols = [F.col(spec.subject).alias("subject_id"), F.col(GROUP)]
    for src, stem in VISIT_FIELDS:
        cols.append(a[src].alias(f"{stem}_v1"))
    for src, stem in VISIT_FIELDS:
        cols.append(b[src].alias(f"{stem}_v2"))
    cols += [
        b["delay"].alias("mr_delay_v2"),
        (b["mmse"] - a["mmse"]).alias("mmse_delta_v1_v2"),
        (b["nwbv"] - a["nwbv"]).alias("nwbv_delta_v1_v2"),
        (b["cdr"] - a["cdr"]).alias("cdr_delta_v1_v2"),
        (b["age"] - a["age"]).alias("age_delta_v1_v2"),
        a["educ"].alias("education_years"),
        a["ses"].alias("ses"),
        a["sex"].alias("sex"),
        a["hand"].alias("handedness"),
        F.coalesce(F.col("_max_after") > b["cdr"], F.lit(False)).cast("int").alias(LABEL),
    ]
    cols += [a[e].alias(e) for e in extra_static]
    return r.select(*cols)


def features_wide(panel: DataFrame, spec: PanelSpec = PANEL, first: int = 1, second: int = 2) -> DataFrame:
    """one row per subject with both visit numbers: visit-1 / visit-2 fields, the visit-2
    delay and the static fields (no label requirement)."""
    r = subject_rollup(panel, spec, first, second).where(F.col("_v1").isNotNull() & F.col("_v2").isNotNull())
    a, b = F.col("_v1"), F.col("_v2")
    cols = [F.col(spec.subject).alias("subject_id"), F.col(GROUP)]
    cols += [a[src].alias(f"{stem}_v1") for src, stem in VISIT_FIELDS]
    cols += [b[src].alias(f"{stem}_v2") for src, stem in VISIT_FIELDS]
    cols += [b["delay"].alias("mr_delay_v2"), a["educ"].alias("education_years"), a["ses"].alias("ses"),
             a["sex"].alias("sex"), a["hand"].alias("handedness")]
    return r.select(*cols)


def delta_features(wide: DataFrame) -> DataFrame:
    """visit-2 minus visit-1 for MMSE, nWBV, CDR and age (NULL propagates)."""
    return wide.select("*", *[(F.col(f"{c}_v2") - F.col(f"{c}_v1")).alias(f"{c}_delta_v1_v2")
                              for c in ("mmse", "nwbv", "cdr", "age")])


def worsened_after_cutoff(panel: DataFrame, spec: PanelSpec = PANEL, cutoff: int = 2,
                          horizon: int | None = None) -> DataFrame:
    """per subject with a visit ``cutoff`` and at least one later visit: 1 if the maximum
    severity after the cutoff exceeds the severity at the cutoff, else 0 (NULLs give 0)."""
    v = F.col(spec.visit)
    after = v > cutoff if horizon is None else (v > cutoff) & (v <= horizon)
    at = F.min_by(F.col(spec.cdr), F.when(v == cutoff, F.struct(spec.visit_id)))
    has = F.count_if(v == cutoff)
    agg = panel.groupBy(spec.subject).agg(at.alias("_at"), has.alias("_has"),
                                          F.max(F.when(after, F.col(spec.cdr))).alias("_max"),
                                          F.count_if(after).alias("_n"))
    return agg.where((F.col("_has") > 0) & (F.col("_n") > 0)).select(
        F.col(spec.subject).alias("subject_id"),
        F.coalesce(F.col("_max") > F.col("_at"), F.lit(False)).cast("int").alias(LABEL))


def feature_build_report(panel: DataFrame, spec: PanelSpec = PANEL, **kw) -> DataFrame:
    """Subjects per status and, for included subjects, per label value."""
    r = subject_rollup(panel, spec, **kw)
    label = F.coalesce(F.col("_max_after") > F.col("_v2")["cdr"], F.lit(False)).cast("int")
    return r.groupBy("status").agg(
        F.count(F.lit(1)).alias("subjects"),
        F.count_if((F.col("status") == "included") & (label == 1)).alias("label_1"),
        F.count_if((F.col("status") == "included") & (label == 0)).alias("label_0"),
    )


def visit_feature_projection(features: DataFrame, include_categorical: bool = True) -> DataFrame:
    """P5: the 19 numeric features (+2 categoricals) and the label."""
    cols = NUMERIC_FEATURES + (CATEGORICAL_FEATURES if include_categorical else [])
    return features.select("subject_id", *cols, LABEL)


# ── A10 / J3 / F5: group-median imputation ───────────────────────────────────

def group_medians(panel: DataFrame, columns=("mmse", "ses"), spec: PanelSpec = PANEL,
                  approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """A10: median of each column per visit-row group, NULLs skipped (linear interpolation).

    Exact by default through the bucketed ranking (no group's values meet in one task);
    ``approx`` uses ``percentile_approx``.  Groups whose values are all NULL keep a NULL median.
    """
    g = spec.group
    rows = panel.where(F.col(g).isNotNull())
    if approx:
        return rows.groupBy(g).agg(*[F.percentile_approx(F.col(spec.signal(c)), 0.5, accuracy).alias(f"median_{c}")
                                     for c in columns])
    # all columns in one pass over the panel: (group, column, value) with counts, stored
    long = rows.select(g, F.inline(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(spec.signal(c)).cast("double").alias("_val")) for c in columns])))
    counts = value_counts(long, [g, "_col"], "_val")
    q = quantiles_of_counts(counts, [g, "_col"], "_val", [0.5])
    wide = q.groupBy(g).agg(*[F.max(F.when(F.col("_col") == c, F.col("q0"))).alias(f"median_{c}") for c in columns])
    # one row per group on both sides; groups with only NULL values keep NULL medians
    return counts.select(g).distinct().join(wide, g, "left")


class GroupMedianImputer:
    """fill NULLs of ``columns`` with the median of the row's group.

    ``fit`` computes the medians (one aggregate, partial per map task) and stores them;
    ``transform`` joins them back (left, so rows of a NULL group keep NULL values).  The median
    table has one row per group and is broadcast when it is checked to be small.  The reference
    fits on the whole panel before splitting; ``fit(train).transform(df)`` gives the
    leakage-free variant.
    """

    def __init__(self, columns=("mmse", "ses"), spec: PanelSpec = PANEL, approx: bool = False):
        self.columns = tuple(columns)
        self.spec = spec
        self.approx = approx
        self.table = None

    def fit(self, panel: DataFrame) -> "GroupMedianImputer":
        self.table = local_or_stored(group_medians(panel, self.columns, self.spec, self.approx), "medians")
        return self

    def transform(self, panel: DataFrame) -> DataFrame:
        joined = panel.join(self.table, self.spec.group, "left")
        for c in self.columns:
            name = self.spec.signal(c)
            joined = joined.withColumn(name, F.coalesce(F.col(name), F.col(f"median_{c}")))
        return joined.select(*panel.columns)


def impute_group_median(panel: DataFrame, columns=("mmse", "ses"), spec: PanelSpec = PANEL) -> DataFrame:
    return GroupMedianImputer(columns, spec).fit(panel).transform(panel)


# ── A13 / A14 / F6 / F7 ──────────────────────────────────────────────────────

def class_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n_negative / n_positive as a one-row DataFrame (NULL when there are no positives)."""
    y = F.col(label)
    return df.agg(
        F.count_if(y == 0).alias("n_negative"),
        F.count_if(y == 1).alias("n_positive"),
        F.try_divide(F.count_if(y == 0).cast("double"), F.count_if(y == 1).cast("double")).alias("class_weight"),
    )


def class_weight_value(df: DataFrame, label: str = LABEL) -> float:
    row = class_weight(df, label).first()
    if not row["n_positive"]:
        raise ValueError("training data has no positive labels: the positive class weight is undefined")
    return float(row["class_weight"])


# Continuous columns standardised for the joint-embedding model.
STANDARDISED_COLUMNS = [
    "mmse_v1", "mmse_v2", "cdr_v1", "cdr_v2",
    "nwbv_v1", "nwbv_v2", "etiv_v1", "etiv_v2",
    "asf_v1", "asf_v2",
    "age_v1", "age_v2", "education_years", "ses",
]


def column_moments(df: DataFrame, columns=STANDARDISED_COLUMNS) -> DataFrame:
    """Mean and sample standard deviation per column, long layout (column, mean, std)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) as (column, mean, std)")


class Standardiser:
    """(x - mean) / std with moments fitted on one frame; zero or NULL std leaves x as is."""

    def __init__(self, columns=STANDARDISED_COLUMNS):
        self.columns = list(columns)
        self.moments: dict[str, tuple] = {}

    def fit(self, df: DataFrame) -> "Standardiser":
        for r in column_moments(df, self.columns).collect():   # one row per column: bounded
            self.moments[r["column"]] = (r["mean"], r["std"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.moments:
                mean, std = self.moments[c]
                if std is not None and std > 0:
                    cols.append(((F.col(c).cast("double") - F.lit(mean)) / F.lit(std)).alias(c))
                    continue
            cols.append(F.col(c))
        return df.select(*cols)


class LabelEncoder:
    """sorted distinct categories of the fitting frame -> 0..k-1; unseen values raise, NULL stays NULL.

    The dictionary is a stored table (category, code), joined back; it is broadcast when it is
    checked to be small.  Codes are bucketed positions, so the categories are never sorted in one task."""

    def __init__(self, column: str, output: str | None = None):
        self.column = column
        self.output = output or column
        self.table = None

    def fit(self, df: DataFrame) -> "LabelEncoder":
        c = F.col(self.column)
        distinct = df.where(c.isNotNull()).select(c.alias("_category")).distinct()
        ranked = positions(distinct.withColumn("_all", F.lit(0)), ["_all"], "_category", [],
                           F.substring(F.col("_category").cast("string"), 1, 2) if dict(distinct.dtypes)["_category"] == "string" else F.lit(0), name="_p")
        self.table = bounded(stored(ranked.select("_category", (F.col("_p") - 1).cast("int").alias("_code")), "categories"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        joined = df.join(self.table, c == F.col("_category"), "left")
        unseen = F.raise_error(F.concat(F.lit(f"unseen category in {self.column}: "), c.cast("string")))
        code = F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_code"), unseen)).cast("int")
        return joined.withColumn("_out", code).drop("_category", "_code", *([self.output] if self.output in df.columns else [])) \
            .withColumnRenamed("_out", self.output)


# ── F8 / F9 / P6 ─────────────────────────────────────────────────────────────

def trajectory_change_table(features: DataFrame) -> DataFrame:
    """F8: per subject the visit-1 -> visit-2 pairs of MMSE, CDR and nWBV as text."""
    def pair(stem):
        return F.concat_ws(" -> ", F.col(f"{stem}_v1").cast("string"), F.col(f"{stem}_v2").cast("string"))
    return features.select("subject_id", GROUP, pair("mmse").alias("mmse_change"),
                           pair("cdr").alias("cdr_change"), pair("nwbv").alias("nwbv_change"), LABEL)


def delta_inspection(features: DataFrame, group: str | None = None) -> DataFrame:
    """the visit-1 and visit-2 values and the deltas by group, optionally for one group only."""
    pairs = [f"{c}_{v}" for c in ("mmse", "nwbv", "cdr") for v in ("v1", "v2")]
    out = features.select("subject_id", GROUP, *pairs, "mmse_delta_v1_v2", "nwbv_delta_v1_v2",
                          "cdr_delta_v1_v2", "age_delta_v1_v2", LABEL)
    if group is not None:
        out = out.where(F.col(GROUP) == group)
    return out


# Modality streams of the joint-embedding model (visit-1 / visit-2 columns).
MODALITIES = {
    "cognitive": (["mmse_v1", "cdr_v1"], ["mmse_v2", "cdr_v2"]),
    "brain": (["nwbv_v1", "etiv_v1", "asf_v1"], ["nwbv_v2", "etiv_v2", "asf_v2"]),
    "demographic": (["age_v1", "education_years", "ses", "sex_encoded"],
                    ["age_v2", "education_years", "ses", "sex_encoded"]),
}


def modality_arrays(features: DataFrame) -> DataFrame:
    """Per visit, the three modality vectors as ``array<float>``."""
    cols = [F.col("subject_id")]
    for name, (c1, c2) in MODALITIES.items():
        cols.append(F.array(*[F.col(c).cast("float") for c in c1]).alias(f"{name}_v1"))
        cols.append(F.array(*[F.col(c).cast("float") for c in c2]).alias(f"{name}_v2"))
    cols.append(F.col(LABEL).cast("float").alias("label"))
    return features.select(*cols)
