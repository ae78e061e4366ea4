"""Subject-level labels, trajectories and visit selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.features import CONVERTED, subject_group_expr
from panelspark.operators.ranking import BUCKET_ROWS, positions
from panelspark.operators.small import join_spread
from panelspark.session import stored
from panelspark.spec import GROUP, PANEL, PanelSpec


def subject_group(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A3: (subject, participant_group) - 'Converted' if any visit has it, else the first visit's."""
    return panel.groupBy(spec.subject).agg(subject_group_expr(spec).alias(GROUP))


def panel_with_subject_group(panel: DataFrame, spec: PanelSpec = PANEL, co_located: bool = False) -> DataFrame:
    """Every visit row with its subject-level group.

    Aggregate (partial per map task) + equi-join on subject, not a window per subject.  The aggregate also counts the
    subject's rows, and a heavy subject's rows are dealt to several groups (``join_spread``).
    ``co_located``: the panel is a store bucketed by subject (``sources.io.read_panel_store``); both sides
    of the join then lie where they are needed, and nothing is exchanged.  A store has no NULL subjects."""
    if co_located:
        return panel.join(subject_group(panel, spec), spec.subject)
    groups = stored(panel.groupBy(spec.subject).agg(subject_group_expr(spec).alias(GROUP), F.count(F.lit(1)).alias("_n")), "subject-groups")
    return join_spread(panel, groups, spec.subject, "_n")


def subject_trajectories(panel: DataFrame, subjects: DataFrame, spec: PanelSpec = PANEL, co_located: bool = False) -> DataFrame:
    """All visits of the given subjects (semi join; replaces one scan per subject).

    Heavy subjects are dealt to several groups, as in J1; ``co_located`` as there."""
    wanted = subjects.select(spec.subject).distinct()
    if co_located:
        return panel.join(wanted, spec.subject, "left_semi")
    # counts of the wanted subjects only: a join of two tables with one row per subject
    counts = panel.groupBy(spec.subject).agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counts.join(wanted.withColumnRenamed(spec.subject, "_wanted"), F.col(spec.subject).eqNullSafe(F.col("_wanted")), "left_semi"), "wanted-subjects")
    return join_spread(panel, counted, spec.subject, "_n", "left_semi")


def visit_rows(panel: DataFrame, k: int, spec: PanelSpec = PANEL) -> DataFrame:
    """The row of visit number ``k`` per subject (lowest visit_id among duplicates, NULL lowest)."""
    cols = [c for c in panel.columns]
    picked = (panel.where(F.col(spec.visit) == k).groupBy(spec.subject)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols if c != spec.subject]),
                            F.struct(spec.visit_id)).alias("_r")))
    return picked.select(spec.subject, "_r.*").select(*cols)


def baseline_visits(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Visit-1 rows with the subject group."""
    return panel_with_subject_group(panel, spec).where(F.col(spec.visit) == 1)


def after_cutoff(panel: DataFrame, cutoff: int = 2, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows with visit number > cutoff."""
    return panel.where(F.col(spec.visit) > cutoff)


def converter_rows(panel: DataFrame, spec: PanelSpec = PANEL, converted: str = CONVERTED) -> DataFrame:
    """Visit rows labelled with the converter group."""
    return panel.where(F.col(spec.group) == converted)


def distinct_subjects(panel: DataFrame, spec: PanelSpec = PANEL, converted: str = CONVERTED) -> DataFrame:
    """U4: distinct ids of subjects with a converter row."""
    return converter_rows(panel, spec, converted).select(spec.subject).distinct()


def converter_summary(panel: DataFrame, spec: PanelSpec = PANEL, converted: str = CONVERTED) -> DataFrame:
    """Per converter subject the visit count, first and last MMSE / CDR and the MMSE drop.
    First/last by (visit, visit_id) via min_by/max_by: one aggregate, no per-subject filter."""
    order = F.struct(F.col(spec.visit), F.col(spec.visit_id))
    first = F.min_by(F.struct(F.col(spec.mmse).alias("m"), F.col(spec.cdr).alias("c")), order)
    last = F.max_by(F.struct(F.col(spec.mmse).alias("m"), F.col(spec.cdr).alias("c")), order)
    agg = panel.groupBy(spec.subject).agg(
        F.bool_or(F.col(spec.group) == converted).alias("_conv"),
        F.count(F.lit(1)).alias("total_visits"),
        first.alias("_f"), last.alias("_l"))
    return agg.where("_conv").select(
        F.col(spec.subject).alias("subject_id"), "total_visits",
        F.col("_f.m").alias("baseline_mmse"), F.col("_f.c").alias("baseline_cdr"),
        F.col("_l.m").alias("final_mmse"), F.col("_l.c").alias("final_cdr"),
        (F.col("_f.m") - F.col("_l.m")).alias("mmse_drop_baseline_to_final"))


def first_last_visit(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """First and last visit of every subject in (visit, visit_id) order, via min_by/max_by
    (partial aggregation, no sort of the trajectory)."""
    order = F.struct(F.col(spec.visit), F.col(spec.visit_id))
    row = F.struct(F.col(spec.visit).alias("visit"), F.col(spec.visit_id).alias("visit_id"),
                   F.col(spec.mmse).alias("mmse"), F.col(spec.cdr).alias("cdr"))
    agg = panel.groupBy(spec.subject).agg(F.min_by(row, order).alias("_f"), F.max_by(row, order).alias("_l"))
    return agg.select(F.col(spec.subject).alias("subject_id"),
                      F.col("_f.visit").alias("first_visit"), F.col("_f.visit_id").alias("first_visit_id"),
                      F.col("_f.mmse").alias("first_mmse"), F.col("_f.cdr").alias("first_cdr"),
                      F.col("_l.visit").alias("last_visit"), F.col("_l.visit_id").alias("last_visit_id"),
                      F.col("_l.mmse").alias("last_mmse"), F.col("_l.cdr").alias("last_cdr"))


def _visit_bucket(spec: PanelSpec, width: int):
    return F.floor(F.col(spec.visit) / F.lit(width)).cast("long")


def ordered_trajectory(panel: DataFrame, spec: PanelSpec = PANEL, width: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each visit row with its 1-based position in the subject's (visit, visit_id) order.
    Bucketed rank, so one subject with very many rows is split over visit ranges, and where a range holds more than
    ``bucket_rows`` of them (many rows of one visit number), at borders over (visit, visit_id)."""
    return positions(panel, [spec.subject], spec.visit, [spec.visit_id], _visit_bucket(spec, width),
                     name="visit_rank", bucket_rows=bucket_rows)


def visit_interval(panel: DataFrame, spec: PanelSpec = PANEL, width: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Days and years since the previous visit (NULL on the first) and the cumulative days."""
    p = positions(panel, [spec.subject], spec.visit, [spec.visit_id], _visit_bucket(spec, width),
                  carry=[spec.delay], name="visit_rank", bucket_rows=bucket_rows)
    d = F.col(spec.delay) - F.col(f"prev_{spec.delay}")
    return p.select(spec.subject, spec.visit, spec.visit_id, "visit_rank",
                    d.alias("interval_days"), (d / F.lit(365.0)).alias("interval_years"),
                    F.col(spec.delay).alias("cumulative_days"))


def metric_trajectories(panel: DataFrame, metrics=("mmse", "nwbv"), spec: PanelSpec = PANEL) -> DataFrame:
    """Long (participant_group, subject_id, visit, metric, value) for the plotted signals."""
    j = panel_with_subject_group(panel, spec)
    return j.select(GROUP, spec.subject, spec.visit, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(spec.signal(m)).cast("double").alias("value")) for m in metrics
    ])).alias("_m")).select(GROUP, spec.subject, spec.visit, "_m.metric", "_m.value")


def converter_trajectories(panel: DataFrame, spec: PanelSpec = PANEL, converted: str = CONVERTED) -> DataFrame:
    """(subject_id, visit, mmse) of subjects that have a converter row."""
    return subject_trajectories(panel, distinct_subjects(panel, spec, converted), spec) \
        .select(spec.subject, spec.visit, spec.mmse)
