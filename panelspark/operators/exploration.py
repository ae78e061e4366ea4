"""All profile tables of a panel from two scans of it (job R1).

Scan 1 rolls the panel up to (subject, group, generated?) and stores that table; the row count and the
NULL counts of all columns are observed on the same scan.  Every count table (A1, A2, A4-A9, A20)
is derived from the rollup.  Scan 2 stores the narrow rows that are plotted, each with its subject's
group; the trajectories and box statistics (C6, C7, A21) are derived from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from panelspark.operators import profile as prof
from panelspark.operators.features import CONVERTED
from panelspark.operators.small import join_per_key
from panelspark.session import stored
from panelspark.spec import GROUP, PANEL, PanelSpec


class Exploration:
    """The profile of one panel; every property is a DataFrame over the stored tables.

    Results equal those of the single operators.  An empty panel gives their empty results; NULL subjects
    and groups are keys like any other."""

    def __init__(self, panel: DataFrame, spec: PanelSpec = PANEL, metrics=("mmse", "nwbv"), converted: str = CONVERTED):
        self.panel, self.spec, self.metrics, self.converted = panel, spec, tuple(metrics), converted
        self.spark = panel.sparkSession
        seen = Observation()
        order = F.struct(F.col(spec.visit), F.col(spec.visit_id))
        ends = F.struct(F.col(spec.mmse).alias("mmse"), F.col(spec.cdr).alias("cdr"))
        self.keys = [c for c in (spec.subject, spec.group, spec.synthetic) if c in panel.columns]
        watched = panel.observe(seen, F.count(F.lit(1)).alias("rows"), *[prof.null_count(panel, c).alias(f"n{i}") for i, c in enumerate(panel.columns)])
        self.parts = stored(watched.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("_rows"), F.count(spec.visit).alias("_visits"), F.count_if(F.col(spec.mmse).isNull()).alias("_miss"),
            F.min(order).alias("_begin"), F.max(order).alias("_end"),
            F.min_by(ends, order).alias("_first"), F.max_by(ends, order).alias("_last")), "exploration-parts")
        self.seen = seen.get
        self._labelled = self._subjects = None

    @property
    def subjects(self) -> DataFrame:
        """One row per subject: group, converter flag, counts, first and last values."""
        if self._subjects is None:
            g = F.col(self.spec.group)
            conv = F.bool_or(g == F.lit(self.converted))
            self._subjects = stored(self.parts.groupBy(self.spec.subject).agg(
                F.when(conv, F.lit(self.converted)).otherwise(F.min_by(g, "_begin")).alias(GROUP), conv.alias("_conv"),
                F.sum("_rows").alias("_rows"), F.sum("_visits").alias("_visits"),
                F.min_by("_first", "_begin").alias("_first"), F.max_by("_last", "_end").alias("_last")), "exploration-subjects")
        return self._subjects

    @property
    def labelled(self) -> DataFrame:
        """Scan 2: subject, group, visit and the plotted signals of every row."""
        if self._labelled is None:
            s = self.spec
            wanted = dict.fromkeys([s.subject, s.visit, s.mmse, *[s.signal(m) for m in self.metrics]])
            self._labelled = stored(join_per_key(self.panel.select(*wanted), self.subjects.select(s.subject, GROUP, "_conv"), s.subject), "exploration-rows")
        return self._labelled

    def structure(self) -> DataFrame:
        """A1."""
        return prof.structure_of(self.panel, self.seen["rows"])

    def missing(self) -> DataFrame:
        """A8."""
        n = self.seen["rows"]
        rows = [(c, self.seen[f"n{i}"], n) for i, c in enumerate(self.panel.columns)]       # one row per column
        table = self.spark.createDataFrame(rows, "column_name string, null_count long, n long")
        return table.where("null_count > 0").select("column_name", "null_count", F.round(F.col("null_count") * 100.0 / F.col("n"), 2).alias("null_pct"))

    def group_rows(self) -> DataFrame:
        """A2."""
        g = self.spec.group
        return self.parts.where(F.col(g).isNotNull()).groupBy(g).agg(F.sum("_rows").alias("n_rows"))

    def subject_groups(self) -> DataFrame:
        """A4."""
        return self.subjects.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_subjects"))

    def visit_counts(self) -> DataFrame:
        """A5."""
        return self.subjects.select(self.spec.subject, F.col("_visits").alias("num_visits"))

    def visit_distribution(self) -> DataFrame:
        """A6."""
        return self.visit_counts().rollup("num_visits").agg(F.count(F.lit(1)).alias("n_subjects"))

    def converters(self) -> DataFrame:
        """A7."""
        return self.subjects.where("_conv").select(
            F.col(self.spec.subject).alias("subject_id"), F.col("_rows").alias("total_visits"),
            F.col("_first.mmse").alias("baseline_mmse"), F.col("_first.cdr").alias("baseline_cdr"),
            F.col("_last.mmse").alias("final_mmse"), F.col("_last.cdr").alias("final_cdr"),
            (F.col("_first.mmse") - F.col("_last.mmse")).alias("mmse_drop_baseline_to_final"))

    def summary(self) -> DataFrame:
        """A9."""
        return prof.summary_of(self.parts, self.spec, self.converted)

    def cohorts(self) -> DataFrame:
        """A20 (needs the generated flag)."""
        return prof.cohorts_of(self.parts, self.spec)

    def trajectories(self) -> DataFrame:
        """C6."""
        s = self.spec
        long = self.labelled.select(GROUP, s.subject, s.visit, F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(s.signal(m)).cast("double").alias("value")) for m in self.metrics])))
        return long.select(GROUP, s.subject, s.visit, "metric", "value")

    def converter_trajectories(self) -> DataFrame:
        """C7."""
        s = self.spec
        return self.labelled.where("_conv").select(s.subject, s.visit, s.mmse)

    def baseline_box(self) -> DataFrame:
        """A21."""
        return prof.box_stats_of(prof.baseline_values_of(self.labelled, self.metrics, self.spec))

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name."""
        names = ["structure", "group_rows", "subject_groups", "visit_counts", "visit_distribution", "converters", "missing", "summary",
                 "trajectories", "converter_trajectories", "baseline_box"]
        if self.spec.synthetic in self.panel.columns:
            names.append("cohorts")
        return {n: getattr(self, n)() for n in names}
