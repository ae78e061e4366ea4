"""Sources and sinks as round trips (S1-S8), and the jobs R3 and R7 as rows.

Each query writes the bound tables in the format of its sink below the shared folder, reads them back
through the library's reader, and returns what it read."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from panelspark.plans import jobs
from panelspark.plans.queries.common import PANEL_ONLY, PRED, REGISTRY, SPLIT, SUBJ, new_folder, panel, predictions, query, split_features, sql
from panelspark.plans.queries.evaluation import comparison
from panelspark.operators import cohort as coh
from panelspark.operators import evaluate as ev
from panelspark.session import stored
from panelspark.sources import io
from panelspark.spec import CSV_HEADER_TO_PANEL

ALL_PANEL = sql(*PANEL_ONLY, body="SELECT * FROM panel")


@query("read_panel_csv", ALL_PANEL)
def q_read_panel_csv(spark, sf):
    """The panel as a study CSV (padded study headers, missing values as a token) and back."""
    path = new_folder(spark, "study-csv")
    header = {v: f" {k} " for k, v in CSV_HEADER_TO_PANEL.items()}
    p = panel(spark, sf)
    text = p.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(header[c]) for c in p.columns])
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_panel(spark, path)


# one cell in 17 of three columns is spoilt, by the visit's key
SPOILT = {"age": ("old", 0), "mmse": ("2x", 5), "visit": ("first", 11)}


def _spoilt(c: str) -> str:
    return f"(cast(visit_id as bigint) % 17 = {SPOILT[c][1]})"


def _spoilt_csv(spark, sf) -> str:
    path = new_folder(spark, "spoilt-csv")
    p = panel(spark, sf)
    text = p.select(*[F.coalesce(F.when(F.expr(_spoilt(c)), SPOILT[c][0]) if c in SPOILT else F.lit(None), F.col(c).cast("string"), F.lit("NA"))
                      .alias({v: k for k, v in CSV_HEADER_TO_PANEL.items()}[c]) for c in p.columns])
    text.write.option("header", True).csv(path)
    return path


@query("read_panel_lenient", sql(*PANEL_ONLY, body=f"""
SELECT * REPLACE (CASE WHEN {_spoilt('age')} THEN NULL ELSE age END AS age, CASE WHEN {_spoilt('mmse')} THEN NULL ELSE mmse END AS mmse)
FROM panel WHERE NOT {_spoilt('visit')}"""))
def q_read_panel_lenient(spark, sf):
    """S1, lenient: unreadable cells are NULL, rows without a visit number are left out."""
    return io.read_panel_with_rejects(spark, _spoilt_csv(spark, sf)).panel


@query("read_panel_rejects", sql(*PANEL_ONLY, body=" UNION ALL ".join(
    f"SELECT subject_id, visit_id, '{c}' AS column_name, '{text}' AS text FROM panel WHERE {_spoilt(c)}" for c, (text, _) in SPOILT.items())))
def q_read_panel_rejects(spark, sf):
    """S1, lenient: the rejected cells."""
    return io.read_panel_with_rejects(spark, _spoilt_csv(spark, sf)).rejects.select("subject_id", "visit_id", "column_name", "text")


@query("panel_store_round_trip", sql(*SUBJ, body="SELECT * FROM lpanel"))
def q_panel_store(spark, sf):
    """A panel store bucketed by subject, read back with its subject groups (J1) without an exchange."""
    name = f"panel_store_{uuid.uuid4().hex}"
    io.write_panel_store(panel(spark, sf), name, 8, new_folder(spark, "panel-store"))
    return coh.panel_with_subject_group(io.read_panel_store(spark, name), co_located=True)


@query("feature_splits_round_trip", sql(*SPLIT, body="SELECT * FROM split1"))
def q_feature_splits(spark, sf):
    """Feature rows partitioned by split, read back split by split."""
    path = new_folder(spark, "feature-splits")
    io.write_feature_splits(split_features(spark, sf), path)
    return io.read_feature_splits(spark, path, "train").unionByName(io.read_feature_splits(spark, path, "test"))


@query("augmented_panel_round_trip", ALL_PANEL)
def q_augmented_panel(spark, sf):
    """Real and generated rows in one panel."""
    path = new_folder(spark, "augmented")
    io.write_augmented_panel(panel(spark, sf), path)
    return io.read_panel(spark, path, "parquet")


@query("predictions_round_trip", sql(*PRED, body="SELECT model, subject_id, participant_group, y, yhat, score FROM predictions"))
def q_predictions(spark, sf):
    """Long predictions, one folder per model; written model by model, as the jobs do, and one of them twice."""
    path = new_folder(spark, "predictions")
    every = predictions(spark, sf)
    for model in ("text", "boosted", "joint", "boosted"):
        io.write_predictions(every.where(F.col("model") == model), path)
    return io.read_predictions(spark, path).select("model", "subject_id", "participant_group", "y", "yhat", "score")


@query("metrics_round_trip", REGISTRY["classification_metrics"][1])
def q_metrics(spark, sf):
    """One metrics row per model."""
    path = new_folder(spark, "metrics")
    metrics = stored(ev.classification_metrics(predictions(spark, sf)), "metrics")
    for model in ("text", "boosted", "joint"):
        io.write_metrics(metrics.where(F.col("model") == model), path)
    return io.read_metrics(spark, path)


@query("comparison_round_trip", REGISTRY["compare_predictions"][1])
def q_comparison(spark, sf):
    """The per-subject comparison."""
    path = new_folder(spark, "comparison")
    io.write_comparison(comparison(spark, sf), path)
    return spark.read.parquet(path)


@query("read_first_existing", ALL_PANEL)
def q_read_first_existing(spark, sf):
    """The second of three paths exists."""
    path = new_folder(spark, "first-existing")
    io.write_augmented_panel(panel(spark, sf), path)
    return io.read_first_existing(spark, [new_folder(spark, "absent"), path, new_folder(spark, "absent")], "parquet")


@query("job_preprocess", sql(*SPLIT, body="SELECT * FROM split1"))
def q_job_preprocess(spark, sf):
    """Impute, features and label, exact split, written and read back."""
    path = new_folder(spark, "preprocessed")
    jobs.job_preprocess(panel(spark, sf), out=path)
    return io.read_feature_splits(spark, path)


# (table of the job, registered query with the same rows, item, measures); items and measures are SQL of both engines
EXPLORATION = [
    ("structure", "dataset_structure", "column_name", ["position", "n_rows", "n_columns"]),
    ("group_rows", "group_row_counts", "grp", ["n_rows"]),
    ("subject_groups", "subject_group_counts", "participant_group", ["n_subjects"]),
    ("visit_counts", "visit_counts", "subject_id", ["num_visits"]),
    ("visit_distribution", "visit_count_distribution", "coalesce(cast(num_visits as {text}), 'total')", ["n_subjects"]),
    ("converters", "converter_summary", "subject_id", ["total_visits", "baseline_mmse", "baseline_cdr", "final_mmse", "final_cdr",
                                                       "mmse_drop_baseline_to_final"]),
    ("missing", "missing_value_audit", "column_name", ["null_count", "null_pct"]),
    ("summary", "exploration_summary", "group_labels", ["n_subjects", "n_rows", "n_converters", "n_subjects_3plus_visits", "n_missing_mmse"]),
    ("cohorts", "panel_cohort_counts", "cohort", ["n_subjects", "n_rows"]),
    ("baseline_box", "baseline_box_stats", "participant_group || '|' || metric",
     ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]),
    ("trajectories", "metric_trajectories", "participant_group || '|' || subject_id || '|' || cast(visit as {text}) || '|' || metric", ["value"]),
    ("converter_trajectories", "converter_trajectories", "subject_id || '|' || cast(visit as {text})", ["mmse"]),
]


def _exploration_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, {item.format(text='varchar')} AS item, '{m}' AS measure, round(cast({m} AS double), 6) AS value\n"
        f"FROM ({REGISTRY[key][1]})" for name, key, item, measures in EXPLORATION for m in measures)


@query("job_exploration", _exploration_sql())
def q_job_exploration(spark, sf):
    """All tables of the exploration job in long form (report, item, measure, value)."""
    tables = jobs.job_exploration(panel(spark, sf))
    out = []
    for name, _, item, measures in EXPLORATION:
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in measures)
        out.append(tables[name].selectExpr(f"'{name}' as report", f"{item.format(text='string')} as item",
                                           f"stack({len(measures)}, {pairs}) as (measure, value)").withColumn("value", F.round("value", 6)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("job_comparison", REGISTRY["comparison_notes"][1])
def q_job_comparison(spark, sf):
    """The comparison job; its notes."""
    return jobs.job_comparison(predictions(spark, sf), panel(spark, sf))["notes"]
