"""Panel, features, profile and cohort queries."""

from __future__ import annotations


from panelspark.plans import oracle as O
from panelspark.plans.queries.common import (
    BASE, IPANEL, PANEL_ONLY, SPLIT, SUBJ, features, ipanel, panel, query, sql, train_test,
)
from panelspark.operators import cohort as coh
from panelspark.operators import features as feat
from panelspark.operators import profile as prof


# ── S1 / F4 / F5 / A12 ───────────────────────────────────────────────────────

@query("read_panel", sql(*PANEL_ONLY, body="SELECT * FROM panel"))
def q_read_panel(spark, sf):
    return panel(spark, sf)


@query("participant_features", sql(*BASE, body="SELECT * FROM features"))
def q_participant_features(spark, sf):
    return features(spark, sf)


@query("impute_group_median", sql(*IPANEL, body="SELECT * FROM ipanel"))
def q_impute(spark, sf):
    return ipanel(spark, sf)



# ── profile (A1-A9, A19-A21, P10) ────────────────────────────────────────────




# SQL type names -> Spark type names.
SQL_TO_SPARK_TYPES = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
_TYPE_CASE = "CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SQL_TO_SPARK_TYPES.items()) + " ELSE lower(column_type) END"


@query("dataset_structure", sql(*PANEL_ONLY, body=f"""
SELECT cast(row_number() OVER () - 1 AS integer) AS position, column_name, {_TYPE_CASE} AS dtype,
       (SELECT count(*) FROM panel) AS n_rows, cast((SELECT count(*) FROM (DESCRIBE panel)) AS integer) AS n_columns
FROM (DESCRIBE panel)"""))
def q_dataset_structure(spark, sf):
    return prof.dataset_structure(panel(spark, sf))


@query("group_row_counts", sql(*PANEL_ONLY, body="SELECT grp, count(*) AS n_rows FROM panel WHERE grp IS NOT NULL GROUP BY grp"))
def q_group_row_counts(spark, sf):
    return prof.group_row_counts(panel(spark, sf))


@query("subject_group", sql(*SUBJ, body="SELECT subject_id, participant_group FROM sg_"))
def q_subject_group(spark, sf):
    return coh.subject_group(panel(spark, sf))


@query("subject_group_counts", sql(*SUBJ, body="SELECT participant_group, count(*) AS n_subjects FROM sg_ GROUP BY participant_group"))
def q_subject_group_counts(spark, sf):
    return prof.subject_group_counts(panel(spark, sf))


@query("visit_counts", sql(*PANEL_ONLY, body="SELECT subject_id, count(visit) AS num_visits FROM panel GROUP BY subject_id"))
def q_visit_counts(spark, sf):
    return prof.visit_counts(panel(spark, sf))


@query("visit_count_distribution", sql(*PANEL_ONLY, body="""
SELECT num_visits, count(*) AS n_subjects
FROM (SELECT subject_id, count(visit) AS num_visits FROM panel GROUP BY subject_id)
GROUP BY ROLLUP (num_visits)"""))
def q_visit_count_distribution(spark, sf):
    return prof.visit_count_distribution(panel(spark, sf))


@query("converter_summary", sql(*PANEL_ONLY, body="""
SELECT subject_id, count(*) AS total_visits,
       first(mmse ORDER BY visit, visit_id) AS baseline_mmse, first(cdr ORDER BY visit, visit_id) AS baseline_cdr,
       last(mmse ORDER BY visit, visit_id) AS final_mmse, last(cdr ORDER BY visit, visit_id) AS final_cdr,
       first(mmse ORDER BY visit, visit_id) - last(mmse ORDER BY visit, visit_id) AS mmse_drop_baseline_to_final
FROM panel GROUP BY subject_id HAVING bool_or(grp = 'Converted')"""))
def q_converter_summary(spark, sf):
    return coh.converter_summary(panel(spark, sf))


@query("missing_value_audit", sql(*PANEL_ONLY, body=O.missing_audit_sql("panel", O.PANEL_COLUMNS)))
def q_missing_value_audit(spark, sf):
    return prof.missing_value_audit(panel(spark, sf))


@query("exploration_summary", sql(*PANEL_ONLY, body="""
SELECT count(*) AS n_subjects, cast(sum(r) AS bigint) AS n_rows, count(*) FILTER (WHERE conv) AS n_converters,
       count(*) FILTER (WHERE v >= 3) AS n_subjects_3plus_visits, cast(sum(miss) AS bigint) AS n_missing_mmse,
       (SELECT array_to_string(list_sort(list(DISTINCT grp)), ', ') FROM panel) AS group_labels
FROM (SELECT subject_id, count(*) AS r, count(visit) AS v, bool_or(grp = 'Converted') AS conv,
             count(*) FILTER (WHERE mmse IS NULL) AS miss FROM panel GROUP BY subject_id)"""))
def q_exploration_summary(spark, sf):
    return prof.exploration_summary(panel(spark, sf))


@query("split_nulls_check", sql(*IPANEL, body="""
SELECT count(*) FILTER (WHERE mmse IS NULL) AS mmse_nulls, count(*) FILTER (WHERE ses IS NULL) AS ses_nulls FROM ipanel"""))
def q_split_nulls_check(spark, sf):
    return prof.split_nulls_check(ipanel(spark, sf))


@query("panel_cohort_counts", sql(*PANEL_ONLY, body="""
SELECT CASE WHEN GROUPING(synthetic) = 1 THEN 'combined' WHEN synthetic THEN 'generated' ELSE 'real' END AS cohort,
       count(DISTINCT subject_id) AS n_subjects, cast(sum(r) AS bigint) AS n_rows
FROM (SELECT synthetic, subject_id, count(*) AS r FROM panel GROUP BY synthetic, subject_id)
GROUP BY ROLLUP (synthetic)"""))
def q_panel_cohort_counts(spark, sf):
    return prof.panel_cohort_counts(panel(spark, sf))


@query("baseline_box_stats", sql(*SUBJ, body="""
, q_ AS (SELECT participant_group, metric, count(*) AS n,
               quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
        FROM l_ GROUP BY participant_group, metric)
SELECT q_.participant_group, q_.metric, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (WHERE value >= round(q1, 6) - 1.5 * (round(q3, 6) - round(q1, 6))) AS whisker_low,
       max(value) FILTER (WHERE value <= round(q3, 6) + 1.5 * (round(q3, 6) - round(q1, 6))) AS whisker_high,
       count(*) FILTER (WHERE value < round(q1, 6) - 1.5 * (round(q3, 6) - round(q1, 6))
                        OR value > round(q3, 6) + 1.5 * (round(q3, 6) - round(q1, 6))) AS n_outliers
FROM l_ JOIN q_ USING (participant_group, metric)
GROUP BY ALL""").replace("\n, q_ AS", ",\nl_ AS (SELECT participant_group, 'mmse' AS metric, mmse AS value FROM lpanel WHERE visit = 1 AND mmse IS NOT NULL UNION ALL SELECT participant_group, 'nwbv', nwbv FROM lpanel WHERE visit = 1 AND nwbv IS NOT NULL)\n, q_ AS", 1))
def q_baseline_box_stats(spark, sf):
    return prof.baseline_box_stats(panel(spark, sf))


_BOX_VALUES = ",\nl_ AS (SELECT subject_id, participant_group, 'mmse' AS metric, mmse AS value FROM lpanel WHERE visit = 1 AND mmse IS NOT NULL UNION ALL SELECT subject_id, participant_group, 'nwbv', nwbv FROM lpanel WHERE visit = 1 AND nwbv IS NOT NULL)"


@query("baseline_outliers", sql(*SUBJ, body=_BOX_VALUES + """
, q_ AS (SELECT participant_group, metric, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3
         FROM l_ GROUP BY participant_group, metric)
SELECT participant_group, metric, subject_id, value FROM l_ JOIN q_ USING (participant_group, metric)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""))
def q_baseline_outliers(spark, sf):
    return prof.baseline_outliers(panel(spark, sf))


@query("first_n_features", sql(*SPLIT, body="SELECT * EXCLUDE (split) FROM split1 WHERE split = 'test' ORDER BY subject_id LIMIT 10"))
def q_first_n_features(spark, sf):
    """P10 on the test frame."""
    return prof.first_n_features(train_test(spark, sf)[1])


@query("first_n_inspection", sql(*PANEL_ONLY, body="SELECT * FROM panel ORDER BY subject_id, visit, visit_id LIMIT 10"))
def q_first_n_inspection(spark, sf):
    return prof.first_n_inspection(panel(spark, sf))


# ── cohort (J1, J4, P1-P4, U4, W1, W3, C6, C7) ───────────────────────────────

@query("panel_with_subject_group", sql(*SUBJ, body="SELECT * FROM lpanel"))
def q_panel_with_subject_group(spark, sf):
    return coh.panel_with_subject_group(panel(spark, sf))


@query("visit_rows", sql(*PANEL_ONLY, body="SELECT * FROM panel WHERE visit = 1 QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY visit_id) = 1"))
def q_visit_rows(spark, sf):
    return coh.visit_rows(panel(spark, sf), 1)


@query("baseline_visits", sql(*SUBJ, body="SELECT * FROM lpanel WHERE visit = 1"))
def q_baseline_visits(spark, sf):
    return coh.baseline_visits(panel(spark, sf))


@query("after_cutoff", sql(*PANEL_ONLY, body="SELECT * FROM panel WHERE visit > 2"))
def q_after_cutoff(spark, sf):
    return coh.after_cutoff(panel(spark, sf))


@query("converter_rows", sql(*PANEL_ONLY, body="SELECT * FROM panel WHERE grp = 'Converted'"))
def q_converter_rows(spark, sf):
    return coh.converter_rows(panel(spark, sf))


@query("distinct_subjects", sql(*PANEL_ONLY, body="SELECT DISTINCT subject_id FROM panel WHERE grp = 'Converted'"))
def q_distinct_subjects(spark, sf):
    return coh.distinct_subjects(panel(spark, sf))


@query("subject_trajectories", sql(*PANEL_ONLY, O.features_cte("rawfeatures", imputed=False),
                                   body="SELECT * FROM panel WHERE subject_id IN (SELECT subject_id FROM rawfeatures WHERE cdr_worsened_after_v2 = 1)"))
def q_subject_trajectories(spark, sf):
    p = panel(spark, sf)
    pos = feat.participant_features(p).where("cdr_worsened_after_v2 = 1")
    return coh.subject_trajectories(p, pos)


@query("ordered_trajectory", sql(*PANEL_ONLY, body="SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY visit, visit_id) AS visit_rank FROM panel"))
def q_ordered_trajectory(spark, sf):
    return coh.ordered_trajectory(panel(spark, sf))


@query("visit_interval", sql(*PANEL_ONLY, body="""
SELECT subject_id, visit, visit_id, row_number() OVER w AS visit_rank,
       mr_delay - lag(mr_delay) OVER w AS interval_days,
       (mr_delay - lag(mr_delay) OVER w) / 365.0 AS interval_years, mr_delay AS cumulative_days
FROM panel WINDOW w AS (PARTITION BY subject_id ORDER BY visit, visit_id)"""))
def q_visit_interval(spark, sf):
    return coh.visit_interval(panel(spark, sf))


@query("metric_trajectories", sql(*SUBJ, body="""
SELECT participant_group, subject_id, visit, 'mmse' AS metric, mmse AS value FROM lpanel
UNION ALL SELECT participant_group, subject_id, visit, 'nwbv', nwbv FROM lpanel"""))
def q_metric_trajectories(spark, sf):
    return coh.metric_trajectories(panel(spark, sf))


@query("converter_trajectories", sql(*PANEL_ONLY, body="""
SELECT subject_id, visit, mmse FROM panel WHERE subject_id IN (SELECT subject_id FROM panel WHERE grp = 'Converted')"""))
def q_converter_trajectories(spark, sf):
    return coh.converter_trajectories(panel(spark, sf))
