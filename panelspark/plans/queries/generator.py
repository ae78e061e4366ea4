"""Generator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import oracle as O
from panelspark.plans.queries.common import (
    SUBJ, panel, query, sql,
)
from panelspark.operators import augment as aug
from panelspark.operators import profile as prof
from panelspark.session import stored


# ── augmentation (A22, G1-G7, U1) ────────────────────────────────────────────



def n_subjects(spark, sf) -> int:
    """Generated cohort size = number of real subjects, so the generator's work grows with the tables."""
    return panel(spark, sf).select("subject_id").distinct().count()


N_CTE = "nsub_ AS (SELECT count(DISTINCT subject_id) AS n FROM panel)"
SUBJECTS_CTE = f"""
gsub_ AS (
  SELECT i AS subject_index, printf('SYN_%04d', i + 1000) AS subject_id,
         CASE WHEN i < n - cast(floor(n * 0.2) AS bigint) - cast(floor(n * 0.4) AS bigint) THEN 'Nondemented'
              WHEN i < n - cast(floor(n * 0.2) AS bigint) THEN 'Demented' ELSE 'Converted' END AS participant_group
  FROM nsub_, range(n) t(i)),
gsub AS (
  SELECT *, cast(CASE WHEN participant_group IN ('Converted', 'Demented')
                      THEN CASE WHEN {O.U("'42|' || subject_id || '|n_visits'")} < 0.5 THEN 3
                                WHEN {O.U("'42|' || subject_id || '|n_visits'")} < 0.5 + 0.35 THEN 4 ELSE 5 END
                      ELSE CASE WHEN {O.U("'42|' || subject_id || '|n_visits'")} < 0.7 THEN 3 ELSE 4 END END AS integer) AS n_visits
  FROM gsub_)"""


def _nd(key, mean, std):
    ua = O.U(f"'42|' || subject_id || '|{key}|a'")
    ub = O.U(f"'42|' || subject_id || '|{key}|b'")
    return f"({mean} + {std} * sqrt(-2.0 * ln(1.0 - {ua})) * cos({2.0 * 3.141592653589793!r} * {ub}))"


def _clip(x, lo, hi):
    return f"least(greatest({x}, {lo}), {hi})"


PRIORS_VALUES = ", ".join(
    "(" + ", ".join([f"'{g}'"] + [repr(float(p[f])) for f in aug.PRIOR_FIELDS]) + ")" for g, p in aug.GROUP_PRIORS.items())
PRIORS_CTE = f"pri_ AS (SELECT * FROM (VALUES {PRIORS_VALUES}) t(participant_group, {', '.join(aug.PRIOR_FIELDS)}))"
STAGE_DRAW = f"""CASE WHEN s.participant_group = 'Demented'
              THEN CASE WHEN {O.U("'42|' || subject_id || '|cdr0'")} < 0.65 THEN 0.5
                        WHEN {O.U("'42|' || subject_id || '|cdr0'")} < 0.65 + 0.30 THEN 1.0
                        WHEN {O.U("'42|' || subject_id || '|cdr0'")} < 0.65 + 0.30 + 0.05 THEN 2.0 ELSE 2.0 END
              ELSE 0.0 END::double"""


def _baseline_cte(priors: str, stage: str) -> str:
    """The baseline draws from the priors in pri_ (given as a CTE) and an expression for the first stage."""
    return f"""
{priors},
gbase_raw AS (
  SELECT s.subject_index, s.subject_id, s.participant_group, s.n_visits,
         cast(floor({_clip(_nd("1|age", "age_mean", "age_std"), 60.0, 96.0)}) AS integer) AS age0,
         {_clip(_nd("1|mmse", "mmse_v1_mean", "mmse_v1_std"), 0.0, 30.0)} AS mmse0,
         {_clip(_nd("1|nwbv", "nwbv_v1_mean", "nwbv_v1_std"), 0.60, 0.85)} AS nwbv0,
         cast(floor({_clip(_nd("1|etiv", "etiv_mean", "etiv_std"), 1100.0, 1900.0)}) AS integer) AS etiv,
         round(1430.0 / floor({_clip(_nd("1|etiv", "etiv_mean", "etiv_std"), 1100.0, 1900.0)}), 3) AS asf,
         {stage} AS cdr0,
         cast(floor({_clip(_nd("1|educ", "educ_mean", "educ_std"), 6.0, 23.0)}) AS integer) AS educ,
         {_clip("round_even(" + _nd("1|ses", "ses_mean", "ses_std") + ", 0)", 1.0, 5.0)} AS ses,
         CASE WHEN {O.U("'42|' || subject_id || '|sex'")} < female_prob THEN 'F' ELSE 'M' END AS sex,
         mmse_annual_delta_mean AS mmu_, mmse_annual_delta_std AS msd_, nwbv_annual_delta_mean AS nmu_,
         nwbv_annual_delta_std AS nsd_
  FROM gsub s JOIN pri_ USING (participant_group)),
gbase AS (SELECT subject_index, subject_id, participant_group, n_visits, age0, round(mmse0, 6) AS mmse0,
                 round(nwbv0, 6) AS nwbv0, etiv, asf, cdr0, educ, ses, sex FROM gbase_raw)"""


BASELINE_CTE = _baseline_cte(PRIORS_CTE, STAGE_DRAW)

DRAWS_CTE = f"""
gdraw_ AS (
  SELECT subject_id, k,
         cast(floor({_clip(_nd("' || k || '|interval", 730.0, 180.0), 365.0, 1460.0)}) AS integer) AS iv_,
         {_nd("' || k || '|mmse_step", 0.0, 1.0)} AS zm_,
         {_nd("' || k || '|nwbv_step", 0.0, 1.0)} AS zn_,
         {O.U("'42|' || subject_id || '|' || k || '|cdr'")} AS uc_
  FROM gsub, range(2, n_visits + 1) t(k)),
walk_ AS (
  WITH RECURSIVE w(subject_id, participant_group, n_visits, mmu_, msd_, nmu_, nsd_, visit, days, mmse, nwbv, cdr) AS (
    SELECT subject_id, participant_group, n_visits, mmu_, msd_, nmu_, nsd_, 1, 0, mmse0, nwbv0, cdr0 FROM gbase_raw
    UNION ALL
    SELECT w.subject_id, w.participant_group, w.n_visits, w.mmu_, w.msd_, w.nmu_, w.nsd_, d.k, w.days + d.iv_,
           least(greatest(w.mmse + w.mmu_ * (d.iv_::double / 365.0::double)
                          + w.msd_ * sqrt(d.iv_::double / 365.0::double) * d.zm_, 0.0), 30.0),
           least(greatest(w.nwbv + w.nmu_ * (d.iv_::double / 365.0::double)
                          + w.nsd_ * sqrt(d.iv_::double / 365.0::double) * d.zn_, 0.60), 0.85),
           CASE WHEN w.participant_group = 'Converted' THEN
                     CASE WHEN w.cdr = 0.0 AND d.uc_ < 0.4::double + (d.k::double / w.n_visits::double) * 0.4::double THEN 0.5
                          WHEN w.cdr >= 0.5 AND d.uc_ < 0.15::double AND w.cdr IN (0.0, 0.5, 1.0)
                               THEN CASE w.cdr WHEN 0.0 THEN 0.5 WHEN 0.5 THEN 1.0 ELSE 2.0 END
                          WHEN w.cdr >= 0.5 AND d.uc_ < 0.15::double AND w.cdr NOT IN (0.0, 0.5, 1.0, 2.0) THEN 1.0
                          ELSE w.cdr END
                WHEN w.participant_group = 'Demented' THEN
                     CASE WHEN d.uc_ < 0.20::double AND w.cdr IN (0.0, 0.5, 1.0)
                               THEN CASE w.cdr WHEN 0.0 THEN 0.5 WHEN 0.5 THEN 1.0 ELSE 2.0 END
                          WHEN d.uc_ < 0.20::double AND w.cdr NOT IN (0.0, 0.5, 1.0, 2.0) THEN 1.0
                          ELSE w.cdr END
                ELSE CASE WHEN d.uc_ < 0.03::double THEN 0.5 ELSE w.cdr END END
    FROM w JOIN gdraw_ d ON d.subject_id = w.subject_id AND d.k = w.visit + 1)
  SELECT * FROM w),
gpanel AS (
  SELECT w.subject_id, w.subject_id || '_MR' || cast(w.visit AS varchar) AS visit_id, w.participant_group AS grp,
         cast(w.visit AS integer) AS visit, cast(w.days AS integer) AS mr_delay, b.sex, 'R' AS hand,
         cast(b.age0 + cast(floor(w.days / 365) AS integer) AS integer) AS age, b.educ, b.ses,
         round(w.mmse, 1) AS mmse, cast(w.cdr AS double) AS cdr, b.etiv, round(w.nwbv, 3) AS nwbv, b.asf, true AS synthetic
  FROM walk_ w JOIN gbase_raw b USING (subject_id))"""
GEN = [O.PANEL_CTE, N_CTE, SUBJECTS_CTE]


@query("generate_subjects", sql(*GEN, body="SELECT * FROM gsub"))
def q_generate_subjects(spark, sf):
    return aug.generate_subjects(spark, n_subjects(spark, sf))


def _baseline(spark, sf):
    b = aug.generate_baseline(aug.generate_subjects(spark, n_subjects(spark, sf)), aug.priors_frame(spark))
    return b.select("subject_index", "subject_id", "participant_group", "n_visits", "age0",
                    F.round("mmse0", 6).alias("mmse0"), F.round("nwbv0", 6).alias("nwbv0"), "etiv", "asf", "cdr0",
                    "educ", "ses", "sex")


@query("generate_baseline", sql(*GEN, BASELINE_CTE, body="SELECT * FROM gbase"))
def q_generate_baseline(spark, sf):
    return _baseline(spark, sf)


@query("generate_visit_times", sql(*GEN, body=f"""
, v_ AS (SELECT subject_id, v AS visit,
                CASE WHEN v = 1 THEN 0 ELSE cast(floor({_clip(_nd("' || v || '|interval", 730.0, 180.0), 365.0, 1460.0)}) AS integer) END AS interval_days
         FROM gsub, range(1, n_visits + 1) t(v))
SELECT subject_id, cast(visit AS integer) AS visit, interval_days, interval_days / 365.0 AS years,
       cast(sum(interval_days) OVER (PARTITION BY subject_id ORDER BY visit) AS integer) AS cumulative_days
FROM v_"""))
def q_generate_visit_times(spark, sf):
    from pyspark.sql import Window
    b = aug.generate_baseline(aug.generate_subjects(spark, n_subjects(spark, sf)), aug.priors_frame(spark))
    v = aug.generate_visit_times(b)
    # a generated subject has at most 5 visits: this window's partitions are bounded
    w = Window.partitionBy("subject_id").orderBy("visit")
    return v.select("subject_id", "visit", "interval_days", (F.col("interval_days") / 365.0).alias("years"),
                    F.sum("interval_days").over(w).cast("int").alias("cumulative_days"))


@query("generate_panel", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="SELECT * FROM gpanel"))
def q_generate_panel(spark, sf):
    return aug.generate_panel(spark, n_subjects(spark, sf))


@query("union_real_generated", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="""
SELECT subject_id, visit_id, grp, visit, mr_delay, sex, hand, age, educ, ses, mmse, cdr, etiv, nwbv, asf, false AS synthetic FROM panel
UNION ALL SELECT * FROM gpanel"""))
def q_union_real_generated(spark, sf):
    return aug.union_real_generated(panel(spark, sf), aug.generate_panel(spark, n_subjects(spark, sf)))


@query("group_row_counts_augmented", sql(*GEN, BASELINE_CTE, DRAWS_CTE, body="""
SELECT grp, count(*) AS n_rows FROM (SELECT grp FROM panel UNION ALL SELECT grp FROM gpanel) WHERE grp IS NOT NULL GROUP BY grp"""))
def q_group_row_counts_augmented(spark, sf):
    """A2 on the augmented panel (real rows flagged, generated rows appended)."""
    return prof.group_row_counts(aug.union_real_generated(panel(spark, sf), aug.generate_panel(spark, n_subjects(spark, sf))))


PRIOR_SQL = """
, base_ AS (SELECT * FROM lpanel WHERE visit = 1),
st_ AS (SELECT participant_group,
               avg(age::double) AS age_mean, stddev_samp(age::double) AS age_std,
               avg(mmse) AS mmse_v1_mean, stddev_samp(mmse) AS mmse_v1_std,
               avg(nwbv) AS nwbv_v1_mean, stddev_samp(nwbv) AS nwbv_v1_std,
               avg(etiv::double) AS etiv_mean, stddev_samp(etiv::double) AS etiv_std,
               avg(educ::double) AS educ_mean, stddev_samp(educ::double) AS educ_std,
               avg(ses) AS ses_mean, stddev_samp(ses) AS ses_std,
               avg(CASE WHEN sex = 'F' THEN 1.0 WHEN sex IS NOT NULL THEN 0.0 END) AS female_prob
        FROM base_ GROUP BY participant_group),
pr_ AS (SELECT participant_group, (mr_delay - lag(mr_delay) OVER w) / 365.0 AS y_,
               mmse - lag(mmse) OVER w AS dm_, nwbv - lag(nwbv) OVER w AS dn_
        FROM lpanel WINDOW w AS (PARTITION BY subject_id ORDER BY visit, visit_id)),
ch_ AS (SELECT participant_group,
               avg(CASE WHEN y_ > 0 THEN dm_ / y_ END) AS mmse_annual_delta_mean,
               stddev_samp(CASE WHEN y_ > 0 THEN dm_ / sqrt(y_) END) AS mmse_annual_delta_std,
               avg(CASE WHEN y_ > 0 THEN dn_ / y_ END) AS nwbv_annual_delta_mean,
               stddev_samp(CASE WHEN y_ > 0 THEN dn_ / sqrt(y_) END) AS nwbv_annual_delta_std
        FROM pr_ GROUP BY participant_group)
SELECT participant_group, """ + ", ".join(f"round({c}, 6) AS {c}" for c in aug.PRIOR_FIELDS) + """
FROM st_ LEFT JOIN ch_ USING (participant_group)"""


@query("fit_generation_priors", sql(*SUBJ, body=PRIOR_SQL))
def q_fit_generation_priors(spark, sf):
    return aug.fit_generation_priors(panel(spark, sf))


@query("baseline_cdr_frequencies", sql(*SUBJ, body="""
SELECT participant_group, cdr, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY participant_group), 6) AS share
FROM lpanel WHERE visit = 1 GROUP BY participant_group, cdr"""))
def q_baseline_cdr_frequencies(spark, sf):
    return aug.baseline_cdr_frequencies(panel(spark, sf))


# priors fitted on the panel, with the published ones where a group's rows tell nothing
_SCALE = ", ".join(repr(x) for x in aug.CDR_SCALE)
_PUBLISHED_STAGES = ", ".join(f"('{g}', {p['cdr_v1_options']}, {p['cdr_v1_probs']})" for g, p in aug.GROUP_PRIORS.items())
FITTED_CTE = f"""
fit_ AS ({PRIOR_SQL.replace(', base_ AS', 'WITH base_ AS', 1)}),
pub_ AS (SELECT * FROM (VALUES {PRIORS_VALUES}) t(participant_group, {', '.join(aug.PRIOR_FIELDS)})),
stage_ AS (SELECT participant_group, cdr, count(*) AS n_ FROM lpanel WHERE visit = 1 AND cdr IN ({_SCALE}) GROUP BY ALL),
drawn_ AS (SELECT participant_group, list(cdr ORDER BY cdr) AS options_, list(round(n_ / t_, 6) ORDER BY cdr) AS probs_
           FROM (SELECT *, sum(n_) OVER (PARTITION BY participant_group) AS t_ FROM stage_) GROUP BY participant_group),
stages_ AS (SELECT p.participant_group, coalesce(d.options_, p.o_::double[]) AS options_, coalesce(d.probs_, p.p_::double[]) AS probs_
            FROM (VALUES {_PUBLISHED_STAGES}) p(participant_group, o_, p_) LEFT JOIN drawn_ d USING (participant_group)),
pri_ AS (SELECT p.participant_group, {', '.join(f'coalesce(f.{c}, p.{c}) AS {c}' for c in aug.PRIOR_FIELDS)}, options_, probs_
         FROM pub_ p LEFT JOIN fit_ f USING (participant_group) JOIN stages_ USING (participant_group))"""
_CDR_U = O.U("'42|' || subject_id || '|cdr0'")
FITTED_STAGE = (f"coalesce(options_[list_position(list_transform(range(1, len(probs_) + 1), lambda i: {_CDR_U} < list_sum(probs_[1:i])), true)], "
                "options_[len(options_)])")
GEN_FITTED = [O.PANEL_CTE, O.SUBJ_CTE, N_CTE, SUBJECTS_CTE, _baseline_cte(FITTED_CTE, FITTED_STAGE)]


@query("fitted_priors", sql(O.PANEL_CTE, O.SUBJ_CTE, FITTED_CTE, body=f"SELECT participant_group, {', '.join(aug.PRIOR_FIELDS)} FROM pri_"))
def q_fitted_priors(spark, sf):
    """The priors that the panel's own statistics give the generator."""
    return aug.fitted_priors(panel(spark, sf)).drop("cdr_v1_options", "cdr_v1_probs")


@query("generate_panel_fitted", sql(*GEN_FITTED, DRAWS_CTE, body="SELECT * FROM gpanel"))
def q_generate_panel_fitted(spark, sf):
    """G7 from priors fitted on the panel."""
    p = panel(spark, sf)
    return aug.generate_panel(spark, n_subjects(spark, sf), priors=stored(aug.fitted_priors(p), "priors"))
