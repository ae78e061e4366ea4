"""Equivalent SQL (DuckDB dialect) for the registered queries.

The driver's tables are views named after the parquet files.  ``PANEL_CTE`` is the same
binding as ``panelspark.sources.bindings.panel``; the other CTEs build on it.
"""

from __future__ import annotations


def U(key: str) -> str:
    """Keyed uniform in DuckDB, equal to ``functions.keyed_uniform``."""
    return f"(cast(('0x' || substr(md5({key}), 1, 8)) as bigint) / cast(4294967296 as double))"


PANEL_CTE = """
o_ AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         c.c_nationkey,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS visit,
         min(o.o_orderdate) OVER (PARTITION BY o.o_custkey) AS first_date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
panel AS (
  SELECT cast(o_custkey AS varchar) AS subject_id,
         cast(o_orderkey AS varchar) AS visit_id,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'Converted'
              WHEN o_orderstatus = 'F' THEN 'Demented' ELSE 'Nondemented' END AS grp,
         cast(visit AS integer) AS visit,
         cast(date_diff('day', cast(first_date AS date), cast(o_orderdate AS date)) AS integer) AS mr_delay,
         CASE WHEN o_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS sex,
         CASE WHEN o_custkey % 10 = 0 THEN 'L' ELSE 'R' END AS hand,
         cast(60 + o_custkey % 30 + cast(floor(date_diff('day', cast(first_date AS date), cast(o_orderdate AS date)) / 365) AS integer) AS integer) AS age,
         cast(6 + o_custkey % 18 AS integer) AS educ,
         CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE cast(1 + c_nationkey % 5 AS double) END AS ses,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL
              ELSE cast(floor(o_totalprice / 1700) AS double) / cast(10 AS double) END AS mmse,
         cast(CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 0 WHEN '4' THEN 0.5
              WHEN '3' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS double) AS cdr,
         cast(1100 + (o_custkey * 7) % 801 AS integer) AS etiv,
         cast(600 + o_orderkey % 251 AS double) / cast(1000 AS double) AS nwbv,
         round(cast(1430 AS double) / cast(1100 + (o_custkey * 7) % 801 AS double), 3) AS asf,
         o_custkey % 4 <> 0 AS synthetic
  FROM o_)"""

# A3 subject group and the per-subject rollup used by F1-F4, A12.
ROLLUP_CTE = """
subj_ AS (
  SELECT subject_id,
         CASE WHEN bool_or(grp = 'Converted') THEN 'Converted'
              ELSE first(grp ORDER BY visit, visit_id) END AS participant_group
  FROM {src} GROUP BY subject_id),
v1_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY visit_id) AS rn_
                       FROM {src} WHERE visit = 1) WHERE rn_ = 1),
v2_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY visit_id) AS rn_
                       FROM {src} WHERE visit = 2) WHERE rn_ = 1),
after_ AS (SELECT subject_id, max(cdr) AS max_after, count(*) AS n_after FROM {src} WHERE visit > 2 GROUP BY subject_id)"""

FEATURES_SELECT = """
SELECT a.subject_id, s.participant_group,
       a.age AS age_v1, a.mmse AS mmse_v1, a.cdr AS cdr_v1, a.nwbv AS nwbv_v1, a.etiv AS etiv_v1, a.asf AS asf_v1,
       b.age AS age_v2, b.mmse AS mmse_v2, b.cdr AS cdr_v2, b.nwbv AS nwbv_v2, b.etiv AS etiv_v2, b.asf AS asf_v2,
       b.mr_delay AS mr_delay_v2,
       b.mmse - a.mmse AS mmse_delta_v1_v2, b.nwbv - a.nwbv AS nwbv_delta_v1_v2,
       b.cdr - a.cdr AS cdr_delta_v1_v2, b.age - a.age AS age_delta_v1_v2,
       a.educ AS education_years, a.ses AS ses, a.sex AS sex, a.hand AS handedness,
       cast(coalesce(f.max_after > b.cdr, false) AS integer) AS cdr_worsened_after_v2{extra}
FROM v1_ a JOIN v2_ b USING (subject_id) JOIN after_ f USING (subject_id) JOIN subj_ s USING (subject_id)"""

IMPUTED_CTE = """
med_ AS (SELECT grp, median(mmse) AS m_mmse, median(ses) AS m_ses FROM panel WHERE grp IS NOT NULL GROUP BY grp),
ipanel AS (SELECT p.subject_id, p.visit_id, p.grp, p.visit, p.mr_delay, p.sex, p.hand, p.age, p.educ,
                  coalesce(p.ses, m.m_ses) AS ses, coalesce(p.mmse, m.m_mmse) AS mmse,
                  p.cdr, p.etiv, p.nwbv, p.asf, p.synthetic
           FROM panel p LEFT JOIN med_ m ON p.grp = m.grp)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


def features_cte(name: str = "features", imputed: bool = True, extra: str = "") -> str:
    src = "ipanel" if imputed else "panel"
    body = FEATURES_SELECT.format(extra=extra)
    return ROLLUP_CTE.format(src=src) + f",\n{name} AS ({body})"


def base_ctes(imputed: bool = True, extra: str = "") -> list[str]:
    parts = [PANEL_CTE]
    if imputed:
        parts.append(IMPUTED_CTE)
    parts.append(features_cte("features", imputed, extra))
    return parts


PREDICTIONS_CTE = f"""
predictions AS (
  SELECT 'text' AS model, subject_id, participant_group, cdr_worsened_after_v2 AS y,
         CASE WHEN {U("'text|' || subject_id")} < 0.4 + 0.2 * cdr_worsened_after_v2 THEN 1 ELSE 0 END AS yhat,
         cast(CASE WHEN {U("'text|' || subject_id")} < 0.4 + 0.2 * cdr_worsened_after_v2 THEN 1 ELSE 0 END AS double) AS score
  FROM rawfeatures
  UNION ALL
  SELECT 'boosted', subject_id, participant_group, cdr_worsened_after_v2,
         CASE WHEN floor((cast(0.7 AS double) * {U("'boosted|' || subject_id")} + cast(0.3 AS double) * cdr_worsened_after_v2) * 1000) / cast(1000 AS double) >= 0.5 THEN 1 ELSE 0 END,
         floor((cast(0.7 AS double) * {U("'boosted|' || subject_id")} + cast(0.3 AS double) * cdr_worsened_after_v2) * 1000) / cast(1000 AS double)
  FROM rawfeatures
  UNION ALL
  SELECT 'joint', subject_id, participant_group, cdr_worsened_after_v2,
         CASE WHEN floor((cast(0.7 AS double) * {U("'joint|' || subject_id")} + cast(0.3 AS double) * cdr_worsened_after_v2) * 1000) / cast(1000 AS double) >= 0.5 THEN 1 ELSE 0 END,
         floor((cast(0.7 AS double) * {U("'joint|' || subject_id")} + cast(0.3 AS double) * cdr_worsened_after_v2) * 1000) / cast(1000 AS double)
  FROM rawfeatures)"""


def prediction_ctes() -> list[str]:
    """Panel -> raw (not imputed) features -> long predictions."""
    return [PANEL_CTE, features_cte("rawfeatures", imputed=False), PREDICTIONS_CTE]


SUBJ_CTE = """
sg_ AS (
  SELECT subject_id,
         CASE WHEN bool_or(grp = 'Converted') THEN 'Converted'
              ELSE first(grp ORDER BY visit, visit_id) END AS participant_group
  FROM panel GROUP BY subject_id),
lpanel AS (SELECT p.*, s.participant_group FROM panel p JOIN sg_ s USING (subject_id))"""

PANEL_COLUMNS = ["subject_id", "visit_id", "grp", "visit", "mr_delay", "sex", "hand", "age", "educ",
                 "ses", "mmse", "cdr", "etiv", "nwbv", "asf", "synthetic"]


def missing_audit_sql(table: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
             f"(SELECT count(*) FROM {table}) AS n_ FROM {table}" for c in columns]
    return ("SELECT column_name, null_count, round(null_count * 100.0 / n_, 2) AS null_pct FROM ("
            + " UNION ALL ".join(parts) + ") WHERE null_count > 0")


def split_ctes(src: str, name: str, frac: float, forced: str, salt: str, first: str, second: str,
               seed: int = 42) -> str:
    """Exact stratified split of ``src`` into CTE ``name`` (all columns + split)."""
    p = name + "_"
    return f"""
{p}rest AS (SELECT *, md5('{seed}|{salt}|' || subject_id) AS h_ FROM {src} WHERE NOT coalesce({forced}, false)),
{p}cnt AS (SELECT participant_group, count(*) AS n FROM {p}rest GROUP BY participant_group),
{p}a AS (SELECT participant_group, n, sum(n) OVER () AS total_,
                sum(n) OVER () - cast(ceil(cast({frac} AS double) * cast(sum(n) OVER () AS double)) AS bigint) AS ntr_
         FROM {p}cnt),
{p}b AS (SELECT *, (n * ntr_) // total_ AS fl_, (n * ntr_) % total_ AS rem_ FROM {p}a),
{p}c AS (SELECT *, ntr_ - sum(fl_) OVER () AS short_,
                row_number() OVER (ORDER BY rem_ DESC, participant_group NULLS FIRST) AS r_ FROM {p}b),
{p}q AS (SELECT participant_group, n - (fl_ + CASE WHEN r_ <= short_ THEN 1 ELSE 0 END) AS quota FROM {p}c),
{name} AS (
  SELECT * EXCLUDE (h_, quota, rk_), CASE WHEN rk_ <= quota THEN '{first}' ELSE '{second}' END AS split
  FROM (SELECT r.*, q.quota, row_number() OVER (PARTITION BY r.participant_group ORDER BY r.h_, r.subject_id) AS rk_
        FROM {p}rest r JOIN {p}q q ON r.participant_group IS NOT DISTINCT FROM q.participant_group)
  UNION ALL
  SELECT *, '{first}' AS split FROM {src} WHERE coalesce({forced}, false))"""
