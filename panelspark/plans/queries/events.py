"""The same operators on a second panel with other column names (events)."""

from __future__ import annotations


from panelspark.plans.queries.common import (
    panel, query, sql,
)
from panelspark.sources import bindings
from panelspark.operators import cohort as coh
from panelspark.spec import EVENTS


# ── the same operators on a second panel with other column names (events) ────


EVENTS_CTE = """
epanel AS (
  SELECT user_id, event_id, event_type,
         cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS integer) AS visit,
         cast(date_diff('day', cast(min(ts) OVER (PARTITION BY user_id) AS date), cast(ts AS date)) AS integer) AS day,
         value
  FROM events)"""


@query("events_panel", sql(EVENTS_CTE, body="SELECT * FROM epanel"))
def q_events_panel(spark, sf):
    return bindings.events_panel(spark, sf)


@query("events_visit_interval", sql(EVENTS_CTE, body="""
SELECT user_id, visit, event_id, row_number() OVER w AS visit_rank, day - lag(day) OVER w AS interval_days,
       (day - lag(day) OVER w) / 365.0 AS interval_years, day AS cumulative_days
FROM epanel WINDOW w AS (PARTITION BY user_id ORDER BY visit, event_id)"""))
def q_events_visit_interval(spark, sf):
    return coh.visit_interval(bindings.events_panel(spark, sf), EVENTS)


@query("events_subject_group", sql(EVENTS_CTE, body="""
SELECT user_id, CASE WHEN bool_or(event_type = 'Converted') THEN 'Converted'
                     ELSE first(event_type ORDER BY visit, event_id) END AS participant_group
FROM epanel GROUP BY user_id"""))
def q_events_subject_group(spark, sf):
    return coh.subject_group(bindings.events_panel(spark, sf), EVENTS)


@query("events_converter_summary", sql(EVENTS_CTE, body="""
SELECT user_id AS subject_id, count(*) AS total_visits,
       first(value ORDER BY visit, event_id) AS baseline_mmse, first(value ORDER BY visit, event_id) AS baseline_cdr,
       last(value ORDER BY visit, event_id) AS final_mmse, last(value ORDER BY visit, event_id) AS final_cdr,
       first(value ORDER BY visit, event_id) - last(value ORDER BY visit, event_id) AS mmse_drop_baseline_to_final
FROM epanel GROUP BY user_id HAVING bool_or(event_type = 'purchase')"""))
def q_events_converter_summary(spark, sf):
    """A7 with another 'converter' label: users with any purchase event."""
    return coh.converter_summary(bindings.events_panel(spark, sf), EVENTS, converted="purchase")
