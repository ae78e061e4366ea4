"""Text queries (L1-L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans.queries.common import (
    BASE, features, new_folder, query, sql,
)
from panelspark.sources import bindings
from panelspark.functions import text as txt
from panelspark.models import textscore
from panelspark.session import stored


# ── text (L1-L3) ─────────────────────────────────────────────────────────────


PY_WS_RE2 = r"\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIPPED = f"regexp_replace(text, '^[{PY_WS_RE2}]+|[{PY_WS_RE2}]+$', '', 'g')"


def _duck_plain(c):
    return f"coalesce(cast({c} AS varchar), 'nan')"


def _duck_fmt(c, spec):
    nan = "+nan" if spec.startswith("%+") else "nan"
    return f"CASE WHEN {c} IS NULL THEN '{nan}' ELSE printf('{spec}', {c}) END"


PROMPT_SQL = "printf('" + txt.PROMPT_TEMPLATE.replace("'", "''") + "', " + ", ".join([
    _duck_plain("age_v1"), _duck_plain("mmse_v1"), _duck_plain("cdr_v1"), _duck_fmt("nwbv_v1", "%.4f"),
    _duck_plain("education_years"), "coalesce(sex, 'nan')", _duck_plain("mr_delay_v2"), _duck_plain("age_v2"),
    _duck_plain("mmse_v2"), _duck_plain("cdr_v2"), _duck_fmt("nwbv_v2", "%.4f"),
    _duck_fmt("mmse_delta_v1_v2", "%+.1f"), _duck_fmt("nwbv_delta_v1_v2", "%+.4f"), _duck_fmt("cdr_delta_v1_v2", "%+.1f"),
]) + ")"


@query("clinical_prompt", sql(*BASE, body=f"SELECT subject_id, {PROMPT_SQL} AS prompt FROM features"))
def q_clinical_prompt(spark, sf):
    return txt.clinical_prompt(features(spark, sf)).select("subject_id", "prompt")


@query("parse_response", f"""
SELECT doc_id,
       CASE WHEN text IS NULL THEN 0 WHEN {STRIPPED} = '1' THEN 1 WHEN {STRIPPED} = '0' THEN 0
            WHEN instr({STRIPPED}, '1') > 0 THEN 1 WHEN instr({STRIPPED}, '0') > 0 THEN 0 ELSE 0 END AS prediction,
       CASE WHEN text IS NULL THEN 'missing' WHEN {STRIPPED} IN ('0', '1') THEN 'clean'
            WHEN instr({STRIPPED}, '1') > 0 OR instr({STRIPPED}, '0') > 0 THEN 'noisy' ELSE 'unparseable' END AS parse_status
FROM documents""")
def q_parse_response(spark, sf):
    d = bindings.read_table(spark, sf, "documents").select("doc_id", "text")
    pred, status = txt.parse_response(F.col("text"))
    return d.select("doc_id", pred.alias("prediction"), status.alias("parse_status"))


def _no_predictor():
    def predict(prompts):
        raise AssertionError("a prompt that the store answers was asked again")
    return predict


@query("score_text_batch", sql(*BASE, body="""
SELECT subject_id, participant_group, cdr_worsened_after_v2,
       CASE WHEN cast(printf('%+.1f', mmse_delta_v1_v2) AS double) < -2 THEN 1 ELSE 0 END AS text_prediction,
       'clean' AS parse_status
FROM features"""))
def q_score_text_batch(spark, sf):
    """L3 through the response store: scored twice, and the second run asks nothing."""
    store = new_folder(spark, "answers")
    scored = stored(features(spark, sf), "scored-features")
    textscore.score_text_batch(scored, store=store)
    s = textscore.score_text_batch(scored, _no_predictor, store=store)
    return s.select("subject_id", "participant_group", "cdr_worsened_after_v2", "text_prediction", "parse_status")
