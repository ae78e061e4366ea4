"""Per-subject model comparison and error analysis.

The comparison is built from the long prediction table with one conditional aggregation on
subject (a pivot with an explicit model list), not chained joins; the first model listed
carries the subject's group and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.small import join_per_key
from panelspark.session import stored
from panelspark.spec import GROUP, LABEL, PANEL, PanelSpec

MODELS = ("text", "boosted", "joint")


def compare_predictions(pred: DataFrame, models=MODELS) -> DataFrame:
    """One row per subject predicted by every model: subject_id, participant_group,
    cdr_worsened_after_v2, <m>_prediction, <m>_score.  A subject with two rows for one model is
    an error (a join would silently multiply it)."""
    m = F.col("model")
    first = models[0]
    aggs = [F.max(F.when(m == first, F.col("participant_group"))).alias(GROUP),
            F.max(F.when(m == first, F.col("y"))).alias(LABEL)]
    for k in models:
        aggs += [F.max(F.when(m == k, F.col("yhat"))).alias(f"{k}_prediction"),
                 F.max(F.when(m == k, F.col("score"))).alias(f"{k}_score"),
                 F.count_if(m == k).alias(f"_n_{k}")]
    w = pred.where(m.isin(*models)).groupBy("subject_id").agg(*aggs)
    present = None
    for k in models:
        n = F.col(f"_n_{k}")
        cond = F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {k} prediction for "), F.col("subject_id")))) \
            .otherwise(n == 1)
        present = cond if present is None else present & cond
    return w.where(present).drop(*[f"_n_{k}" for k in models])


def _preds(models) -> list[Column]:
    return [F.col(f"{k}_prediction") for k in models]


def positive_cases(cmp: DataFrame) -> DataFrame:
    """Comparison rows with actual label 1."""
    return cmp.where(F.col(LABEL) == 1)


def negative_cases(cmp: DataFrame) -> DataFrame:
    """Comparison rows with actual label 0."""
    return cmp.where(F.col(LABEL) == 0)


def all_models_missed(cmp: DataFrame, models=MODELS) -> DataFrame:
    """Label 1 and every model predicts 0."""
    return cmp.where((F.col(LABEL) == 1) & F.forall(F.array(*_preds(models)), lambda p: p == 0))


# Comparison notes.
NOTE_ALL_WRONG = "all models wrong"
NOTE_FIRST_WRONG = "{first} wrong, others right"
NOTE_DISAGREE = "models disagree on positive case"


def comparison_notes(cmp: DataFrame, models=MODELS) -> DataFrame:
    """Note per subject, first match wins: all wrong; the first model wrong and the others
    right; models disagree and actual = 1; else ''."""
    y = F.col(LABEL)
    preds = _preds(models)
    arr = F.array(*preds)
    all_wrong = F.forall(arr, lambda p: p != y)
    first_wrong = (preds[0] != y) & F.forall(F.array(*preds[1:]), lambda p: p == y)
    disagree = F.size(F.array_distinct(arr)) > 1
    note = (F.when(all_wrong, NOTE_ALL_WRONG)
            .when(first_wrong, NOTE_FIRST_WRONG.format(first=models[0]))
            .when(disagree & (y == 1), NOTE_DISAGREE).otherwise(""))
    return cmp.select("subject_id", GROUP, LABEL, *preds, note.alias("note"))


def positive_case_outcomes(cmp: DataFrame, models=MODELS) -> DataFrame:
    """For actual positives, 'correct' / 'MISSED' per model."""
    return positive_cases(cmp).select(
        "subject_id", GROUP,
        *[F.when(F.col(f"{k}_prediction") == 1, "correct").otherwise("MISSED").alias(f"{k}_result") for k in models])


def false_alarms(cmp: DataFrame, models=MODELS) -> DataFrame:
    """C4: for actual negatives, the models that predicted 1 (only rows with at least one)."""
    names = F.array_compact(F.array(*[F.when(F.col(f"{k}_prediction") == 1, F.lit(k)) for k in models]))
    return negative_cases(cmp).select("subject_id", GROUP, F.array_join(names, ", ").alias("false_alarm_from"),
                                      F.size(names).alias("_k")).where(F.col("_k") > 0).drop("_k")


def disagreements_on_positives(cmp: DataFrame, models=MODELS) -> DataFrame:
    """Actual positives whose predictions are not all equal."""
    return positive_cases(cmp).where(F.size(F.array_distinct(F.array(*_preds(models)))) > 1) \
        .select("subject_id", GROUP, *_preds(models))


def sorted_by_group(cmp: DataFrame) -> DataFrame:
    """Presentation order by group (subject id breaks ties)."""
    return cmp.orderBy(GROUP, "subject_id")


# Trajectory marks.
MARK_OK, MARK_MISS = "✓", "✗"


def positive_case_trajectories(cmp: DataFrame, panel: DataFrame, models=MODELS, cutoff: int = 2,
                               spec: PanelSpec = PANEL) -> DataFrame:
    """MMSE series of actual positives: (subject, group, visit, mmse, after_cutoff, min_mmse,
    marks per model, no_raw_data).  Subjects without panel rows or with only NULL MMSE are kept
    with ``no_raw_data`` true.  The positives' visits are stored once; the per-subject minimum is
    an aggregate joined back, so a subject with very many visits is not one window task."""
    marks = [F.when(F.col(f"{k}_prediction") == 1, MARK_OK).otherwise(MARK_MISS).alias(f"{k}_mark") for k in models]
    pos = stored(positive_cases(cmp).select("subject_id", GROUP, *marks), "positives")
    rows = panel.select(F.col(spec.subject).alias("subject_id"), F.col(spec.visit).alias("visit"), F.col(spec.mmse).alias("mmse"))
    rows = stored(join_per_key(rows, pos.select("subject_id"), "subject_id", "left_semi"), "positive-visits")
    mins = rows.groupBy("subject_id").agg(F.min("mmse").alias("min_mmse"), F.count(F.lit(1)).alias("_n"))
    who = stored(pos.join(mins, "subject_id", "left"), "positive-minima")
    j = join_per_key(rows, who, "subject_id")
    alone = who.where("_n is null").withColumn("visit", F.lit(None).cast(rows.schema["visit"].dataType)) \
        .withColumn("mmse", F.lit(None).cast(rows.schema["mmse"].dataType))
    return j.unionByName(alone).select(
        "subject_id", GROUP, "visit", "mmse", (F.col("visit") > cutoff).alias("after_cutoff"),
        "min_mmse", *[f"{k}_mark" for k in models], F.col("min_mmse").isNull().alias("no_raw_data"))


def missed_case_signals(cmp: DataFrame, panel: DataFrame, models=MODELS, cutoff: int = 2,
                        signals=("mmse", "nwbv", "cdr"), spec: PanelSpec = PANEL) -> DataFrame:
    """Long (subject, group, signal, visit, value, after_cutoff, annotated) for subjects
    every model missed; ``annotated`` marks the visit-1 and visit-2 values."""
    missed = all_models_missed(cmp, models).select("subject_id", GROUP)
    rows = join_per_key(panel, missed.withColumnRenamed("subject_id", spec.subject), spec.subject)
    long = rows.select(spec.subject, GROUP, spec.visit, F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(spec.signal(s)).cast("double").alias("value")) for s in signals
    ])).alias("_s"))
    return long.select(F.col(spec.subject).alias("subject_id"), GROUP, "_s.signal", F.col(spec.visit).alias("visit"),
                       "_s.value", (F.col(spec.visit) > cutoff).alias("after_cutoff"),
                       F.col(spec.visit).isin(1, 2).alias("annotated"))
