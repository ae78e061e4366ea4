"""Panel augmentation: generation priors, generated subjects and visits, union with real rows
(A22, G1-G7, U1).

Generation is a map-only Spark job: ``spark.range(n)`` -> one row per subject -> a fold over the
subject's (at most 5) visits -> ``inline``.  Every random number is a keyed draw
``u(seed|subject|visit|name)``, so the output does not depend on partitioning or task order
and a lost task regenerates the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.exprs import clip, keyed_uniform, normal_draw
from panelspark.operators.ranking import BUCKET_ROWS, positions
from panelspark.spec import GROUP, PANEL, PanelSpec
from panelspark.operators.cohort import subject_group
from panelspark.operators.small import bounded, join_per_key
from panelspark.session import stored

SEED = 42

# Generation priors per group (means / standard deviations of the baseline draws,
# annual change of MMSE and nWBV, baseline CDR options and probabilities, female share).
GROUP_PRIORS = {
    "Nondemented": dict(age_mean=74.0, age_std=8.0, mmse_v1_mean=29.1, mmse_v1_std=1.0,
                        mmse_annual_delta_mean=0.0, mmse_annual_delta_std=0.8,
                        nwbv_v1_mean=0.738, nwbv_v1_std=0.038,
                        nwbv_annual_delta_mean=-0.003, nwbv_annual_delta_std=0.003,
                        etiv_mean=1490.0, etiv_std=150.0, cdr_v1_options=[0.0], cdr_v1_probs=[1.0],
                        educ_mean=14.5, educ_std=2.5, ses_mean=2.5, ses_std=1.0, female_prob=0.65),
    "Demented": dict(age_mean=76.0, age_std=7.0, mmse_v1_mean=24.0, mmse_v1_std=4.5,
                     mmse_annual_delta_mean=-1.5, mmse_annual_delta_std=2.0,
                     nwbv_v1_mean=0.713, nwbv_v1_std=0.033,
                     nwbv_annual_delta_mean=-0.004, nwbv_annual_delta_std=0.003,
                     etiv_mean=1480.0, etiv_std=150.0, cdr_v1_options=[0.5, 1.0, 2.0], cdr_v1_probs=[0.65, 0.30, 0.05],
                     educ_mean=13.5, educ_std=3.0, ses_mean=2.8, ses_std=1.0, female_prob=0.60),
    "Converted": dict(age_mean=75.0, age_std=7.0, mmse_v1_mean=29.0, mmse_v1_std=1.2,
                      mmse_annual_delta_mean=-1.8, mmse_annual_delta_std=1.5,
                      nwbv_v1_mean=0.728, nwbv_v1_std=0.036,
                      nwbv_annual_delta_mean=-0.004, nwbv_annual_delta_std=0.003,
                      etiv_mean=1485.0, etiv_std=150.0, cdr_v1_options=[0.0], cdr_v1_probs=[1.0],
                      educ_mean=14.0, educ_std=2.5, ses_mean=2.5, ses_std=1.0, female_prob=0.65),
}
# Visit spacing, visit-count distributions, id format, CDR scale and step rules.
VISIT_INTERVAL_DAYS_MEAN = 730.0
VISIT_INTERVAL_DAYS_STD = 180.0
VISITS_PROGRESSING = ([3, 4, 5], [0.5, 0.35, 0.15])    # Converted, Demented
VISITS_STABLE = ([3, 4], [0.7, 0.3])                    # Nondemented
FIRST_ID = 1000
ID_FORMAT = "SYN_%04d"
CDR_SCALE = [0.0, 0.5, 1.0, 2.0]
CONVERTER_BASE_P, CONVERTER_SLOPE_P, CONVERTER_FURTHER_P = 0.4, 0.4, 0.15
DEMENTED_STEP_P = 0.20
NONDEMENTED_STEP_P = 0.03
GROUP_ORDER = ["Nondemented", "Demented", "Converted"]

PRIOR_FIELDS = ["age_mean", "age_std", "mmse_v1_mean", "mmse_v1_std", "mmse_annual_delta_mean",
                "mmse_annual_delta_std", "nwbv_v1_mean", "nwbv_v1_std", "nwbv_annual_delta_mean",
                "nwbv_annual_delta_std", "etiv_mean", "etiv_std", "educ_mean", "educ_std", "ses_mean",
                "ses_std", "female_prob"]


def priors_frame(spark: SparkSession, priors: dict = GROUP_PRIORS) -> DataFrame:
    """Priors as a small inline table (one row per group; a local relation, so its size is known
    without a job)."""
    def lit_array(xs):
        return "array(" + ", ".join(f"CAST({float(x)!r} AS DOUBLE)" for x in xs) + ")"
    rows = []
    for g, p in priors.items():
        vals = [f"'{g}'"] + [f"CAST({float(p[f])!r} AS DOUBLE)" for f in PRIOR_FIELDS] \
            + [lit_array(p["cdr_v1_options"]), lit_array(p["cdr_v1_probs"])]
        rows.append("(" + ", ".join(vals) + ")")
    cols = ", ".join([GROUP] + PRIOR_FIELDS + ["cdr_v1_options", "cdr_v1_probs"])
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({cols})")


def _choice(u: Column, values, probs) -> Column:
    """Inverse-CDF pick from literal values/probabilities."""
    acc, expr = 0.0, None
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = F.when(u < F.lit(acc), F.lit(v)) if expr is None else expr.when(u < F.lit(acc), F.lit(v))
    return F.lit(values[-1]) if expr is None else expr.otherwise(F.lit(values[-1]))


def _choice_arrays(u: Column, options: Column, probs: Column) -> Column:
    """Inverse-CDF pick from array columns (first option whose cumulative probability exceeds u)."""
    cum = F.transform(F.sequence(F.lit(1), F.size(probs)), lambda i: F.aggregate(F.slice(probs, 1, i), F.lit(0.0), lambda a, b: a + b))
    hit = F.filter(F.arrays_zip(options.alias("o"), cum.alias("c")), lambda z: u < z["c"])
    return F.coalesce(hit[0]["o"], F.element_at(options, -1))


def generate_subjects(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """G1 + T3: n subjects ``SYN_%04d`` from 1000, groups in quota order, visit counts drawn."""
    c = int(n * 0.20)
    d = int(n * 0.40)
    nd = n - c - d
    idx = F.col("id")
    grp = F.when(idx < nd, "Nondemented").when(idx < nd + d, "Demented").otherwise("Converted")
    sid = F.format_string(ID_FORMAT, idx + FIRST_ID)
    base = spark.range(n).select(idx.alias("subject_index"), sid.alias("subject_id"), grp.alias(GROUP))
    u = keyed_uniform(str(seed), F.col("subject_id"), "n_visits")
    nv = F.when(F.col(GROUP).isin("Converted", "Demented"), _choice(u, *VISITS_PROGRESSING)) \
        .otherwise(_choice(u, *VISITS_STABLE))
    return base.withColumn("n_visits", nv.cast("int"))


def _draw(seed: int, sid: Column, visit, name: str, mean, std) -> Column:
    return normal_draw(keyed_uniform(str(seed), sid, visit, name, "a"),
                       keyed_uniform(str(seed), sid, visit, name, "b"), mean, std)


def generate_baseline(subjects: DataFrame, priors: DataFrame, seed: int = SEED) -> DataFrame:
    """Clipped normal baseline draws; ints truncate like Python ``int``."""
    sid = F.col("subject_id")
    s = subjects.join(bounded(priors), GROUP, "inner")   # priors: one row per group, checked
    etiv = F.floor(clip(_draw(seed, sid, F.lit(1), "etiv", F.col("etiv_mean"), F.col("etiv_std")), 1100.0, 1900.0)).cast("int")
    return s.select(
        "subject_index", "subject_id", GROUP, "n_visits",
        F.floor(clip(_draw(seed, sid, F.lit(1), "age", F.col("age_mean"), F.col("age_std")), 60.0, 96.0)).cast("int").alias("age0"),
        clip(_draw(seed, sid, F.lit(1), "mmse", F.col("mmse_v1_mean"), F.col("mmse_v1_std")), 0.0, 30.0).alias("mmse0"),
        clip(_draw(seed, sid, F.lit(1), "nwbv", F.col("nwbv_v1_mean"), F.col("nwbv_v1_std")), 0.60, 0.85).alias("nwbv0"),
        etiv.alias("etiv"),
        F.round(F.lit(1430.0) / etiv.cast("double"), 3).alias("asf"),
        _choice_arrays(keyed_uniform(str(seed), sid, "cdr0"), F.col("cdr_v1_options"), F.col("cdr_v1_probs")).alias("cdr0"),
        F.floor(clip(_draw(seed, sid, F.lit(1), "educ", F.col("educ_mean"), F.col("educ_std")), 6.0, 23.0)).cast("int").alias("educ"),
        clip(F.bround(_draw(seed, sid, F.lit(1), "ses", F.col("ses_mean"), F.col("ses_std")), 0), 1.0, 5.0).alias("ses"),
        F.when(keyed_uniform(str(seed), sid, "sex") < F.col("female_prob"), "F").otherwise("M").alias("sex"),
        "mmse_annual_delta_mean", "mmse_annual_delta_std", "nwbv_annual_delta_mean", "nwbv_annual_delta_std",
    )


def generate_visit_times(baseline: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per (subject, visit) with the interval draw (0 at visit 1), years and
    cumulative days (closed form: intervals are independent keyed draws)."""
    sid = F.col("subject_id")
    v = baseline.select("*", F.explode(F.sequence(F.lit(1), F.col("n_visits"))).alias("visit"))
    interval = F.when(F.col("visit") == 1, F.lit(0)).otherwise(F.floor(clip(
        _draw(seed, sid, F.col("visit"), "interval", VISIT_INTERVAL_DAYS_MEAN, VISIT_INTERVAL_DAYS_STD),
        365.0, 1460.0)).cast("int"))
    return v.withColumn("interval_days", interval.cast("int"))


def _visit_draws(seed: int) -> Column:
    """Array of per-visit draws for visits 2..n: interval, the two walk steps' z and the CDR uniform."""
    sid = F.col("subject_id")

    def one(k):
        return F.struct(
            k.cast("int").alias("k"),
            F.floor(clip(_draw(seed, sid, k, "interval", VISIT_INTERVAL_DAYS_MEAN, VISIT_INTERVAL_DAYS_STD),
                         365.0, 1460.0)).cast("int").alias("interval"),
            _draw(seed, sid, k, "mmse_step", 0.0, 1.0).alias("zm"),
            _draw(seed, sid, k, "nwbv_step", 0.0, 1.0).alias("zn"),
            keyed_uniform(str(seed), sid, k, "cdr").alias("uc"))
    return F.transform(F.sequence(F.lit(2), F.greatest(F.col("n_visits"), F.lit(2))), one)


def _advance_cdr(group: Column, cur: Column, k: Column, total: Column, u: Column) -> Column:
    """One ordinal stage step (unknown values are treated as scale index 1)."""
    idx = (F.when(cur == 0.0, 0).when(cur == 0.5, 1).when(cur == 1.0, 2).when(cur == 2.0, 3).otherwise(1))
    nxt = F.element_at(F.array(*[F.lit(x) for x in CDR_SCALE]), idx + 2)   # scale[idx + 1]
    can_step = idx < len(CDR_SCALE) - 1
    p_conv = F.lit(CONVERTER_BASE_P) + (k.cast("double") / total.cast("double")) * F.lit(CONVERTER_SLOPE_P)
    converted = (F.when((cur == 0.0) & (u < p_conv), F.lit(0.5))
                 .when((cur >= 0.5) & (u < CONVERTER_FURTHER_P) & can_step, nxt).otherwise(cur))
    demented = F.when((u < DEMENTED_STEP_P) & can_step, nxt).otherwise(cur)
    stable = F.when(u < NONDEMENTED_STEP_P, F.lit(0.5)).otherwise(cur)
    return (F.when(group == "Converted", converted).when(group == "Demented", demented).otherwise(stable)).cast("double")


def generate_panel(spark: SparkSession, n: int, seed: int = SEED, priors: DataFrame | None = None) -> DataFrame:
    """Generated panel rows with the panel schema and ``synthetic = true``.

    G3-G6 run as one fold per subject: the clipped walk (clip after each step) and the stage
    chain are sequential, so ``aggregate`` carries (days, mmse, nwbv, cdr) through the subject's
    visit array; the rows are emitted with ``inline``.  No shuffle.
    """
    pri = priors if priors is not None else priors_frame(spark)
    b = generate_baseline(generate_subjects(spark, n, seed), pri, seed).withColumn("_draws", _visit_draws(seed))
    grp, total = F.col(GROUP), F.col("n_visits")

    def row(visit, days, mmse, nwbv, cdr):
        return F.struct(visit.cast("int").alias("visit"), days.cast("int").alias("days"),
                        mmse.cast("double").alias("mmse"), nwbv.cast("double").alias("nwbv"), cdr.cast("double").alias("cdr"))

    init = F.struct(F.lit(0).alias("days"), F.col("mmse0").cast("double").alias("mmse"),
                    F.col("nwbv0").cast("double").alias("nwbv"), F.col("cdr0").cast("double").alias("cdr"),
                    F.array(row(F.lit(1), F.lit(0), F.col("mmse0"), F.col("nwbv0"), F.col("cdr0"))).alias("rows"))

    def step(acc, x):
        years = x["interval"].cast("double") / F.lit(365.0)
        days = acc["days"] + x["interval"]
        mmse = clip(acc["mmse"] + F.col("mmse_annual_delta_mean") * years
                    + F.col("mmse_annual_delta_std") * F.sqrt(years) * x["zm"], 0.0, 30.0)
        nwbv = clip(acc["nwbv"] + F.col("nwbv_annual_delta_mean") * years
                    + F.col("nwbv_annual_delta_std") * F.sqrt(years) * x["zn"], 0.60, 0.85)
        cdr = _advance_cdr(grp, acc["cdr"], x["k"], total, x["uc"])
        keep = x["k"] <= total
        new_rows = F.when(keep, F.concat(acc["rows"], F.array(row(x["k"], days, mmse, nwbv, cdr)))).otherwise(acc["rows"])
        return F.struct(days.cast("int").alias("days"), mmse.cast("double").alias("mmse"),
                        nwbv.cast("double").alias("nwbv"), cdr.cast("double").alias("cdr"), new_rows.alias("rows"))

    folded = b.select("subject_id", GROUP, "age0", "etiv", "asf", "educ", "ses", "sex",
                      F.aggregate("_draws", init, step)["rows"].alias("_rows"))
    v = folded.select("*", F.inline("_rows"))
    return v.select(
        "subject_id",
        F.concat(F.col("subject_id"), F.lit("_MR"), F.col("visit").cast("string")).alias("visit_id"),
        F.col(GROUP).alias("grp"), "visit", F.col("days").alias("mr_delay"), "sex", F.lit("R").alias("hand"),
        (F.col("age0") + F.floor(F.col("days") / 365).cast("int")).cast("int").alias("age"),
        "educ", "ses", F.round("mmse", 1).alias("mmse"), "cdr", "etiv", F.round("nwbv", 3).alias("nwbv"), "asf",
        F.lit(True).alias("synthetic"))


def union_real_generated(real: DataFrame, generated: DataFrame) -> DataFrame:
    """Real rows flagged ``synthetic = false`` followed by generated rows."""
    r = real.drop("synthetic").withColumn("synthetic", F.lit(False))
    return r.unionByName(generated, allowMissingColumns=True)


# ── A22: fit the priors from a real panel ────────────────────────────────────

def fit_generation_priors(panel: DataFrame, spec: PanelSpec = PANEL, width: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per subject group, baseline means / sample stds, annualised MMSE / nWBV change
    (mean of delta/years, sample std of delta/sqrt(years) over consecutive visits) and the
    female share.  Consecutive pairs come from the bucketed positions helper."""
    bucket = F.floor(F.col(spec.visit) / F.lit(width)).cast("long")
    used = dict.fromkeys([spec.subject, spec.visit, spec.visit_id, spec.group, spec.delay, spec.sex,
                          *[spec.signal(c) for c in ("age", "mmse", "nwbv", "etiv", "educ", "ses")]])
    # one pass over the panel; then every visit with the values of the visit before, stored
    rows = stored(positions(stored(panel.select(*used), "visits"), [spec.subject], spec.visit, [spec.visit_id], bucket,
                            carry=[spec.delay, spec.mmse, spec.nwbv], name="_pos", bucket_rows=bucket_rows), "visit-pairs")
    pairs = join_per_key(rows, subject_group(rows, spec), spec.subject)
    stats = pairs.where(F.col(spec.visit) == 1).groupBy(GROUP).agg(
        *[f(F.col(spec.signal(c)).cast("double")).alias(f"{name}_{suffix}")
          for c, name in [("age", "age"), ("mmse", "mmse_v1"), ("nwbv", "nwbv_v1"), ("etiv", "etiv"),
                          ("educ", "educ"), ("ses", "ses")]
          for f, suffix in [(F.avg, "mean"), (F.stddev_samp, "std")]],
        F.avg(F.when(F.col(spec.sex) == "F", 1.0).when(F.col(spec.sex).isNotNull(), 0.0)).alias("female_prob"))
    years = (F.col(spec.delay) - F.col(f"prev_{spec.delay}")).cast("double") / F.lit(365.0)
    dm = F.col(spec.mmse) - F.col(f"prev_{spec.mmse}")
    dn = F.col(spec.nwbv) - F.col(f"prev_{spec.nwbv}")
    ok = years > 0
    change = pairs.groupBy(GROUP).agg(
        F.avg(F.when(ok, dm / years)).alias("mmse_annual_delta_mean"),
        F.stddev_samp(F.when(ok, dm / F.sqrt(years))).alias("mmse_annual_delta_std"),
        F.avg(F.when(ok, dn / years)).alias("nwbv_annual_delta_mean"),
        F.stddev_samp(F.when(ok, dn / F.sqrt(years))).alias("nwbv_annual_delta_std"))
    out = stats.join(change, GROUP, "left")   # both one row per group
    return out.select(GROUP, *[F.round(c, 6).alias(c) for c in PRIOR_FIELDS])


def baseline_cdr_frequencies(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """A22 (CDR part): share of each baseline CDR value per subject group."""
    base = join_per_key(panel.where(F.col(spec.visit) == 1), subject_group(panel, spec), spec.subject)
    c = stored(base.groupBy(GROUP, spec.cdr).agg(F.count(F.lit(1)).alias("n")), "baseline-cdr")
    t = c.groupBy(GROUP).agg(F.sum("n").alias("_t"))
    return c.join(t, GROUP).select(GROUP, F.col(spec.cdr).alias("cdr"), "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def fitted_priors(panel: DataFrame, spec: PanelSpec = PANEL, published: dict = GROUP_PRIORS) -> DataFrame:
    """Priors for ``generate_panel`` from a panel's own statistics (A22): one row per generated group.

    What a group's rows do not tell is taken from the published priors of that group: a group without subjects, a
    mean without values, a deviation of a single value, yearly changes of subjects with one visit, and the baseline
    stages where none is on the scale.  Baseline stages are drawn with their shares among those on the scale.  Rows
    without a group belong to none of the generated groups and shape no prior."""
    spark = panel.sparkSession
    fit = fit_generation_priors(panel, spec).where(F.col(GROUP).isNotNull())
    stages = baseline_cdr_frequencies(panel, spec).where(F.col(GROUP).isNotNull() & F.col("cdr").isNotNull())
    known = stages.where(F.col("cdr").isin(CDR_SCALE)).groupBy(GROUP).agg(             # at most one row for each stage of the scale
        F.array_sort(F.collect_list(F.struct("cdr", "n"))).alias("_c"), F.sum("n").alias("_t"))
    drawn = known.select(GROUP, F.transform("_c", lambda c: c["cdr"].cast("double")).alias("_options"),
                         F.transform("_c", lambda c: F.round(c["n"] / F.col("_t"), 6)).alias("_probs"))
    base = priors_frame(spark, published)
    f = fit.select(F.col(GROUP).alias("_g"), *[F.col(c).alias(f"_{c}") for c in PRIOR_FIELDS])
    joined = base.join(f, F.col(GROUP) == F.col("_g"), "left").join(drawn, GROUP, "left")
    return joined.select(GROUP, *[F.coalesce(f"_{c}", c).alias(c) for c in PRIOR_FIELDS],
                         F.coalesce("_options", "cdr_v1_options").alias("cdr_v1_options"), F.coalesce("_probs", "cdr_v1_probs").alias("cdr_v1_probs"))
