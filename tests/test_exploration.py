"""The exploration job against the single operators, and how often it reads the panel."""

from pyspark.sql import functions as F

from panelspark.operators import cohort as coh, profile as prof
from panelspark.operators.exploration import Exploration
from panelspark.plans import catalog as C
from tests.conftest import SMALL, make_panel


def _single(p):
    out = {"structure": prof.dataset_structure(p), "group_rows": prof.group_row_counts(p), "subject_groups": prof.subject_group_counts(p),
           "visit_counts": prof.visit_counts(p), "visit_distribution": prof.visit_count_distribution(p), "converters": coh.converter_summary(p),
           "missing": prof.missing_value_audit(p), "summary": prof.exploration_summary(p), "trajectories": coh.metric_trajectories(p),
           "converter_trajectories": coh.converter_trajectories(p), "baseline_box": prof.baseline_box_stats(p)}
    if "synthetic" in p.columns:
        out["cohorts"] = prof.panel_cohort_counts(p)
    return out


def _same(p):
    single, tables = _single(p), Exploration(p).tables()
    assert set(single) == set(tables)
    for name, want in single.items():
        got = tables[name]
        assert got.columns == want.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_equal_to_the_single_operators(spark):
    _same(C.panel(spark, SMALL))
    rows = [("A", 1, 0.0, "Nondemented", 29.0), ("A", 2, 0.5, "Converted", None), ("B", 2, 1.0, "Demented", 20.0), ("B", 1, None, None, 22.0),
            ("C", 1, 0.0, None, None), ("C", 1, 0.0, "Demented", 25.0), (None, 1, 0.5, "Demented", 24.0), (None, 3, 0.5, "Converted", float("nan"))]
    _same(make_panel(spark, rows))
    _same(make_panel(spark, rows).withColumn("synthetic", F.expr("case when subject_id = 'A' then true when subject_id = 'B' then false end")))
    _same(make_panel(spark, rows).where("false"))


def test_reads_the_panel_twice_at_most(spark):
    p = C.panel(spark, SMALL)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = p.count()
    for df in Exploration(p.mapInArrow(counted, p.schema)).tables().values():
        df.collect()
    assert 0 < seen.value <= 2 * n
