"""The bucketed panel store and the lenient reader."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from panelspark.operators import cohort as coh, features as feat, profile as prof
from panelspark.plans import catalog as C
from panelspark.sources import io
from tests.conftest import SMALL, make_panel


def _scratch():
    return tempfile.mkdtemp(prefix="panelspark-test-", dir="/tmp")


def test_subject_operators_exchange_no_panel_row(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = C.panel(spark, SMALL)
        name = f"store_{uuid.uuid4().hex}"
        io.write_panel_store(p, name, 4, os.path.join(_scratch(), "store"))
        s = io.read_panel_store(spark, name)
        assert s.count() == p.count() and s.columns == p.columns
        wanted = s.where("cdr > 1")
        plans = {"F4": lambda x: feat.participant_features(x), "A3": lambda x: coh.subject_group(x), "A5": lambda x: prof.visit_counts(x),
                 "A7": lambda x: coh.converter_summary(x), "W2": lambda x: coh.first_last_visit(x),
                 "J1": lambda x: coh.panel_with_subject_group(x, co_located=x is s), "J4": lambda x: coh.subject_trajectories(x, wanted, co_located=x is s)}
        for key, make in plans.items():
            df = make(s)
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), key
            want = make(p).select(*df.columns)
            assert df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty(), key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_subjects_are_refused(spark):
    p = make_panel(spark, [("A", 1, 0.0, "Demented", 20.0), (None, 1, 0.0, "Demented", 20.0)])
    with pytest.raises(ValueError, match="NULL subjects"):
        io.write_panel_store(p, f"store_{uuid.uuid4().hex}", 2, os.path.join(_scratch(), "store"))


HEAD = " Subject ID ,MRI ID,Group,Visit,MR Delay,M/F,Hand,Age,EDUC,SES,MMSE,CDR,eTIV,nWBV,ASF,Note\n"


def _csv(rows):
    path = os.path.join(_scratch(), "panel.csv")
    with open(path, "w") as f:
        f.write(HEAD + "".join(",".join(r) + "\n" for r in rows))
    return path


GOOD = ["S1", "S1_1", "Demented", "1", "0", "M", "R", "70", "12", "2", "27", "0.5", "1500", "0.7", "0.9", "x"]


def _with(**cells):
    at = {"subject": 0, "visit_id": 1, "visit": 3, "age": 7, "mmse": 10, "cdr": 11, "etiv": 12}
    row = list(GOOD)
    for k, v in cells.items():
        row[at[k]] = v
    return row


def test_bad_cells_are_set_aside(spark):
    path = _csv([GOOD, _with(visit_id="S1_2", visit="2", age="seventy", mmse="2x"), _with(visit_id="S1_3", visit="third", cdr="?"),
                 _with(visit_id="S1_4", visit=""), _with(visit_id="S1_5", visit="5.0", age="70.5", etiv="NA"), _with(subject="NA", visit_id="S1_6", visit="6")])
    with pytest.raises(Exception, match="cannot read"):
        io.read_panel(spark, path).collect()                                   # the strict mode stays
    got = io.read_panel_with_rejects(spark, path)
    rows = {r.visit_id: r for r in got.panel.collect()}
    assert set(rows) == {"S1_1", "S1_2", "S1_5"} and rows["S1_5"].visit == 5 and rows["S1_5"].age is None and rows["S1_5"].etiv is None
    assert rows["S1_2"].age is None and rows["S1_2"].mmse is None and rows["S1_2"].cdr == 0.5 and rows["S1_2"].Note == "x"
    cells = sorted((r.visit_id, r.column_name, r.text) for r in got.rejects.collect())
    assert cells == [("S1_2", "age", "seventy"), ("S1_2", "mmse", "2x"), ("S1_3", "cdr", "?"), ("S1_3", "visit", "third"), ("S1_4", "visit", None),
                     ("S1_5", "age", "70.5"), ("S1_6", "subject_id", None)]
    totals = {r.column_name: (r.n_cells, r.n_rows_dropped) for r in got.totals.collect()}
    assert totals == {"age": (2, 0), "mmse": (1, 0), "cdr": (1, 0), "visit": (2, 2), "subject_id": (1, 1), None: (7, 3)}
    assert all(r.file.endswith("panel.csv") for r in got.rejects.collect())


def test_clean_files_have_no_rejects(spark):
    path = _csv([GOOD, _with(visit_id="S1_2", visit="2", mmse="NaN")])
    got = io.read_panel_with_rejects(spark, path)
    assert sorted(map(str, got.panel.collect())) == sorted(map(str, io.read_panel(spark, path).collect()))
    assert got.rejects.isEmpty() and [tuple(r) for r in got.totals.collect()] == [(None, 0, 0)]
    assert got.panel.schema["mmse"].dataType == io.read_panel(spark, path).schema["mmse"].dataType and got.panel.where(F.col("mmse").isNull()).count() == 1
