import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.session import get_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=8)
    yield s


PANEL_DDL = ("subject_id string, visit_id string, grp string, visit int, mr_delay int, sex string, hand string, "
             "age int, educ int, ses double, mmse double, cdr double, etiv int, nwbv double, asf double")


def make_panel(spark, rows):
    """rows: (subject, visit, cdr, group, mmse) tuples; other columns filled with constants."""
    full = []
    for i, (s, v, cdr, g, mmse) in enumerate(rows):
        full.append((s, f"{s}_{v}_{i:03d}", g, v, 365 * (v - 1), "F", "R", 70 + v, 12, 2.0, mmse, cdr, 1500,
                     0.7 - 0.01 * v, 0.953))
    return spark.createDataFrame(full, PANEL_DDL)
