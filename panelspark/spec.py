"""Panel description, schemas and the NaN -> NULL normaliser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class PanelSpec:
    """Names of the panel columns the operators use.

    One row of a panel is one visit of one subject.  ``visit`` is the 1-based visit number,
    ``visit_id`` breaks ties between duplicate visit numbers (lowest wins).
    """

    subject: str = "subject_id"
    visit_id: str = "visit_id"
    group: str = "grp"
    visit: str = "visit"
    delay: str = "mr_delay"
    sex: str = "sex"
    hand: str = "hand"
    age: str = "age"
    educ: str = "educ"
    ses: str = "ses"
    mmse: str = "mmse"
    cdr: str = "cdr"
    etiv: str = "etiv"
    nwbv: str = "nwbv"
    asf: str = "asf"
    synthetic: str = "synthetic"

    def signal(self, name: str) -> str:
        return getattr(self, name)


PANEL = PanelSpec()

# The events binding keeps the table's own names; only the roles are mapped.
EVENTS = PanelSpec(subject="user_id", visit_id="event_id", group="event_type", visit="visit", delay="day",
                   mmse="value", cdr="value", nwbv="value")

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("visit_id", T.StringType(), False),
        T.StructField("grp", T.StringType(), True),
        T.StructField("visit", T.IntegerType(), False),
        T.StructField("mr_delay", T.IntegerType(), True),
        T.StructField("sex", T.StringType(), True),
        T.StructField("hand", T.StringType(), True),
        T.StructField("age", T.IntegerType(), True),
        T.StructField("educ", T.IntegerType(), True),
        T.StructField("ses", T.DoubleType(), True),
        T.StructField("mmse", T.DoubleType(), True),
        T.StructField("cdr", T.DoubleType(), True),
        T.StructField("etiv", T.IntegerType(), True),
        T.StructField("nwbv", T.DoubleType(), True),
        T.StructField("asf", T.DoubleType(), True),
    ]
)

# Header names of the study CSV (after stripping blanks) and the panel
# column each one maps to.
CSV_HEADER_TO_PANEL = {
    "Subject ID": "subject_id",
    "MRI ID": "visit_id",
    "Group": "grp",
    "Visit": "visit",
    "MR Delay": "mr_delay",
    "M/F": "sex",
    "Hand": "hand",
    "Age": "age",
    "EDUC": "educ",
    "SES": "ses",
    "MMSE": "mmse",
    "CDR": "cdr",
    "eTIV": "etiv",
    "nWBV": "nwbv",
    "ASF": "asf",
    "synthetic": "synthetic",
}

# The participant feature row, in published column order.
FEATURE_COLUMNS = [
    "subject_id", "participant_group",
    "age_v1", "mmse_v1", "cdr_v1", "nwbv_v1", "etiv_v1", "asf_v1",
    "age_v2", "mmse_v2", "cdr_v2", "nwbv_v2", "etiv_v2", "asf_v2", "mr_delay_v2",
    "mmse_delta_v1_v2", "nwbv_delta_v1_v2", "cdr_delta_v1_v2", "age_delta_v1_v2",
    "education_years", "ses", "sex", "handedness",
    "cdr_worsened_after_v2",
]
LABEL = "cdr_worsened_after_v2"
GROUP = "participant_group"

# The 19 numeric model features and the 2 categorical ones.
NUMERIC_FEATURES = [
    "age_v1", "mmse_v1", "cdr_v1", "nwbv_v1", "etiv_v1", "asf_v1",
    "age_v2", "mmse_v2", "cdr_v2", "nwbv_v2", "etiv_v2", "asf_v2",
    "mr_delay_v2",
    "mmse_delta_v1_v2", "nwbv_delta_v1_v2", "cdr_delta_v1_v2", "age_delta_v1_v2",
    "education_years", "ses",
]
CATEGORICAL_FEATURES = ["sex", "handedness"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column.

    Spark's max/avg propagate NaN while the pandas semantics we follow skip missing values,
    so NaN must become NULL at ingest.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
