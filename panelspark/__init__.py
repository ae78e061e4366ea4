"""panelspark: longitudinal-panel feature, label, split, scoring and comparison operators on Spark.

Every operator is a DataFrame -> DataFrame function (usable with ``df.transform``) or a
``pyspark.ml``-style estimator whose work runs on executors.  Column names are taken from a
frozen :class:`PanelSpec` so the operators are not tied to one study's column names.
"""

from panelspark.spec import PanelSpec, PANEL, FEATURE_COLUMNS, nan_to_null  # noqa: F401
from panelspark.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["PanelSpec", "PANEL", "FEATURE_COLUMNS", "nan_to_null", "get_session", "checkpoint_dir"]
