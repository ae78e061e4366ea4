"""Shared pieces of the registered queries: the registry, the binding inputs and the SQL CTE lists.

Every query reads the driver's tables through the panel binding, so its work grows with them.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators import features as feat
from panelspark.operators import split as spl
from panelspark.plans import oracle as O
from panelspark.session import checkpoint_dir
from panelspark.sources import bindings

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ── shared inputs ────────────────────────────────────────────────────────────

def panel(spark, sf):
    return bindings.panel(spark, sf)


def ipanel(spark, sf):
    p = panel(spark, sf)
    return feat.GroupMedianImputer(("mmse", "ses")).fit(p).transform(p)


def features(spark, sf, **kw):
    p = panel(spark, sf)
    return feat.participant_features(p, imputer=feat.GroupMedianImputer(("mmse", "ses")).fit(p), **kw)


def raw_features(spark, sf, **kw):
    return feat.participant_features(panel(spark, sf), **kw)


def predictions(spark, sf):
    return bindings.predictions(raw_features(spark, sf))


def new_folder(spark, name: str) -> str:
    """A new folder in the shared place."""
    return f"{checkpoint_dir(spark).rstrip('/')}/panelspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sql(*ctes: str, body: str) -> str:
    return O.with_ctes(*ctes) + "\n" + body


BASE = O.base_ctes()
BASE_SYN = O.base_ctes(extra=", a.synthetic AS synthetic")
PRED = O.prediction_ctes()
PANEL_ONLY = [O.PANEL_CTE]
IPANEL = [O.PANEL_CTE, O.IMPUTED_CTE]

SUBJ = [O.PANEL_CTE, O.SUBJ_CTE]

FORCED = "(NOT coalesce(synthetic, false) AND cdr_worsened_after_v2 = 1)"
SPLIT = BASE_SYN + [O.split_ctes("features", "split1", 0.2, FORCED, "test", "test", "train")]
VSPLIT = SPLIT + [
    "trainonly AS (SELECT * EXCLUDE (split) FROM split1 WHERE split = 'train')",
    O.split_ctes("trainonly", "split2", 0.15, "false", "validation", "validation", "train"),
]


def split_features(spark, sf):
    return spl.train_test_split(features(spark, sf, extra_static=("synthetic",)))


TRAIN = SPLIT + ["train_ AS (SELECT * FROM split1 WHERE split = 'train')",
                 "test_ AS (SELECT * FROM split1 WHERE split = 'test')"]


def train_test(spark, sf):
    s = split_features(spark, sf)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
