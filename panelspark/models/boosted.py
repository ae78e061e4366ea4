"""Boosted trees with MLlib.

Label encoding (F6, alphabetical, unseen -> error) and feature assembly (P5) are fitted on
the training frame inside one ``Pipeline``; the positive class is up-weighted by
n_negative / n_positive through ``weightCol``.
"""

from __future__ import annotations

import hashlib

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from panelspark.operators.features import class_weight_value
from panelspark.session import checkpoint_dir, stored
from panelspark.spec import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES

# Tree parameters of the reference model.
N_TREES = 200
MAX_DEPTH = 4
LEARNING_RATE = 0.05
SUBSAMPLE = 0.8
COLUMN_SAMPLE = 0.8
SEED = 42
TASK_ROWS = 1 << 14              # training rows that a task of a boosting round reads


def feature_names(include_categorical: bool = True) -> list[str]:
    return NUMERIC_FEATURES + ([f"{c}_idx" for c in CATEGORICAL_FEATURES] if include_categorical else [])


def boosted_pipeline(n_trees: int = N_TREES, max_depth: int = MAX_DEPTH, step: float = LEARNING_RATE,
                     subsample: float = SUBSAMPLE, colsample: float = COLUMN_SAMPLE, seed: int = SEED,
                     include_categorical: bool = True, checkpoint_interval: int = 10) -> Pipeline:
    stages = []
    if include_categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                                 handleInvalid="error") for c in CATEGORICAL_FEATURES]
    stages.append(VectorAssembler(inputCols=feature_names(include_categorical), outputCol="features",
                                  handleInvalid="keep"))
    stages.append(GBTClassifier(featuresCol="features", labelCol=LABEL, weightCol="_w", maxIter=n_trees,
                                maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                                featureSubsetStrategy=str(colsample), seed=seed, lossType="logistic",
                                checkpointInterval=checkpoint_interval, cacheNodeIds=False))
    return Pipeline(stages=stages)


def with_weights(train: DataFrame) -> tuple[DataFrame, float]:
    w = class_weight_value(train)
    return train.withColumn("_w", F.when(F.col(LABEL) == 1, F.lit(w)).otherwise(F.lit(1.0))), w


def fit_boosted(train: DataFrame, **kw) -> PipelineModel:
    """M1: fit on the training frame.  Boosting reads it every round, so it is written once to
    the shared checkpoint folder: the rounds scan a plain file instead of re-running the
    feature / split lineage, and a lost executor does not recompute it.  A file's row group is read by one
    task, so many rows are dealt to as many files as TASK_ROWS asks for; the number follows from the rows alone."""
    checkpoint_dir(train.sparkSession)                # MLlib checkpoints the boosting state there
    weighted, _ = with_weights(train)
    parts = -(-train.count() // TASK_ROWS)
    if parts > 1:
        weighted = weighted.repartition(parts, "subject_id")
    weighted = stored(weighted.withColumn(LABEL, F.col(LABEL).cast("double")), "boosted-train")
    return boosted_pipeline(**kw).fit(weighted)


def content_key(df: DataFrame, **parameters) -> str:
    """A name for a training frame and parameters: equal rows, in any order, and equal parameters give equal names."""
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("y"),
               F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    told = repr((cols, tuple(r), sorted(parameters.items())))
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def fit_boosted_once(train: DataFrame, folder: str, **kw) -> PipelineModel:
    """M1 with a model store: the model of this very frame and these parameters is loaded from ``folder`` if it was
    fitted before, else fitted and written there.  A folder that was not written to its end is fitted anew."""
    path = f"{folder.rstrip('/')}/boosted-{content_key(train, **kw)}"
    try:
        return PipelineModel.load(path)
    except Exception as e:                            # MLlib reports an absent or unfinished folder in several ways
        if not any(word in str(e) for word in ("not exist", "PATH_NOT_FOUND", "empty collection", "InvalidInput")):
            raise
    model = fit_boosted(train, **kw)
    model.write().overwrite().save(path)
    return model


def score_boosted(model: PipelineModel, df: DataFrame, model_name: str = "boosted") -> DataFrame:
    """M2: long predictions (model, subject_id, participant_group, y, yhat, score)."""
    out = model.transform(df.withColumn("_w", F.lit(1.0)))
    return out.select(F.lit(model_name).alias("model"), "subject_id", "participant_group",
                      F.col(LABEL).cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"),
                      vector_to_array("probability")[1].alias("score"))


def feature_importance_topk(model: PipelineModel, k: int = 10, include_categorical: bool = True) -> DataFrame:
    """Features by importance, top k (a small driver-side table: one row per feature)."""
    gbt = model.stages[-1]
    names = feature_names(include_categorical)
    imp = gbt.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)
