"""Readers and writers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelspark.session import stored
from panelspark.spec import CSV_HEADER_TO_PANEL, PANEL, PANEL_SCHEMA, PanelSpec, nan_to_null

PANEL_SCHEMA_WITH_FLAG = T.StructType(PANEL_SCHEMA.fields + [T.StructField("synthetic", T.BooleanType(), True)])


# Texts that mean a missing value in a study CSV (exact, after stripping blanks).
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                  "NaN", "None", "n/a", "nan", "null"]


def _study_text(spark: SparkSession, path: str) -> DataFrame:
    """A study CSV as text under panel names; a missing panel column is an error."""
    raw = spark.read.option("header", True).csv(path)
    renamed = raw.toDF(*[CSV_HEADER_TO_PANEL.get(c.strip(), c.strip()) for c in raw.columns])
    absent = [f.name for f in PANEL_SCHEMA.fields if f.name not in renamed.columns]
    if absent:
        raise ValueError(f"{path}: missing columns {', '.join(absent)}")
    return renamed


def _cell(f: T.StructField) -> tuple[Column, Column]:
    """(text of a cell, NULL where it is missing; its value, NULL where it cannot be read)."""
    text = F.trim(F.col(f"`{f.name}`"))
    text = F.when(~text.isin(MISSING_TOKENS), text)
    if isinstance(f.dataType, T.StringType):
        return text, text
    if isinstance(f.dataType, T.IntegerType):
        # integer columns may arrive as '12' or '12.0'
        whole = F.expr(f"try_cast(trim(`{f.name}`) as double)")
        return text, F.when(text.isNotNull() & (whole == F.floor(whole)), whole).try_cast("int")
    return text, F.when(text.isNotNull(), text.try_cast(f.dataType))


def _panel_fields(renamed: DataFrame) -> tuple[list[T.StructField], list[Column]]:
    """The panel's fields that the file has, and its other columns, kept as text."""
    known = [f for f in PANEL_SCHEMA_WITH_FLAG.fields if f.name in renamed.columns]
    names = {f.name for f in known}
    return known, [F.col(f"`{c}`") for c in renamed.columns if c not in names]


def read_panel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a study panel.  CSV headers are stripped of blanks and mapped to panel names;
    types come from an explicit schema (no inference pass).

    Missing-value tokens and NaN become NULL.  A value that cannot be read as its column's type
    is an error that names the column, never a silent NULL (``read_panel_with_rejects`` sets such cells
    aside instead).  Columns outside the schema are kept as text after the panel columns; a missing panel
    column is an error."""
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    renamed = _study_text(spark, path)
    fields, extra = _panel_fields(renamed)
    typed = []
    for f in fields:
        text, value = _cell(f)
        bad = F.raise_error(F.concat(F.lit(f"{f.name}: cannot read "), text))
        typed.append(F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(value, bad)).cast(f.dataType).alias(f.name))
    return nan_to_null(renamed.select(*typed, *extra))


class PanelRead(NamedTuple):
    """A panel read with its rejects.

    ``rejects``: (file, subject_id, visit_id, visit, column_name, text), one row for each cell that could not be read, with the
    row's own key texts.  ``totals``: (column_name, n_cells, n_rows_dropped), with a total in the row whose column_name is NULL;
    a row dropped for several cells counts once in the total."""
    panel: DataFrame
    rejects: DataFrame
    totals: DataFrame


def read_panel_with_rejects(spark: SparkSession, path: str) -> PanelRead:
    """S1, lenient: cells that cannot be read are set aside and the job goes on.

    A cell that cannot be read is NULL in the panel.  Where it stands in a column that may not be NULL (the visit number),
    or the subject, the visit id or the visit number is missing, the row cannot be placed and is left out of the panel; a missing key
    is a reject with NULL text.  Every such cell is one row of the rejects.  The file is parsed once into a stored table, so
    panel, rejects and totals agree."""
    renamed = _study_text(spark, path).withColumn("_file", F.input_file_name())
    fields, extra = _panel_fields(renamed.drop("_file"))
    values, bad = [], []
    for f in fields:
        text, value = _cell(f)
        values.append(value.cast(f.dataType).alias(f.name))
        unreadable = text.isNotNull() & value.isNull()
        lost = unreadable if f.nullable else text.isNull() | value.isNull()
        bad.append(F.when(lost, F.struct(F.lit(f.name).alias("column_name"), text.alias("text"), F.lit(not f.nullable).alias("key"))))
    keys = F.struct(*[F.trim(F.col(f"`{c}`")).alias(c) for c in ("subject_id", "visit_id", "visit")])
    parsed = stored(renamed.select(F.struct(*values, *extra).alias("row"), F.col("_file"), keys.alias("keys"),
                                   F.array_compact(F.array(*bad)).alias("bad")), "parsed-panel")
    placed = parsed.where(~F.exists("bad", lambda b: b["key"]))
    cells = parsed.where(F.size("bad") > 0).select(F.col("_file").alias("file"), "keys.*", F.explode("bad").alias("b"))
    rejects = cells.select("file", "subject_id", "visit_id", "visit", "b.column_name", "b.text")
    flags = parsed.where(F.size("bad") > 0).select("bad", F.exists("bad", lambda b: b["key"]).cast("long").alias("dropped"))
    per_column = (flags.select("dropped", F.explode("bad").alias("b")).groupBy("b.column_name")
                  .agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.when(F.col("b.key"), F.col("dropped")).otherwise(0)).alias("n_rows_dropped")))
    whole = flags.agg(F.lit(None).cast("string").alias("column_name"), F.coalesce(F.sum(F.size("bad")), F.lit(0)).cast("long").alias("n_cells"),
                      F.coalesce(F.sum("dropped"), F.lit(0)).alias("n_rows_dropped"))
    return PanelRead(nan_to_null(placed.select("row.*")), rejects, per_column.unionByName(whole))


def read_first_existing(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """Read the first path that exists, on any store Spark can read."""
    for p in paths:
        try:
            return read_panel(spark, p, fmt)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths} exists")


def write_feature_splits(split: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3: feature rows partitioned by ``split`` (readers prune to one split)."""
    split.write.mode("overwrite").partitionBy("split").format(fmt).option("header", True).save(path)


def read_feature_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Feature rows back, optionally one split (partition pruning)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_augmented_panel(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Real + generated panel."""
    panel.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_panel_store(panel: DataFrame, table: str, buckets: int, path: str | None = None, spec: PanelSpec = PANEL) -> None:
    """S4 for panels that are read often: a table bucketed by subject and sorted by (visit, visit_id) within.

    Everything that groups or joins by subject then reads its rows where they lie: no exchange of panel rows.  ``buckets`` fixes
    the parallelism of such reads; about the panel's bytes / 200 MB.  Rows with a NULL subject are refused."""
    if not panel.where(F.col(spec.subject).isNull()).limit(1).isEmpty():
        raise ValueError("a panel store has no NULL subjects")
    writer = (panel.repartition(buckets, spec.subject).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, spec.subject).sortBy(spec.visit, spec.visit_id))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_panel_store(spark: SparkSession, table: str) -> DataFrame:
    """The bucketed panel back."""
    return spark.table(table)


def write_predictions(pred: DataFrame, path: str) -> None:
    """Long predictions partitioned by model.

    Only the models in ``pred`` are replaced; other models' folders stay.  Writing without rows replaces nothing."""
    pred.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


PREDICTION_SCHEMA = "subject_id string, participant_group string, y int, yhat int, score double, model string"


def read_predictions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """S5 back: the predictions of all models in the folder, or of some (partition pruning)."""
    df = spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    return df.where(F.col("model").isin(models)) if models is not None else df


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One metrics row per model; as with predictions, only the models written are replaced."""
    metrics.withColumn("_model", F.col("model")).coalesce(1).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("_model").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S6 back: the rows of all models in the folder."""
    return spark.read.parquet(path).drop("_model")


def write_comparison(cmp: DataFrame, path: str) -> None:
    """The per-subject comparison table."""
    cmp.write.mode("overwrite").parquet(path)
