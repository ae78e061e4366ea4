"""Tables written once in the shared folder, and small readers used by all operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import checkpoint_dir, ship_package


BATCH_BYTES = 4 << 20           # of an Arrow batch (one longer row is its own batch)
GROUP_BYTES = 16 << 20          # of a Parquet row group: a task that writes texts holds one in memory


def ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and bound what a task holds at a time.

    Spark's own bounds are 10,000 rows or 64 MB for an Arrow batch and 128 MB for a row group that is
    written; whole texts and blocks of vectors need smaller ones.  The settings stay in the session, since
    plans run after the operator has returned."""
    ship_package(spark)
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage with a table that survives lost executors.  Each call has a folder of
    its own (application id and a random part), so retries and concurrent jobs do not meet.  ``options``
    are the writer's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/panelspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_input(docs: DataFrame, carry: bool) -> list[Column]:
    """Columns for a task that reads texts: doc_id and the text, or the whole row as one struct.

    Inside the struct a row's columns keep their names whatever the operator calls its own."""
    if carry:
        return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    return [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")]


def task_text(batch: pa.RecordBatch) -> pa.Array:
    """The text column of ``task_input`` in a batch."""
    at = batch.schema.get_field_index("row")
    if at >= 0:
        row = batch.column(at)
        return row.field(row.type.get_field_index("text"))
    return batch.column(batch.schema.get_field_index("text"))


def task_output(docs: DataFrame, carry: bool) -> str:
    """DDL of what such a task gives back besides its own columns."""
    if carry:
        return f"row {docs.select(*task_input(docs, True)).schema['row'].dataType.simpleString()}"
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def task_rest(batch: pa.RecordBatch) -> tuple[pa.Array, str]:
    """The column that goes through a task unchanged, and its name."""
    name = "row" if batch.schema.get_field_index("row") >= 0 else "doc_id"
    return batch.column(batch.schema.get_field_index(name)), name
