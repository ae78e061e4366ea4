"""A durable store of predictor answers, written by a Python data source.

A scoring job writes its prompts into the store; the writer asks the predictor and keeps every batch of
answers as one file, which is moved into place whole as soon as the batch is answered.  So an answer counts from
that moment on, whatever becomes of its task: another attempt, or another run, reads which prompts of its
buckets are answered and asks for the rest only.  At most one batch for each running task is ever asked again.

Layout: ``<store>/bucket=<n>/<name>.parquet`` with (prompt_hash, response); ``<store>/_commits/<job>.json``, one for each job
that ended, with the files, the asked and the skipped prompts of its tasks; and ``<store>/_buckets-<count>``: a store keeps
its bucket count for life.  A task holds whole buckets, so the hashes it has to know are those of its own share.  The store can lie wherever pyarrow's file systems reach (a local or
mounted path, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from panelspark.session import ship_package

Predictor = Callable[[list[str]], list[str]]
ANSWER = "prompt_hash string, response string"
BUCKETS = 64                     # of a new store; a batch of prompts lies in one bucket, a task holds one at least


@dataclass
class AnswersCommit(WriterCommitMessage):
    """What a task has done: its files, how many prompts it asked, and how many were answered before."""
    files: list
    asked: int
    skipped: int


def _bucket(count: int) -> Column:
    return F.pmod(F.conv(F.substring("prompt_hash", 1, 8), 16, 10).cast("long"), F.lit(count)).cast("int")


def _bucket_count(store: str, wanted: int) -> int:
    """The store's bucket count; a new store gets ``wanted`` buckets."""
    from pyarrow import fs
    files, root = _file_system(store)
    for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("_buckets-"):
            return int(f.base_name.removeprefix("_buckets-"))
    files.create_dir(root, recursive=True)
    files.open_output_stream(f"{root}/_buckets-{wanted}").close()
    return wanted


def _file_system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def _answered(files, folder: str) -> set[str]:
    """Hashes of the prompts that files of a bucket's folder answer."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    out: set[str] = set()
    for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")):
            out.update(pq.read_table(f.path, filesystem=files, columns=["prompt_hash"]).column(0).to_pylist())
    return out


def _sink(factory: Callable[[], Predictor], batch_size: int, pause: float, name: str) -> type[DataSource]:
    """A data source class that holds the predictor factory (classes made here travel by value)."""

    class AnswersWriter(DataSourceArrowWriter):
        def __init__(self, options):
            self.path = options["path"]

        def write(self, iterator):
            import time

            import pyarrow as pa
            import pyarrow.parquet as pq
            files, root = _file_system(self.path)
            predict, known, done = factory(), {}, AnswersCommit([], 0, 0)
            pending: list[tuple[int, str, str]] = []

            def flush():
                if not pending:
                    return
                answers = predict([p for _, _, p in pending])
                if len(answers) != len(pending):
                    raise ValueError(f"the predictor gave {len(answers)} answers to {len(pending)} prompts")
                table = pa.table({"prompt_hash": [h for _, h, _ in pending], "response": answers},
                                 schema=pa.schema([("prompt_hash", pa.string()), ("response", pa.string())]))
                bucket = pending[0][0]
                folder, leaf = f"{root}/bucket={bucket}", f"{uuid.uuid4().hex}.parquet"
                files.create_dir(folder, recursive=True)
                pq.write_table(table, f"{folder}/_{leaf}", filesystem=files)
                files.move(f"{folder}/_{leaf}", f"{folder}/{leaf}")
                known[bucket].update(h for _, h, _ in pending)
                done.files.append(f"bucket={bucket}/{leaf}")
                done.asked += len(pending)
                pending.clear()
                if pause:
                    time.sleep(pause)

            for batch in iterator:
                rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "prompt_hash", "prompt")))
                for row in rows:
                    if pending and pending[0][0] != row[0]:
                        flush()                              # a file holds answers of one bucket
                    if row[0] not in known:
                        known[row[0]] = _answered(files, f"{root}/bucket={row[0]}")
                    if row[1] in known[row[0]]:
                        done.skipped += 1
                        continue
                    pending.append(row)
                    if len(pending) >= batch_size:
                        flush()
            flush()
            return done

        def commit(self, messages):
            files, root = _file_system(self.path)
            told = [m for m in messages if m is not None]
            files.create_dir(f"{root}/_commits", recursive=True)
            with files.open_output_stream(f"{root}/_commits/{uuid.uuid4().hex}.json") as out:
                out.write(json.dumps({"files": [f for m in told for f in m.files], "asked": sum(m.asked for m in told),
                                      "skipped": sum(m.skipped for m in told)}).encode())

        def abort(self, messages):
            """Answers that are in place stay: they were asked and need not be asked again."""

    class Answers(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "bucket int, prompt_hash string, prompt string"

        def writer(self, schema, overwrite):
            return AnswersWriter(self.options)

    return Answers


def ask(prompts: DataFrame, store: str, factory: Callable[[], Predictor], batch_size: int = 64, pause: float = 0.0,
        partitions: int | None = None, buckets: int = BUCKETS) -> None:
    """Answer every prompt of (prompt_hash, prompt) that the store does not answer yet.

    One predictor for each task; ``partitions`` bounds how many run at a time.  Equal hashes are asked once."""
    spark = prompts.sparkSession
    ship_package(spark)
    name = f"panelspark_answers_{uuid.uuid4().hex}"
    spark.dataSource.register(_sink(factory, batch_size, pause, name))
    rows = prompts.select(_bucket(_bucket_count(store, buckets)).alias("bucket"), "prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    rows = rows.repartition(partitions, "bucket") if partitions else rows.repartition("bucket")
    rows.sortWithinPartitions("bucket", "prompt_hash").write.format(name).mode("append").option("path", store).save()


def answers(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_hash, response): one answer for each prompt of the store.

    Two attempts of a task that ran at the same time may both have answered a prompt; the lesser answer stands."""
    rows = spark.read.schema(ANSWER).option("recursiveFileLookup", True).parquet(store)
    return rows.groupBy("prompt_hash").agg(F.min("response").alias("response"))


def commits(spark: SparkSession, store: str) -> DataFrame:
    """One row for each job that ended: its files, asked and skipped prompts."""
    return spark.read.schema("files array<string>, asked long, skipped long").json(f"{store.rstrip('/')}/_commits/*.json")
