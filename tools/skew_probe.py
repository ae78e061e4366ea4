"""Measure task balance on a panel where one subject holds a third of the rows.

Runs a plain per-subject window, the bucketed positions (``visit_interval``) and the joins with
per-subject tables (J1, J4, C8) with the event log written to a fresh scratch folder, then prints
per-stage shuffle-read records per task (max / median).  Broadcasts are off and the skew
thresholds low, so that the joins behave as on a table too large to broadcast.  usage: python tools/skew_probe.py [hot_rows]
"""

import collections
import glob
import io
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import Window, functions as F  # noqa: E402

from panelspark.operators import cohort as coh, compare as cmpo  # noqa: E402
from panelspark.session import get_session, stored  # noqa: E402


def stage_balance(log_dir):
    path = glob.glob(os.path.join(log_dir, "*", "events_*"))[0]
    raw = open(path, "rb").read()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode() if path.endswith(".zstd") else raw.decode()
    group, tasks = {}, collections.defaultdict(list)
    for line in text.splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for sid in e["Stage IDs"]:
                group[sid] = (e.get("Properties") or {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks[e["Stage ID"]].append((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
    for sid in sorted(tasks):
        recs = sorted(tasks[sid])
        if recs[-1]:
            print(f"stage {sid:3d} {str(group.get(sid)):9s} tasks={len(recs)} max={recs[-1]} median={recs[len(recs) // 2]}")


def main():
    hot_rows = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = get_session("local[8]", 64, conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                              "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                              "spark.sql.autoBroadcastJoinThreshold": "-1",
                                              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                                              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400k",
                                              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                                              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500k",
                                              "spark.sql.files.maxPartitionBytes": "2m"})
    hot = spark.range(hot_rows).select(F.lit("HOT").alias("subject_id"), (F.col("id") + 1).cast("int").alias("visit"))
    cold = spark.range(2 * hot_rows).select(
        F.concat(F.lit("C"), (F.col("id") % 100000).cast("string")).alias("subject_id"),
        (F.floor(F.col("id") / 100000) + 1).cast("int").alias("visit"))
    p = stored(hot.unionByName(cold).repartition(64).select("subject_id", F.concat_ws("_", "subject_id", F.col("visit").cast("string")).alias("visit_id"),
                                     "visit", (F.col("visit") * 30).cast("int").alias("mr_delay"),
                                     F.lit("N").alias("grp"), F.lit(28.0).alias("mmse")), "probe")
    spark.sparkContext.setJobGroup("naive", "per-subject window")
    w = Window.partitionBy("subject_id").orderBy("visit", "visit_id")
    p.select("*", F.row_number().over(w).alias("r"), F.lag("mr_delay").over(w).alias("l")) \
        .write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("bucketed", "bucketed positions")
    coh.visit_interval(p, width=1024).write.format("noop").mode("overwrite").save()
    subjects = p.select("subject_id").distinct()
    cases = subjects.select("subject_id", F.lit("N").alias("participant_group"), F.lit(1).alias("cdr_worsened_after_v2"),
                            *[F.lit(1).alias(f"{m}_prediction") for m in cmpo.MODELS])
    for name, run in (("J1", lambda: coh.panel_with_subject_group(p)), ("J4", lambda: coh.subject_trajectories(p, subjects)),
                      ("C8", lambda: cmpo.positive_case_trajectories(cases, p))):
        spark.sparkContext.setJobGroup(name, name)
        run().write.format("noop").mode("overwrite").save()
    spark.stop()
    stage_balance(log_dir)


if __name__ == "__main__":
    main()
