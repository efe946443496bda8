"""Registered queries against their SQL, in separate processes."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["resolve_sanitize", "feature_table_totals", "obfuscation_features", "stratified_kfold",
          "class_report", "augment_sample", "explanations", "stream_heuristic", "top5_cases_per_technique"]


def test_every_statement_has_a_query():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_queries_match_their_sql():
    tool = os.path.join(ROOT, "tools", "check_oracles.py")
    done = subprocess.run([sys.executable, tool, "0.001", *SAMPLE], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-3000:]


def test_shared_folder_follows_the_session(spark):
    from groundtrace.session import shared_folder, stored

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert folder and shared_folder(spark) == folder
    assert stored(spark.range(3)).count() == 3
    assert any(name.startswith("groundtrace-") for name in os.listdir(folder))


def test_scratch_removes_what_it_stored(spark):
    from groundtrace.session import scratch, stored

    with scratch(spark) as folder:
        assert stored(spark.range(3)).count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)


def test_events_of_one_small_file_are_dealt_out(spark, tmp_path):
    """A table that compresses to less than one split is read by one task; its rows are then computed by several."""
    from pyspark.sql import functions as F

    from groundtrace.catalog.binding import process_events
    from groundtrace.session import FEWEST

    rows = 8 * FEWEST
    spark.range(rows).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() == 1
    found = process_events(spark, str(tmp_path))
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 8 and max(counts) <= 2 * FEWEST
    assert found.select("event_key").distinct().count() == sum(counts) == rows
