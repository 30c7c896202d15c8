"""Streams over a table stored as part files, changes to the metering tables, and the shared folder."""

import types

import pytest
from pyspark.sql import functions as F

from ledgerlift import session
from ledgerlift.operators import usage
from ledgerlift.streaming import jobs


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    spark.range(50).withColumn("created_at", F.timestamp_seconds("id")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream = jobs.read_table_stream(spark, str(tmp_path), "events", files_per_batch=1)
    jobs.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_live_admission_charges_like_batch(spark, tmp_path):
    rows = [("a", i, i, 2, 0 if i % 3 == 0 else 2, 11) for i in range(12)]
    asks = spark.createDataFrame(rows, "api_key string, log_id long, sec int, need long, charge long, credits long") \
        .withColumn("created_at", F.timestamp_seconds("sec")).drop("sec")
    asks.coalesce(1).write.parquet(f"{tmp_path}/asks.parquet")
    jobs.write_batches(jobs.live_admission(jobs.read_table_stream(spark, str(tmp_path), "asks")), f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    live = {r.log_id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert live == {r.log_id: r.accepted for r in usage.admit(asks).collect()}


def test_repeated_changes(spark):
    users = spark.createDataFrame([("k1", "A", "prepaid", 5, 0)], "api_key string, customer_name string, plan string, credits_remaining long, pages_processed_this_month long")
    new = spark.createDataFrame([("k9", "B", "prepaid", 1), ("k8", "B", "prepaid", 2), ("k7", "A", "prepaid", 3)],
                                "api_key string, customer_name string, plan string, credits_remaining long")
    assert sorted(r.api_key for r in usage.add_customers(users, new).collect()) == ["k1", "k8"]
    changes = spark.createDataFrame([("k1", "prepaid", 9, 1), ("k1", "pay_as_you_go", 4, 2)], "api_key string, plan string, credits_remaining long, at long")
    assert [(r.plan, r.credits_remaining) for r in usage.update_customers(users, changes, "at").collect()] == [("pay_as_you_go", 4)]
    twice = spark.createDataFrame([("k1", "n1"), ("k1", "n2")], "old_key string, new_key string")
    assert [r.api_key for r in usage.rotate_keys(users, twice, "customer_name").collect()] == ["n2"]


def test_no_machine_local_folder_on_a_cluster():
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(cluster)
