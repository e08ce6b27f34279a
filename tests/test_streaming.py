import datetime as dt
import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from soukline.operators import learning
from soukline.streaming import jobs, stateful

EVENTS = "event_id bigint, user_id bigint, ts timestamp_ntz, value double"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def land(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_takes_only_new_files_and_keeps_the_newest_version(spark, place):
    source, target = place("in"), place("out")
    land(spark, source, [(1, 7, day(0), 1.0), (2, 8, day(1), 2.0)])
    stream = lambda: jobs.file_stream(spark, source, EVENTS)
    assert jobs.ingest_daily(stream(), target, "ts").count() == 2
    land(spark, source, [(3, 7, day(2), 3.0)])
    log = jobs.ingest_daily(stream(), target, "ts")
    assert log.count() == 3 and log.select(jobs.BATCH).distinct().count() == 2
    assert jobs.ingest_daily(stream(), target, "ts").count() == 3  # nothing new
    newest = jobs.latest_rows(log.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"])
    assert sorted((r.user_id, r.value) for r in newest.collect()) == [(7, 3.0), (8, 2.0)]


def test_a_replayed_batch_replaces_itself(spark, place):
    source, target = place("in"), place("out")
    land(spark, source, [(1, 7, day(0), 1.0)])
    jobs.write_batches(jobs.file_stream(spark, source, EVENTS), target)
    # Progress lost, data kept: the same batch number runs again through the job.
    shutil.rmtree(f"{target}/progress")
    jobs.write_batches(jobs.file_stream(spark, source, EVENTS), target)
    assert jobs.read_batches(spark, target).count() == 1


def test_state_is_merged_batch_by_batch_and_replays_to_itself(spark, place):
    source, target = place("in"), place("out")
    land(spark, source, [(1, 7, day(0), 1.0), (2, 8, day(1), 2.0)])
    merge = lambda: stateful.merge_buckets(jobs.file_stream(spark, source, EVENTS), target, "user_id", ["ts", "event_id"])
    rows = lambda df: sorted((r.user_id, r.value) for r in df.collect())
    assert rows(merge()) == [(7, 1.0), (8, 2.0)]
    land(spark, source, [(3, 7, day(2), 3.0), (4, 8, day(0), 9.0)])
    assert rows(merge()) == [(7, 3.0), (8, 2.0)]
    assert rows(merge()) == [(7, 3.0), (8, 2.0)]  # nothing new
    for name in ("1", ".1.crc"):  # the second batch runs again
        os.remove(f"{target}/progress/commits/{name}")
    assert rows(merge()) == [(7, 3.0), (8, 2.0)]


def test_daily_value_equals_the_batch_result_over_several_files(spark, place):
    source, target = place("in"), place("out")
    rows = [(i, i % 3, day(i // 10, i % 24), float(i)) for i in range(60)]
    for part in range(3):
        land(spark, source, rows[part * 20:(part + 1) * 20])
    stream = jobs.file_stream(spark, source, EVENTS, per_batch=1)
    jobs.write_batches(jobs.daily_value(stream, "ts", F.col("value"), "3 days"), target, mode="update")
    got = {r.day: (float(r.value), r.events) for r in jobs.latest_per_day(jobs.read_batches(spark, target)).collect()}
    want = {}
    for _, _, at, value in rows:
        total, n = want.get(at.date(), (0.0, 0))
        want[at.date()] = (total + value, n + 1)
    assert got == want


def test_inactive_customers_fire_once_per_silence(spark, place):
    source, target = place("in"), place("out")
    rows = [(1, 7, day(0), 1.0), (2, 7, day(5), 1.0), (3, 7, day(40), 1.0), (4, 8, day(60), 1.0)]
    land(spark, source, rows)
    stream = jobs.file_stream(spark, source, EVENTS)
    jobs.write_batches(jobs.inactive_customers(stream, "user_id", "ts", days=10), target)
    got = sorted((r.user_id, r.inactive_since, r.orders) for r in jobs.read_batches(spark, target).collect())
    assert got == [(7, day(15), 2), (7, day(50), 1)]  # user 8 is still inside the gap


def test_alerts_need_an_open_order_in_a_risky_place(spark, place):
    source, target = place("in"), place("out")
    schema = "order_id string, customer_id string, order_status string, order_estimated_delivery_date timestamp_ntz"
    land(spark, source, [("1", "a", "shipped", day(9)), ("2", "a", "delivered", day(9)), ("3", "b", "shipped", day(9)),
                         ("4", "a", "shipped", day(1))], schema)
    places = spark.createDataFrame([("a", "AA"), ("b", "BB")], "customer_id string, customer_state string")
    risk = spark.createDataFrame([("AA", 0.5), ("BB", 0.1)], "customer_state string, late_rate double")
    as_of, limit = F.lit(day(5)).cast("timestamp_ntz"), F.lit(0.3)
    jobs.write_batches(jobs.late_delivery_alerts(jobs.file_stream(spark, source, schema), places, risk, as_of, limit), target)
    assert [r.order_id for r in jobs.read_batches(spark, target).collect()] == ["1"]


def test_model_scores_a_stream(spark, place):
    i = F.col("id")
    late = (i % 2).cast("int")
    rows = spark.range(80).select(
        i.cast("string").alias("order_id"), *[(late * 5 + i % 3).cast("double").alias(c) for c in learning.DELAY_NUMBERS],
        *[F.lit("v").alias(c) for c in learning.DELAY_NAMES], late.alias("is_late"),
    )
    fitted = learning.fit_delay(rows, trees=5, depth=3)
    source, target = place("in"), place("out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    jobs.write_batches(jobs.scored_alerts(stream, fitted.model), target)
    assert sorted(int(r.order_id) % 2 for r in jobs.read_batches(spark, target).collect()) == [1] * 40
