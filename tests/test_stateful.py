import datetime as dt
import os
import pathlib
import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from soukline.streaming import jobs, stateful

EVENTS = "event_id bigint, user_id bigint, ts timestamp_ntz, value double"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def land(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet") if "/bucket=" in str(p)}


# Upserts


def test_a_batch_rewrites_touched_buckets_only(spark, place):
    source, target = place("in"), place("out")
    merge = lambda: stateful.merge_buckets(jobs.file_stream(spark, source, EVENTS), target, "user_id", ["ts", "event_id"], 8)
    rows = lambda df: sorted((r.user_id, r.value) for r in df.collect())
    land(spark, source, [(u, u, day(0), 1.0) for u in range(200)])
    assert rows(merge()) == [(u, 1.0) for u in range(200)]
    first = files(target)
    land(spark, source, [(900, 7, day(1), 2.0), (901, 7, day(-1), 3.0)])
    want = [(u, 2.0 if u == 7 else 1.0) for u in range(200)]
    assert rows(merge()) == want
    new = {p: t for p, t in files(target).items() if p not in first}
    assert len({pathlib.Path(p).parent.name for p in new}) == 1  # one key, one bucket
    size = lambda paths: sum(os.path.getsize(p) for p in paths)
    assert size(new) < 0.5 * size(first)
    assert rows(merge()) == want  # nothing new
    # the second batch runs again
    for name in ("1", ".1.crc"):
        os.remove(f"{target}/progress/commits/{name}")
    assert rows(merge()) == want


def test_a_batch_cut_off_before_its_manifest_is_not_seen_and_runs_again(spark, place):
    source, target = place("in"), place("out")
    merge = lambda: stateful.merge_buckets(jobs.file_stream(spark, source, EVENTS), target, "user_id", ["ts", "event_id"], 4)
    land(spark, source, [(1, 1, day(0), 1.0), (2, 2, day(0), 1.0)])
    merge()
    land(spark, source, [(3, 1, day(1), 5.0)])
    merge()
    shutil.rmtree(f"{target}/manifest/1")
    for name in ("1", ".1.crc"):
        os.remove(f"{target}/progress/commits/{name}")
    table = stateful.KeyedTable(spark, target, jobs.file_stream(spark, source, EVENTS).schema, "user_id", ["ts", "event_id"], 4)
    assert sorted((r.user_id, r.value) for r in table.rows().collect()) == [(1, 1.0), (2, 1.0)]
    assert sorted((r.user_id, r.value) for r in merge().collect()) == [(1, 5.0), (2, 1.0)]


def test_old_versions_are_swept(spark, place):
    source, target = place("in"), place("out")
    for k in range(6):
        land(spark, source, [(k, u, day(k), float(k)) for u in range(40)])
        stateful.merge_buckets(jobs.file_stream(spark, source, EVENTS), target, "user_id", ["ts", "event_id"], 4)
    assert sorted(int(p.name) for p in pathlib.Path(target, "manifest").iterdir()) == [4, 5]
    assert sorted(p.name for p in pathlib.Path(target, "data").iterdir()) == ["version=4", "version=5"]


# Duplicates


def test_repeats_and_late_rows_go_and_the_state_stays_small(spark, place):
    source, target = place("in"), place("out")
    rng = random.Random(3)
    rows = [(k, k % 5, day(k // 4, k % 4), float(k)) for k in range(400)]
    for part in range(10):
        piece = rows[part * 40: (part + 1) * 40]
        piece = piece + rng.sample(piece, 20)
        rng.shuffle(piece)
        land(spark, source, piece)
    stream = jobs.file_stream(spark, source, EVENTS, per_batch=1)
    found = stateful.first_seen(stream, ["event_id"], "ts", "12 days")
    reports = stateful.run(found, f"{target}/progress", lambda df, n: df.write.mode("overwrite").parquet(f"{target}/data/batch={n}"))
    got = spark.read.parquet(f"{target}/data")
    assert sorted(r.event_id for r in got.collect()) == list(range(400))
    told = stateful.state_report(reports)
    assert told["most"] < 150 and told["late"] == 0
    land(spark, source, [(9000, 1, day(0), 0.0), (399, 1, day(99, 3), 0.0), (9001, 1, day(120), 0.0)])
    reports = stateful.run(found, f"{target}/progress", lambda df, n: df.write.mode("overwrite").parquet(f"{target}/data/batch={n}"))
    ids = sorted(r.event_id for r in spark.read.parquet(f"{target}/data").collect())
    assert ids == [*range(400), 9001]  # too late, a repeat, and a new one
    assert stateful.state_report(reports)["late"] == 1


# Overdue deliveries

ORDERS = "order_id string, promised timestamp_ntz"
ARRIVED = "order_id string, arrived timestamp_ntz"


@pytest.mark.parametrize("per_batch", [1, None])
def test_an_alert_leaves_when_the_promise_passes_without_a_delivery(spark, place, per_batch):
    asked, came, target = place("asked"), place("came"), place("out")
    land(spark, asked, [("a", day(10)), ("b", day(10)), ("c", day(10)), ("", day(60)), (None, day(1))], ORDERS)
    land(spark, asked, [("d", day(90)), ("e", day(20))], ORDERS)
    land(spark, came, [("a", day(9)), ("b", day(10)), ("c", day(11))], ARRIVED)
    land(spark, came, [("e", day(19)), ("", day(40))], ARRIVED)
    out = stateful.overdue(
        jobs.file_stream(spark, asked, ORDERS, per_batch=per_batch), jobs.file_stream(spark, came, ARRIVED, per_batch=per_batch),
        "order_id", "promised", "arrived", "15 days",
    )
    jobs.write_batches(out, target)
    # c came too late; d is still inside its promise; e came in time
    assert sorted(r.order_id for r in jobs.read_batches(spark, target).collect()) == ["c"]


# The band

BUYS = "customer string, ts timestamp_ntz, counts boolean"


def brute_band(rows, now, after=91, until=181):
    out = []
    for who in {r[0] for r in rows if r[0] and r[2]}:
        times = sorted(r[1] for r in rows if r[0] == who and r[2])
        for at, then in zip(times, [*times[1:], None]):
            entry, lapse = at + dt.timedelta(days=after), at + dt.timedelta(days=until)
            if entry <= now and (then is None or entry <= then):
                out.append((who, entry, "entered", at))
                if lapse <= now and (then is None or lapse <= then):
                    out.append((who, lapse, "lapsed", at))
                elif then is not None:
                    out.append((who, then, "ordered", at))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_band_changes_do_not_depend_on_the_batches(spark, place, parts):
    source, target = place("in"), place("out")
    rng = random.Random(8)
    rows = [(f"c{rng.randint(0, 11)}", day(rng.randint(0, 900), rng.randint(0, 23)), True) for _ in range(90)]
    rows += [("c1", day(300), False), (None, day(500), True), ("x", day(0), True), ("x", day(91), True), ("y", day(0), True), ("y", day(181), True)]
    rows = sorted(rows, key=lambda r: (r[1], str(r[0])))
    for k in range(parts):
        piece = rows[k * len(rows) // parts: (k + 1) * len(rows) // parts]
        rng.shuffle(piece)
        land(spark, source, piece, BUYS)
    land(spark, source, [(None, day(1001), False)], BUYS)
    stream = jobs.file_stream(spark, source, BUYS, per_batch=1)
    with stateful.rocks(spark):
        jobs.write_batches(stateful.band_changes(stream, "customer", "ts", F.col("counts")), target)
    changes = jobs.read_batches(spark, target)
    got = sorted((r.customer, r["at"], r.change, r.last_order) for r in changes.collect())
    want = brute_band(rows, day(1000))
    assert got == want
    inside = {w: last for w, at, change, last in sorted(want, key=lambda r: (r[1], r[2] != "entered")) if change == "entered"}
    gone = {(w, last) for w, _, change, last in want if change != "entered"}
    assert sorted((r.customer, r.last_order) for r in stateful.in_band(changes).collect()) == sorted(x for x in inside.items() if x not in gone)
