import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from soukline.operators import ranking


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")


@pytest.mark.parametrize("n,tiles", [(7, 5), (13, 5), (3, 5), (1501, 4), (100, 5)])
def test_ntile_equals_the_window_function(spark, n, tiles):
    rng = random.Random(n)
    df = frame(spark, [rng.randrange(5) for _ in range(n)])  # mostly ties
    got = ranking.ntile(df, tiles, [F.desc("v"), "id"], "tile")
    want = df.withColumn("tile", F.ntile(tiles).over(Window.orderBy(F.desc("v"), "id")))
    assert sorted(map(tuple, got.select("id", "tile").collect())) == sorted(map(tuple, want.select("id", "tile").collect()))


def test_blocks_really_span_partitions(spark):
    blocks = ranking.range_blocks(frame(spark, list(range(1000))), "v", "id")
    assert blocks.select("__block").distinct().count() > 1


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200))
def test_running_totals_and_ranks_equal_the_window_functions(spark, values):
    df = frame(spark, values)
    got = ranking.running_totals(df, [F.desc("v"), "id"], {"upto": "v"}, {"place": "v"})
    order = Window.orderBy(F.desc("v"), "id")
    want = df.select(
        "id", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("v").over(Window.partitionBy()).alias("upto_total"), F.dense_rank().over(Window.orderBy(F.desc("v"))).alias("place"),
    )
    columns = ["id", "upto", "upto_total", "place"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_percentiles_interpolate_per_group(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(40)) for g in "abc" for _ in range(rng.randrange(50, 90))] + [("a", 3)] * 300 + [("d", 5), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    points = {"q1": 0.25, "m": 0.5, "p9": 0.9}
    got = {r.g: (r.q1, r.m, r.p9) for r in ranking.percentiles(df, "v", points, by=["g"]).collect()}
    for g in "abcd":
        want = np.percentile([v for k, v in rows if k == g and v is not None], [25, 50, 90])
        assert got[g] == pytest.approx(tuple(want))
    assert "e" not in got
    whole = ranking.percentiles(df, "v", {"m": 0.5}).first().m
    assert whole == np.median([v for _, v in rows if v is not None])


def test_leading_share_keeps_ties(spark):
    df = frame(spark, [500, 400, 400] + list(range(147)))  # 150 rows: round(1.5) = 2 members
    row = ranking.leading_share(df, "v", 0.01).first()
    assert (row.members, row.leading, row.leading_value, row.cutoff) == (150, 3, 1300, 400)
    assert row.whole_value == 1300 + sum(range(147))


def test_partition_total_repeats_the_group_sum_on_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    out = df.withColumn("t", F.sum("v").over(Window.partitionBy("k")))
    assert sorted(map(tuple, out.collect())) == [("a", 1, 3), ("a", 2, 3), ("b", 5, 5)]
