import pytest
from pyspark.sql import functions as F

from soukline.operators import learning


def test_auc_counts_pairs(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert learning.auc(df, "y", "s").first().auc == 0.75
    ties = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y int")
    assert learning.auc(ties, "y", "s").first().auc == 0.5


def test_auc_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(400).select(
        (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("s"), F.pmod(F.xxhash64(F.col("id") + 7), F.lit(3)).cast("int").alias("y0")
    ).withColumn("y", (F.col("y0") == 1).cast("double"))
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert learning.auc(df, "y", "s").first().auc == pytest.approx(want, abs=1e-6)


def test_campaign_report(spark):
    rows = [("control", 0.5, 1)] + [("control", 0.5, 0)] * 3
    rows += [("treatment", 0.1, 1), ("treatment", 0.1, 1), ("treatment", 0.9, 1), ("treatment", 0.1, 0)]
    df = spark.createDataFrame(rows, "arm string, score double, again int").withColumn("spent", F.lit(100))
    got = learning.campaign_report(df, "score", "again", "spent").first()
    assert (got.incremental_repeat_purchases, got.redeemed_coupons, got.targeted_customers) == (2, 2, 3)
    assert (got.incremental_revenue, got.total_campaign_cost, got.net_profit, got.roi_pct) == (200.0, 30.0, 170.0, 566.67)


def test_campaign_without_coupons_has_no_return(spark):
    df = spark.createDataFrame([("control", 0.5, 0), ("treatment", 0.5, 1)], "arm string, score double, again int").withColumn("spent", F.lit(10))
    assert learning.campaign_report(df, "score", "again", "spent").first().roi_pct == 0.0


def test_arms_are_halves(spark):
    people = spark.range(101).select(F.col("id").cast("string").alias("person"))
    sizes = dict(map(tuple, learning.assign_arms(people, "person").groupBy("arm").count().collect()))
    assert sizes == {"control": 50, "treatment": 51}


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    parts = learning.split_rows(df, "k", "y").groupBy("y", "is_test").count().collect()
    assert {(r.y, r.is_test): r["count"] for r in parts} == {(0, 0): 630, (0, 1): 270, (1, 0): 70, (1, 1): 30}
    again = learning.split_rows(df.repartition(7), "k", "y")
    assert learning.split_rows(df, "k", "y").exceptAll(again.select("k", "y", "is_test")).count() == 0


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1, 2.0, 7.0), (2, 4.0, 7.0), (3, None, 7.0)], "id int, a double, b double")
    got = learning.standardise(df, ["a", "b"]).orderBy("id").collect()
    assert [round(r.z_a, 6) for r in got] == [0.0, 1.224745, -1.224745]
    assert [r.z_b for r in got] == [0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def delay_rows(spark):
    i = F.col("id")
    big = (i % 4 == 0).cast("int")
    return spark.range(240).select(
        i.cast("string").alias("order_id"), (big * 100 + i % 7).cast("double").alias("order_total_value"),
        *[(i % 3).cast("double").alias(c) for c in learning.DELAY_NUMBERS[1:]],
        *[F.concat(F.lit("v"), i % 3).alias(c) for c in learning.DELAY_NAMES], big.alias("is_late"),
    )


def test_forest_learns_and_explains(delay_rows):
    fitted = learning.fit_delay(delay_rows, trees=10, depth=4)
    summary = {r.name: r.value for r in learning.classifier_summary(fitted, "label").collect()}
    assert summary["auc"] == 1.0 and summary["accuracy recall"] == 1.0
    top = fitted.importances(1).first()
    assert top.name == "order_total_value" and top.value > 0.5
    assert fitted.scored.count() == 72


def test_unseen_names_still_score(spark, delay_rows):
    fitted = learning.fit_delay(delay_rows, trees=3, depth=3)
    odd = delay_rows.limit(3).withColumn("customer_state", F.lit("new"))
    assert learning.score(fitted.model, odd).select("score").count() == 3


def test_best_of_several_starts(spark):
    points = spark.createDataFrame([(i, float(c * 10 + i % 2)) for c in range(4) for i in range(10)], "id int, x double")
    vectors = learning.scaled_vectors(points, ["x"])
    costs = [r.inertia for r in learning.elbow(vectors, range(2, 5), starts=3).orderBy("k").collect()]
    assert costs[0] > costs[1] > costs[2] and costs[2] < 0.1
    assert learning.cluster(vectors, 4, starts=3).select("segment_id").distinct().count() == 4


def test_classification_report_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in learning.classification_report(df, "y", "p").collect()}
    assert got["1"] == (1.0, 0.5, 0.666667, 2) and got["0"] == (0.666667, 1.0, 0.8, 2)
    assert got["accuracy"][0] == 0.75 and got["macro avg"][1] == 0.75


def test_regression_report_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    assert tuple(learning.regression_report(df, "y", "p").first()) == (0.3333, 0.75, 3)


def test_every_tree_has_its_own_draw_with_even_classes(spark, delay_rows):
    rows = delay_rows.withColumn("label", F.col("is_late").cast("double"))
    totals = learning.draw_totals(rows, "order_id", "label", 6)
    assert len({tuple(t[j] for t in totals.values()) for j in range(6)}) > 1
    for j in range(6):
        w = learning.tree_weight("order_id", "label", j, totals)
        sums = {r.label: r.s for r in rows.groupBy("label").agg(F.sum(w).alias("s")).collect()}
        assert sums[0.0] == pytest.approx(sums[1.0])
    big = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    mean = big.agg(F.avg(learning.tree_draw("k", 3)).alias("m"), F.var_pop(learning.tree_draw("k", 3)).alias("v")).first()
    assert mean.m == pytest.approx(1, abs=0.03) and mean.v == pytest.approx(1, abs=0.06)


def test_balanced_forest_learns(delay_rows):
    _, scored = learning.fit_balanced(delay_rows, "order_id", "is_late", learning.DELAY_NUMBERS, learning.DELAY_NAMES, 6, 4)
    assert learning.auc(scored, "label", "score").first().auc == 1.0 and scored.count() == 72
