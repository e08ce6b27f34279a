import numpy as np
import pytest
from pyspark.sql import functions as F

from soukline.operators import forest, learning


def noise(salt, n):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


@pytest.fixture(scope="module")
def rows(spark):
    """Late if the state is v1 and the value is high, or with some noise; the sum spent follows from number and state."""
    state, value = noise(1, 3), noise(2, 1000) / 10
    late = ((state == 1) & (value > 40)) | (noise(3, 10) == 0)
    return spark.range(1500).select(
        F.col("id").cast("string").alias("order_id"), F.col("id").cast("string").alias("customer_unique_id"),
        value.alias("order_total_value"), *[noise(10 + i, 4).cast("double").alias(c) for i, c in enumerate(learning.DELAY_NUMBERS[1:])],
        *[F.concat(F.lit("v"), state if c == "customer_state" else noise(30 + i, 5)).alias(c) for i, c in enumerate(learning.DELAY_NAMES)],
        *[(noise(50 + i, 100) / 7).alias(c) for i, c in enumerate(learning.REPEAT_NUMBERS) if c not in learning.DELAY_NUMBERS],
        late.cast("int").alias("is_late"),
    ).withColumn("total_spent", F.col("first_delivery_days") * 3 + F.when(F.col("customer_state") == "v2", 50).otherwise(0)).cache()


def test_rows_that_stay_grow_the_same_trees(rows, monkeypatch):
    shared = learning.fit_delay(rows, trees=9, depth=6).model.trees
    monkeypatch.setattr(forest, "SHARED", 0)
    monkeypatch.setattr(forest, "HELD", 20_000)  # several passes a level
    spread = learning.fit_delay(rows, trees=9, depth=6).model.trees
    assert (shared.tests == spread.tests).all() and np.allclose(shared.values, spread.values)
    assert np.allclose(shared.weights, spread.weights)
    apart = learning.fit_lifetime_value(rows, trees=3, depth=5)
    monkeypatch.undo()
    whole = learning.fit_lifetime_value(rows, trees=3, depth=5)
    a, b = ({r.customer_unique_id: r.prediction for r in f.scored.select("customer_unique_id", "prediction").collect()} for f in (apart, whole))
    assert a == pytest.approx(b)


def test_the_first_split_by_brute_force(rows, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 200)
    model = learning.fit_delay(rows, trees=6, depth=1).model
    plan = model.plan
    prepared = learning.split_rows(rows.withColumn("label", F.col("is_late").cast("double")), "order_id", "label").filter("is_test = 0")
    told = model.encoding.transform(prepared).select(
        *[F.col(c).cast("double") for c in forest._inputs(model.numbers, model.names)], "label", F.xxhash64("order_id").alias("k")
    ).toPandas()
    codes = forest._coded([told[c].to_numpy() for c in told.columns[:-2]], model.ends, np.int64)
    y = told["label"].to_numpy().astype(int)
    assert plan.weights == pytest.approx([len(y) / 2 / (y == c).sum() for c in (0, 1)])
    for tree, w in enumerate(forest.draws(told["k"].to_numpy().view(np.uint64), range(6), plan.seed)):
        weight = w * np.array(plan.weights)[y]

        def left(side):
            n, one = weight[side].sum(), weight[side & (y == 1)].sum()
            return n - (one * one + (n - one) ** 2) / n if n else 0

        allowed, best = plan.drawn(tree, 0, 1)[0], None
        column = 0
        for f, bins in enumerate(plan.bins):
            for b in range(1, bins) if f < plan.numbers else range(bins):
                right = codes[f] >= b if f < plan.numbers else codes[f] == b
                at = f if f < plan.numbers else column + b
                if allowed[at] and w[right].sum() and w[~right].sum():
                    found = left(right) + left(~right)
                    if best is None or found < best[0] - 1e-9:
                        best = found, weight[right & (y == 1)].sum() / weight[right].sum(), f
            column = plan.numbers + sum(plan.bins[plan.numbers: f + 1]) if f >= plan.numbers else plan.numbers if f == plan.numbers - 1 else 0
        assert model.trees.tests[tree, 0] >> 32 == best[2]
        assert model.trees.values[tree, 1] == pytest.approx(best[1])


def test_jobs_do_not_grow_with_the_depth(spark, rows):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    counts = []
    for depth in (2, 2, 8):
        before = jobs()
        learning.fit_lifetime_value(rows, trees=4, depth=depth)
        counts.append(jobs() - before)
    assert counts[2] == counts[1]


def test_what_is_kept_does_not_grow_with_the_trees(spark, rows, monkeypatch):
    kept, level = {}, forest._level

    def watched(blocks, plan, group):
        out = level(blocks, plan, group)
        kept[plan.trees] = sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return out

    monkeypatch.setattr(forest, "SHARED", 0)
    monkeypatch.setattr(forest, "_level", watched)
    for trees in (2, 40):
        learning.fit_delay(rows, trees=trees, depth=2)
    assert kept[40] < 1.1 * kept[2] + 1000


def test_every_column_has_its_own_name_and_weight(rows):
    fitted = learning.fit_delay(rows, trees=10, depth=5)
    weights = {r.name: r.value for r in fitted.importances().collect()}
    assert len(weights) == fitted.model.plan.columns and sum(weights.values()) == pytest.approx(1, abs=1e-4)
    top = sorted(weights, key=weights.get)[-2:]
    assert set(top) == {"order_total_value", "customer_state_hot_v1"}
    assert weights["seller_state_hot_invalidValues"] == weights["customer_state_hot_invalidValues"] == 0
    assert learning.auc(fitted.scored, "label", "score").first().auc > 0.8


def test_values_and_spread_are_learned(rows):
    fitted = learning.fit_lifetime_value(rows, trees=30, depth=8)
    assert learning.regression_report(fitted.scored, "label", "prediction").first().r2 > 0.95
    assert fitted.scored.filter("prediction < 0 or prediction > 100").count() == 0


def test_draws_are_poisson():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    taken = [w.astype(float) for w in forest.draws(keys, range(9), 42)]
    assert all(abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 for w in taken)
    assert np.abs(np.corrcoef(taken) - np.eye(9)).max() < 0.03


def test_one_class_and_no_rows(rows):
    same = learning.fit_delay(rows.withColumn("is_late", F.lit(1)), trees=3, depth=3)
    assert [r.score for r in same.scored.select("score").distinct().collect()] == [1.0]
    with pytest.raises(ValueError):
        learning.fit_delay(rows.limit(0), trees=2, depth=2)


def test_a_filter_on_the_score_computes_it_once(rows):
    model = learning.fit_delay(rows, trees=2, depth=2).model
    kept = learning.score(model, rows).filter(F.col("score") >= 0.5).select("order_id", "score")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
