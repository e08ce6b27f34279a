import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from soukline.operators import learning, lloyd


@pytest.fixture(scope="module")
def vectors(spark):
    """Five groups of sixty rows, apart by ten, and rows that are repeated."""
    i = F.col("id")
    noise = [F.pmod(F.xxhash64(i, F.lit(s)), F.lit(1000)) / 1000 for s in (1, 2)]
    points = spark.range(300).select("id", (i % 5 * 10 + noise[0]).alias("x"), (i % 5 % 2 * 10 + noise[1]).alias("y"))
    return learning.scaled_vectors(points.union(points.filter("id < 5")), ["x", "y"]).repartition(3).cache()


def test_all_starts_share_the_passes(spark, vectors):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    vectors.count()
    before = jobs()
    learning.best_kmeans(vectors, [3, 4, 5, 6], starts=10)
    # forty fits one by one take several hundred jobs
    assert jobs() - before < 60


def test_costs_and_places_by_hand(vectors):
    models = learning.best_kmeans(vectors, [4, 5], starts=5)
    x = np.array([r.x for r in vectors.select(vector_to_array("features").alias("x")).collect()])
    for k, model in models.items():
        gaps = ((x[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2)
        assert model.summary.trainingCost == pytest.approx(gaps.min(axis=1).sum())
        placed = model.transform(vectors).select(vector_to_array("features").alias("x"), "prediction").collect()
        own = ((np.array([r.x for r in placed])[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(axis=2)
        assert [r.prediction for r in placed] == own.argmin(axis=1).tolist()
    # each group is one cluster, about its own mean
    five = models[5].transform(vectors).groupBy(F.col("id") % 5).agg(F.countDistinct("prediction").alias("n")).collect()
    assert [r.n for r in five] == [1] * 5
    means = [x[np.abs(x - c).max(axis=1) < 0.3].mean(axis=0) for c in models[5].clusterCenters()]
    assert np.allclose(means, models[5].clusterCenters())


def test_fewer_places_than_clusters(spark):
    points = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "id int, x double")
    model = learning.best_kmeans(learning.scaled_vectors(points, ["x"]), [4], starts=3)[4]
    assert model.summary.trainingCost == pytest.approx(0) and sorted(c[0] for c in model.clusterCenters()) == [-1.0, 1.0]


def test_no_rows_is_an_error(spark):
    none = learning.scaled_vectors(spark.createDataFrame([], "id int, x double"), ["x"])
    with pytest.raises(ValueError):
        learning.best_kmeans(none, [2], starts=2)


def test_equally_near_centres_count_once():
    centres = np.array([[0.0], [2.0], [2.0]])
    assert lloyd._held(np.array([[1.0], [2.0], [-1.0]]), centres).tolist() == [[1.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]
