"""Feature scaling, clustering, forests, splits, metrics and campaign evaluation.

Training runs in Spark ML over rows spread on every core. Metrics are plain
aggregates; the ranked ones use the distributed operators of ``ranking``.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.functions.numbers import ratio, rounded, surrogate_key
from soukline.operators import forest, lloyd, ranking
from soukline.session import cut

# The features of the models, in their order.
SEGMENT_COLUMNS = ["recency_days", "order_count", "total_spent", "avg_review", "avg_delivery_days", "late_delivery_rate"]
REPEAT_NUMBERS = [
    "first_order_value", "first_order_item_count", "first_avg_item_price", "first_avg_freight",
    "first_delivery_days", "first_late_flag", "review_score", "payment_installments",
]
REPEAT_NAMES = ["customer_state", "product_category_name_english"]
DELAY_NUMBERS = [
    "order_total_value", "order_item_count", "avg_item_price", "avg_freight", "payment_installments",
    "first_order_value", "first_order_item_count",
]
DELAY_NAMES = ["payment_type", "customer_state", "seller_state", "product_category_name_english"]


def _rows() -> Column:
    return F.count(F.lit(1))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over the session's shuffle partitions, merged where they are small."""
    return df.repartition(F.col(key))


# --- scaling and clusters -------------------------------------------------

def standardise(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Nulls to 0, then zero mean and unit population deviation; constants become 0."""
    filled = df.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
    )
    moments = filled.select(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    ).scalar()
    centred = filled.withColumn("_s", moments)
    scaled = [
        F.coalesce(F.try_divide(F.col(c) - F.col("_s")[f"m_{c}"], F.col("_s")[f"s_{c}"]), F.lit(0.0)).alias(prefix + c)
        for c in columns
    ]
    return centred.select(*filled.columns, *scaled)


def scaled_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=["z_" + c for c in columns], outputCol="features")
    return assembler.transform(standardise(df, columns))


def best_kmeans(vectors: DataFrame, ks: list[int], starts: int = 10, seed: int = 42) -> dict[int, lloyd.Clustering]:
    """For each k the lowest-cost clustering of several starts; all of them move in the same passes.

    Centres count as settled once none moves by more than 0.01 deviations.
    """
    jobs = [(k, start) for k in ks for start in range(starts)]
    blocks = lloyd.packed(vectors).persist()
    try:
        models = lloyd.fits(blocks, jobs, seed, moves=300, tol=0.01)
    finally:
        blocks.unpersist()
    best = {}
    for (k, start), model in zip(jobs, models):
        rank = (model.summary.trainingCost, start)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, model)
    return {k: model for k, (_, model) in best.items()}


def elbow(vectors: DataFrame, ks: range = range(2, 8), starts: int = 10) -> DataFrame:
    """Within-cluster cost for each k."""
    models = best_kmeans(vectors, list(ks), starts)
    costs = [(k, round(float(model.summary.trainingCost), 2)) for k, model in models.items()]
    return vectors.sparkSession.createDataFrame(costs, "k int, inertia double")


def cluster(vectors: DataFrame, k: int = 4, starts: int = 10) -> DataFrame:
    model = best_kmeans(vectors, [k], starts)[k]
    return model.transform(vectors).withColumnRenamed("prediction", "segment_id")


# --- encoding, splits, forests --------------------------------------------

def encoder(numbers: list[str], names: list[str]) -> Pipeline:
    """One-hot with one extra column for unseen or missing names."""
    indexed, hot = [f"{c}_ix" for c in names], [f"{c}_hot" for c in names]
    return Pipeline(stages=[
        StringIndexer(inputCols=names, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, *hot], outputCol="features", handleInvalid="keep"),
    ])


def split_rows(df: DataFrame, key: str, stratify: str | None = None, test_share: float = 0.3) -> DataFrame:
    """Adds is_test: the first ceil(share * n) rows of each class in hash order."""
    order = surrogate_key(F.col(key).cast("string"))
    cls = F.col(stratify) if stratify else F.lit(0)
    keyed = df.withColumn("_class", cls).withColumn("_hash", order)
    numbered = ranking.row_numbers(keyed, ["_class", "_hash", key], "_place")
    # One row per class of the target.
    classes = numbered.groupBy("_class").agg(F.min("_place").alias("_first"), _rows().alias("_n"))
    is_test = (F.col("_place") - F.col("_first")) < F.ceil(F.col("_n") * F.lit(test_share))
    return numbered.join(F.broadcast(classes), "_class").withColumn("is_test", is_test.cast("int")).drop(
        "_class", "_hash", "_place", "_first", "_n"
    )


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight rows / (classes * rows of the class)."""
    # One row per class of the target.
    counts = F.broadcast(df.groupBy(label).agg(_rows().alias("_n")))
    total = df.select(_rows()).scalar()
    classes = df.select(F.countDistinct(label)).scalar()
    return df.join(counts, label).withColumn("weight", ratio(total, classes * F.col("_n"))).drop("_n")


@dataclass
class Fitted:
    model: forest.Forest
    scored: DataFrame  # the test rows with prediction and, for classes, score

    def importances(self, top: int | None = None) -> DataFrame:
        return importances(self.model, self.scored, top)


def _fit(
    rows: DataFrame, key: str, label: str, numbers: list[str], names: list[str], trees: int, depth: int, seed: int, classes: bool
) -> Fitted:
    prepared = rows.na.fill(0, subset=numbers).withColumn("label", F.col(label).cast("double"))
    parted = split_rows(prepared, key, label if classes else None)
    train, test = parted.filter(F.col("is_test") == 0), parted.filter(F.col("is_test") == 1)
    weights = None
    if classes:
        # One row per class of the target.
        found = balanced_weight(train.select("label"), "label").groupBy("label").agg(F.min("weight").alias("weight"))
        weights = {r.label: r.weight for r in found.collect()}
    # The encoder sees every row, as one-hot columns are made before the split.
    encoding = encoder(numbers, names).fit(parted)
    model = forest.fit(train, key, encoding, numbers, names, trees, depth, seed, weights)
    return Fitted(model, score(model, test))


def score(model: forest.Forest, df: DataFrame) -> DataFrame:
    """Prediction, and the probability of class 1 as ``score`` for classifiers."""
    return model.transform(df)


def fit_repeat(rows: DataFrame, trees: int = 200, depth: int = 12, seed: int = 42) -> Fitted:
    return _fit(rows, "customer_unique_id", "repeat_customer_flag", REPEAT_NUMBERS, REPEAT_NAMES, trees, depth, seed, True)


def fit_lifetime_value(rows: DataFrame, trees: int = 200, depth: int = 12, seed: int = 42) -> Fitted:
    return _fit(rows, "customer_unique_id", "total_spent", REPEAT_NUMBERS, REPEAT_NAMES, trees, depth, seed, False)


def fit_delay(rows: DataFrame, trees: int = 200, depth: int = 10, seed: int = 42) -> Fitted:
    return _fit(rows, "order_id", "is_late", DELAY_NUMBERS, DELAY_NAMES, trees, depth, seed, True)


# Balanced subsamples: every tree has its own draw of the rows, and weights that balance the classes of that draw.

def tree_draw(key: str, tree: int) -> Column:
    """How often a row is in a tree's sample: Poisson with mean 1, from a hash of the row's key, so every run agrees."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(tree)), 11) / F.lit(float(1 << 53))
    share, total, out = math.exp(-1), 0.0, F.lit(8)
    cuts = []
    for n in range(8):
        total += share
        cuts.append((total, n))
        share /= n + 1
    for upto, n in reversed(cuts):
        out = F.when(u < upto, F.lit(n)).otherwise(out)
    return out


def draw_totals(rows: DataFrame, key: str, label: str, trees: int) -> dict[int, list[int]]:
    """Of each class, its rows in every tree's draw; all trees in one pass, one row per class of the target."""
    sums = [F.sum(tree_draw(key, j)).alias(f"t{j}") for j in range(trees)]
    return {int(r[label]): [int(r[f"t{j}"]) for j in range(trees)] for r in rows.groupBy(label).agg(*sums).collect()}


def tree_weight(key: str, label: str, tree: int, totals: dict[int, list[int]]) -> Column:
    """The draw, times the rows drawn over classes and rows drawn of the class: both classes weigh the same in every tree."""
    drawn = sum(t[tree] for t in totals.values())
    factor = F.lit(0.0)
    for cls, t in totals.items():
        factor = F.when(F.col(label) == cls, F.lit(drawn / (len(totals) * max(1, t[tree])))).otherwise(factor)
    return tree_draw(key, tree) * factor


@dataclass
class BalancedForest:
    encoding: PipelineModel
    trees: list

    def score(self, df: DataFrame) -> DataFrame:
        """The mean of the trees' probabilities of class 1, and the class of the larger half."""
        out = self.encoding.transform(df)
        names = []
        for j, tree in enumerate(self.trees):
            out = tree.setProbabilityCol(f"_p{j}").setPredictionCol("").setRawPredictionCol("").transform(out)
            names.append(f"_p{j}")
        mean = sum((vector_to_array(c)[1] for c in names), F.lit(0.0)) / F.lit(float(len(names)))
        return out.withColumn("score", mean).withColumn("prediction", (F.col("score") >= 0.5).cast("double")).drop(*names)


def fit_balanced(
    rows: DataFrame, key: str, label: str, numbers: list[str], names: list[str], trees: int = 50, depth: int = 10,
    seed: int = 42, parallel: int = 8,
) -> tuple[BalancedForest, DataFrame]:
    """A forest with balanced subsamples, and its test rows scored. Trees are fitted side by side on one cached table."""
    prepared = rows.na.fill(0, subset=numbers).withColumn("label", F.col(label).cast("double"))
    parted = split_rows(prepared, key, label)
    encoding = encoder(numbers, names).fit(parted)
    train = spread(encoding.transform(parted.filter("is_test = 0")).select(key, "label", "features"), key).persist()

    def fit(j: int):
        weighted = train.withColumn("weight", tree_weight(key, "label", j, totals)).filter("weight > 0")
        tree = RandomForestClassifier(
            numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + j, weightCol="weight"
        )
        return tree.fit(weighted)

    try:
        totals = draw_totals(train, key, "label", trees)
        with ThreadPoolExecutor(parallel) as pool:
            fitted = list(pool.map(fit, range(trees)))
    finally:
        train.unpersist()
    balanced = BalancedForest(encoding, fitted)
    return balanced, balanced.score(parted.filter("is_test = 1"))


def importances(model: forest.Forest, transformed: DataFrame, top: int | None = None) -> DataFrame:
    """Feature names from the vector column's metadata with their importance."""
    attributes = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    weights = model.featureImportances
    ranked = sorted(
        ((names[i], round(float(weights[i]), 6)) for i in range(weights.size)), key=lambda p: (-p[1], p[0])
    )
    return transformed.sparkSession.createDataFrame(ranked[:top], "name string, value double")


# --- metrics ---------------------------------------------------------------

def auc(scored: DataFrame, label: str, value: str) -> DataFrame:
    """Rank-sum area under the ROC curve; equal scores count one half."""
    by_score = scored.groupBy(F.col(value).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.sum(1 - F.col(label).cast("bigint")).alias("_neg")
    )
    ranked = ranking.running_totals(by_score, ["_s"], {"_upto": "_neg"})
    pos = F.col("_pos").cast("decimal(18,0)")
    twice = F.sum(pos * (F.col("_upto") * 2 - F.col("_neg")).cast("decimal(18,0)"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.agg(rounded(F.try_divide(twice.cast("double") / F.lit(2.0), pairs), 6).alias("auc"))


def classification_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, macro, weighted, and accuracy."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    cells = scored.groupBy(y.alias("y"), p.alias("p")).agg(_rows().alias("n"))
    n = F.col("n")
    classes = cells.select("n", "y", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).groupBy("c").agg(
        F.sum(F.when((F.col("y") == F.col("c")) & (F.col("p") == F.col("c")), n).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("p") == F.col("c"), n).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("y") == F.col("c"), n).otherwise(0)).alias("support"),
    )
    zero = F.lit(0.0)
    per_class = classes.select(
        F.col("c").cast("string").alias("class"),
        F.coalesce(ratio(F.col("hit"), F.col("said")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hit"), F.col("support")), zero).alias("recall"),
        F.coalesce(ratio(F.col("hit") * 2, F.col("said") + F.col("support")), zero).alias("f1"),
        "support", "hit",
    )
    metrics = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in metrics], total.alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in metrics], total.alias("support")
    ).withColumn("class", F.lit("weighted avg"))
    right = ratio(F.sum("hit"), total)
    accuracy = per_class.agg(*[right.alias(m) for m in metrics], total.alias("support")).withColumn("class", F.lit("accuracy"))
    out = per_class.drop("hit").unionByName(macro).unionByName(weighted).unionByName(accuracy)
    return out.select("class", *[rounded(F.col(m), 6).alias(m) for m in metrics], "support")


def regression_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean absolute error and R2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mean = scored.select(F.avg(y)).scalar()
    rows = scored.withColumn("_m", mean)
    sse, sst = F.sum(F.pow(y - p, 2)), F.sum(F.pow(y - F.col("_m"), 2))
    return rows.agg(
        rounded(F.avg(F.abs(y - p)), 4).alias("mae"), rounded(F.lit(1.0) - F.try_divide(sse, sst), 6).alias("r2"),
        _rows().alias("rows"),
    )


def classifier_summary(fitted: Fitted, label: str, top: int = 25) -> DataFrame:
    """Test metrics and leading importances of one classifier as name, value rows."""
    scored = cut(fitted.scored.select(label, "prediction", "score"))
    report = classification_report(scored, label, "prediction")
    flat = report.select(F.explode(F.array(*[
        F.struct(F.concat("class", F.lit(f" {m}")).alias("name"), F.col(m).cast("double").alias("value"))
        for m in ("precision", "recall", "f1", "support")
    ])).alias("x")).select("x.*")
    area = auc(scored, label, "score").select(F.lit("auc").alias("name"), F.col("auc").alias("value"))
    weights = fitted.importances(top).select(F.concat(F.lit("importance "), "name").alias("name"), "value")
    return area.unionByName(flat).unionByName(weights)


def regressor_summary(fitted: Fitted, label: str, top: int = 25) -> DataFrame:
    report = regression_report(cut(fitted.scored.select(label, "prediction")), label, "prediction")
    flat = report.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in ("mae", "r2", "rows")
    ])).alias("x")).select("x.*")
    weights = fitted.importances(top).select(F.concat(F.lit("importance "), "name").alias("name"), "value")
    return flat.unionByName(weights)


# --- use of the scores ------------------------------------------------------

def low_propensity_audience(model: forest.Forest, people: DataFrame, below: float = 0.15) -> DataFrame:
    """Customers whose score of buying again lies under the threshold."""
    return score(model, people).filter(F.col("score") < below).select("customer_unique_id", "score")


def assign_arms(people: DataFrame, key: str) -> DataFrame:
    """Two arms of equal size by hash order; the first half is the control."""
    order = surrogate_key(F.col(key).cast("string"))
    numbered = ranking.row_numbers(people.withColumn("_hash", order), ["_hash", key], "_place")
    half = F.floor(people.select(_rows()).scalar() / 2)
    arm = F.when(F.col("_place") <= half, "control").otherwise("treatment")
    return numbered.withColumn("arm", arm).drop("_hash", "_place")


def campaign_report(
    outcomes: DataFrame, score: str, repeated: str, spend: str, threshold: float = 0.15, coupon: float = 15.0
) -> DataFrame:
    """Observed campaign outcome per arm, incremental orders, cost and return.

    ``outcomes`` has one row per customer with its arm. Treated customers at or
    under the threshold were offered the coupon; it costs money only when they
    bought again.
    """
    treated, control = F.col("arm") == "treatment", F.col("arm") == "control"
    again, offered = F.col(repeated) == 1, treated & (F.col(score) <= threshold)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    sums = outcomes.agg(
        count(control).alias("control_size"),
        count(control & again).alias("control_repeats"),
        count(treated).alias("treatment_size"),
        count(treated & again).alias("treatment_repeats"),
        count(offered).alias("targeted_customers"),
        count(offered & again).alias("redeemed_coupons"),
        ratio(F.sum(F.col(spend).cast("decimal(28,2)")), _rows()).alias("_spend"),
    )
    extra = F.greatest(F.lit(0), F.col("treatment_repeats") - F.col("control_repeats"))
    cost = F.col("redeemed_coupons") * F.lit(coupon)
    revenue = extra * F.col("_spend")
    return sums.select(
        "control_size", "control_repeats",
        rounded(ratio(F.col("control_repeats"), F.col("control_size")) * 100.0).alias("control_repeat_rate_pct"),
        "treatment_size", "treatment_repeats",
        rounded(ratio(F.col("treatment_repeats"), F.col("treatment_size")) * 100.0).alias("treatment_repeat_rate_pct"),
        extra.alias("incremental_repeat_purchases"), "targeted_customers", "redeemed_coupons",
        rounded(cost).alias("total_campaign_cost"),
        rounded(revenue).alias("incremental_revenue"),
        rounded(revenue - cost).alias("net_profit"),
        rounded(F.coalesce(F.try_divide(revenue - cost, cost) * 100.0, F.lit(0.0))).alias("roi_pct"),
    )
