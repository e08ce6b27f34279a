"""Model questions on the marketplace features."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.functions import numbers
from soukline.functions.numbers import rounded
from soukline.operators import learning
from soukline.plans import lifecycle
from soukline.session import cut
from soukline.sources.tables import Tables


def standardised_features(t: Tables) -> DataFrame:
    people = lifecycle.customer_features(t).select("customer_unique_id", *learning.SEGMENT_COLUMNS)
    scaled = learning.standardise(people, learning.SEGMENT_COLUMNS)
    return scaled.select(
        "customer_unique_id", *[rounded(F.col(f"z_{c}"), 6).alias(f"z_{c}") for c in learning.SEGMENT_COLUMNS]
    )


def _vectors(t: Tables) -> DataFrame:
    return learning.scaled_vectors(lifecycle.customer_features(t), learning.SEGMENT_COLUMNS)


def kmeans_elbow(t: Tables) -> DataFrame:
    return learning.elbow(_vectors(t))


def customer_segments(t: Tables) -> DataFrame:
    """Cluster of each customer, and the name its profile earns."""
    clustered = cut(learning.cluster(_vectors(t)).drop("features"))
    names = lifecycle.segment_profiles(clustered, "segment_id").select("segment_id", "segment_name")
    # One name per cluster.
    return clustered.join(F.broadcast(names), "segment_id").select(
        "customer_unique_id", "segment_id", "segment_name", *learning.SEGMENT_COLUMNS
    )


def kmeans_profiles(t: Tables) -> DataFrame:
    return lifecycle.segment_profiles(learning.cluster(_vectors(t)).drop("features"), "segment_id")


def kmeans_check(t: Tables, k: int = 4) -> DataFrame:
    """Of a fitted clustering: its customers, its clusters, and the customers nearer to another centre than to their own."""
    vectors = cut(_vectors(t).select("customer_unique_id", "features"))
    model = learning.best_kmeans(vectors, [k])[k]
    placed = model.transform(vectors).withColumn("x", vector_to_array("features"))
    gaps = F.array(*[
        F.aggregate(
            F.zip_with("x", F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
        )
        for centre in model.clusterCenters()
    ])
    own = F.element_at(gaps, F.col("prediction") + 1)
    return placed.agg(
        F.count(F.lit(1)).alias("customers"), F.countDistinct("prediction").alias("clusters"),
        F.count_if(own > F.array_min(gaps) + 1e-9).alias("misplaced"),
    )


def _squares(columns: list[str]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.col(c) * F.col(c)
    return out


def elbow_check(t: Tables, starts: int = 2) -> DataFrame:
    """For each k the customers, the sum of squares inside and between the clusters, and whether the cost reported is that inside.

    Inside is recomputed from the stored assignment: squares about each cluster's own mean. Inside and between add up to
    the squares of the scaled features, whatever the fit, only if every customer is assigned once. ``falls`` tells that more
    clusters never cost more.
    """
    scaled = ["z_" + c for c in learning.SEGMENT_COLUMNS]
    vectors = cut(_vectors(t).select("customer_unique_id", "features", *scaled))
    models = learning.best_kmeans(vectors, list(range(2, 8)), starts)
    rows, before = None, None
    for k, model in models.items():
        placed = cut(model.transform(vectors))
        per = placed.groupBy("prediction").agg(
            F.count(F.lit(1)).alias("n"), F.sum(_squares(scaled)).alias("all"), *[F.avg(c).alias(c) for c in scaled]
        )
        cost = float(model.summary.trainingCost)
        inside = F.sum(F.col("all") - F.col("n") * _squares(scaled))
        told = per.agg(F.sum("n").alias("customers"), inside.alias("inside"), F.sum(F.col("n") * _squares(scaled)).alias("between")).select(
            F.lit(k).alias("k"), "customers", rounded(F.col("inside") + F.col("between"), 3).alias("squares"),
            # centres settle within a tolerance of the means
            (F.abs(F.col("inside") - cost) <= 0.01 * F.lit(cost) + 1e-6).alias("cost_is_inside"),
            F.lit(before is None or cost <= before * 1.02).alias("falls"),
        )
        before = cost
        rows = told if rows is None else rows.unionByName(told)
    return rows


def forest_check(t: Tables) -> DataFrame:
    """Of the delay model: tested rows and late ones among them, scores outside 0 to 1 and the sum of importances.

    And whether the area under the curve and the accuracy that are reported are those that follow from the stored scores.
    """
    fitted = learning.fit_delay(lifecycle.delivery_risk_features(t))
    weight = fitted.importances().agg(rounded(F.sum("value"), 3)).scalar()
    scored = cut(fitted.scored.select("label", "score", "prediction"))
    area = learning.auc(scored, "label", "score").first().auc
    evaluated = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scored)
    report = {r["class"]: r.recall for r in learning.classification_report(scored, "label", "prediction").collect()}
    hits = F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))
    outside = F.count_if((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull())
    return scored.agg(
        F.count(F.lit(1)).alias("tested"), F.sum("label").cast("bigint").alias("late"), outside.alias("outside"),
        (F.abs(hits - report["accuracy"]) < 1e-5).alias("accuracy_agrees"),
        # forests vote for the class whose score is one half or more
        (F.count_if((F.col("score") > 0.5 + 1e-9) != (F.col("prediction") == 1)) <= F.count_if(F.abs(F.col("score") - 0.5) < 1e-9)).alias("votes_agree"),
    ).withColumn("importance", weight).withColumn("area_agrees", F.lit(area is not None and abs(area - evaluated) < 1e-4))


def lifetime_value_check(t: Tables) -> DataFrame:
    """Of the lifetime value model: tested rows, their mean value, whether error and R2 follow from the stored predictions.

    ``inside`` tells that no prediction leaves the range of the values, as means of leaves cannot.
    """
    rows = cut(lifecycle.repeat_features(t))
    fitted = learning.fit_lifetime_value(rows, trees=50)
    scored = cut(fitted.scored.select("label", "prediction"))
    told = learning.regression_report(scored, "label", "prediction").first()
    spread = F.var_pop("label") * F.count(F.lit(1))
    left = F.sum((F.col("label") - F.col("prediction")) * (F.col("label") - F.col("prediction")))
    span = rows.agg(F.min("total_spent").alias("lo"), F.max("total_spent").alias("hi")).first()
    return scored.agg(
        F.count(F.lit(1)).alias("tested"), rounded(F.avg("label"), 4).alias("mean_value"),
        (F.abs(F.avg(F.abs(F.col("label") - F.col("prediction"))) - told.mae) < 1e-3).alias("error_agrees"),
        (F.abs(F.lit(1.0) - left / spread - told.r2) < 1e-4).alias("r2_agrees"),
        F.count_if(~F.col("prediction").between(span.lo - 1e-6, span.hi + 1e-6)).alias("outside"),
    )


def _propensity(t: Tables, trees: int = 200) -> tuple[DataFrame, DataFrame]:
    """The customers with their features, and each one's score of buying again."""
    rows = cut(lifecycle.repeat_features(t))
    fitted = learning.fit_repeat(rows, trees)
    scores = learning.score(fitted.model, rows.na.fill(0, subset=learning.REPEAT_NUMBERS))
    return rows, cut(scores.select("customer_unique_id", "score"))


def audience_check(t: Tables) -> DataFrame:
    """Customers scored, members of the audience twice or that are no customers, and members on the wrong side of the threshold.

    ``parted`` tells that audience and the others together are all customers.
    """
    rows, scores = _propensity(t, 50)
    members = cut(scores.filter(F.col("score") < 0.15))
    others = scores.filter(F.col("score") >= 0.15).select(F.count(F.lit(1))).scalar()
    people = rows.select("customer_unique_id")
    counted = members.agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("customer_unique_id").alias("different"),
        F.count_if(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") >= 0.15)).alias("misplaced"),
    )
    customers = people.select(F.count(F.lit(1))).scalar()
    return counted.select(
        customers.alias("customers"), (F.col("members") + others == customers).alias("parted"),
        (F.col("members") - F.col("different")).alias("repeated"), "misplaced",
        members.join(people, "customer_unique_id", "left_anti").select(F.count(F.lit(1))).scalar().alias("strangers"),
    )


def encoded_features(t: Tables) -> DataFrame:
    rows = lifecycle.repeat_features(t).na.fill(0, subset=learning.REPEAT_NUMBERS)
    encoded = learning.encoder(learning.REPEAT_NUMBERS, learning.REPEAT_NAMES).fit(rows).transform(rows)
    return encoded.select("customer_unique_id", vector_to_array("features").alias("features"))


def stratified_split(t: Tables) -> DataFrame:
    rows = lifecycle.delivery_risk_features(t).select("order_id", "is_late")
    return learning.split_rows(rows, "order_id", "is_late")


def plain_split(t: Tables) -> DataFrame:
    rows = lifecycle.repeat_features(t).select("customer_unique_id")
    return learning.split_rows(rows, "customer_unique_id")


def repeat_model(t: Tables) -> DataFrame:
    return learning.classifier_summary(learning.fit_repeat(lifecycle.repeat_features(t)), "label")


def lifetime_value_model(t: Tables) -> DataFrame:
    return learning.regressor_summary(learning.fit_lifetime_value(lifecycle.repeat_features(t)), "label")


def delay_model(t: Tables) -> DataFrame:
    return learning.classifier_summary(learning.fit_delay(lifecycle.delivery_risk_features(t)), "label")


def value_as_late_score_auc(t: Tables) -> DataFrame:
    """How well order value alone orders late deliveries."""
    return learning.auc(lifecycle.delivery_risk_features(t), "is_late", "order_total_value")


def first_late_as_repeat_report(t: Tables) -> DataFrame:
    """The first order's late flag taken as a prediction of a repeat purchase."""
    return learning.classification_report(lifecycle.repeat_features(t), "repeat_customer_flag", "first_late_flag")


def first_value_as_clv_report(t: Tables) -> DataFrame:
    """The first order's value taken as a prediction of lifetime value."""
    return learning.regression_report(lifecycle.repeat_features(t), "total_spent", "first_order_value")


def propensity_audience(t: Tables) -> DataFrame:
    rows = cut(lifecycle.repeat_features(t))
    fitted = learning.fit_repeat(rows)
    return learning.low_propensity_audience(fitted.model, rows.na.fill(0, subset=learning.REPEAT_NUMBERS))


def campaign(t: Tables) -> DataFrame:
    """Arms by hash; the share of late deliveries stands for the score."""
    people = lifecycle.customer_features(t).select(
        "customer_unique_id", F.col("late_delivery_rate").alias("score"), "repeat_customer_flag",
        numbers.money(F.col("total_spent")).alias("total_spent"),
    )
    return learning.campaign_report(
        learning.assign_arms(people, "customer_unique_id"), "score", "repeat_customer_flag", "total_spent"
    )


def _scored_campaign(t: Tables, trees: int) -> tuple[DataFrame, DataFrame]:
    rows, scores = _propensity(t, trees)
    people = rows.select("customer_unique_id", "repeat_customer_flag", numbers.money(F.col("total_spent")).alias("total_spent"))
    outcomes = cut(learning.assign_arms(people.join(scores, "customer_unique_id"), "customer_unique_id"))
    return outcomes, learning.campaign_report(outcomes, "score", "repeat_customer_flag", "total_spent")


def scored_campaign(t: Tables) -> DataFrame:
    """The campaign by the repeat model's score: treated customers that are unlikely to buy again are offered the coupon."""
    return _scored_campaign(t, 200)[1]


def scored_campaign_check(t: Tables) -> DataFrame:
    """Arms and repeats, which hold for any model, and whether offers, costs and profit follow from the stored scores."""
    outcomes, report = _scored_campaign(t, 50)
    offered = (F.col("arm") == "treatment") & (F.col("score") <= 0.15)
    again = outcomes.agg(
        F.count_if(offered).alias("o"), F.count_if(offered & (F.col("repeat_customer_flag") == 1)).alias("r"),
        F.avg(F.col("total_spent").cast("double")).alias("m"),
    ).select(F.struct("o", "r", "m")).scalar()
    x = F.col("x")
    return report.withColumn("x", again).select(
        "control_size", "control_repeats", "treatment_size", "treatment_repeats", "incremental_repeat_purchases", "incremental_revenue",
        ((F.col("targeted_customers") == x["o"]) & (F.col("redeemed_coupons") == x["r"])).alias("offers_follow"),
        (F.abs(F.col("total_campaign_cost") - 15.0 * x["r"]) < 0.01).alias("cost_follows"),
        (F.abs(F.col("net_profit") - F.col("incremental_repeat_purchases") * x["m"] + 15.0 * x["r"]) < 0.02).alias("profit_follows"),
    )


def balanced_delay_check(t: Tables, trees: int = 12) -> DataFrame:
    """Of the delay model with balanced subsamples: tested rows, late ones, trees whose classes weigh the same, draws that differ.

    ``ranks`` tells that the scores order late orders no worse than chance.
    """
    rows = cut(lifecycle.delivery_risk_features(t))
    _, scored = learning.fit_balanced(rows, "order_id", "is_late", learning.DELAY_NUMBERS, learning.DELAY_NAMES, trees, 8)
    scored = cut(scored.select("label", "score"))
    train = learning.split_rows(rows.select("order_id", "is_late"), "order_id", "is_late").filter("is_test = 0")
    totals = learning.draw_totals(train, "order_id", "is_late", trees)
    weights = [
        (F.sum(F.when(F.col("is_late") == 1, w)) / F.sum(F.when(F.col("is_late") == 0, w))).alias(f"w{j}")
        for j in range(trees) for w in [learning.tree_weight("order_id", "is_late", j, totals)]
    ]
    even = train.agg(*weights).select(F.size(F.filter(F.array(*[f"w{j}" for j in range(trees)]), lambda w: F.abs(w - 1) < 1e-9))).scalar()
    area = learning.auc(scored, "label", "score").first().auc
    return scored.agg(
        F.count(F.lit(1)).alias("tested"), F.sum("label").cast("bigint").alias("late"),
        F.count_if(~F.col("score").between(0, 1)).alias("outside"),
    ).withColumn("even_trees", even).withColumn("draws", F.lit(len({tuple(t[j] for t in totals.values()) for j in range(trees)}) > 1)).withColumn(
        "ranks", F.lit(area is not None and area >= 0.45)
    )
