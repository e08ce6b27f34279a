"""Every named query: a function of the base tables. Names start with the
operator's identifier in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soukline.operators import cleaning, marts, measures, quality, rollups, star, summaries
from soukline.plans import explore, growth, lifecycle, live, modelling, storage, trading
from soukline.sources.tables import Tables

Query = Callable[[Tables], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Money leaves the engine as DOUBLE."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


CLEANING: dict[str, Query] = {
    "m1_clean_customers": lambda t: cleaning.clean_customers(t.customers),
    "m2_clean_orders": lambda t: cleaning.clean_orders(t.orders),
    "m3_enrich_orders": lambda t: cleaning.enrich_orders(t.orders),
    "m4_clean_items": lambda t: cleaning.clean_items(t.items),
    "m5_clean_products": lambda t: cleaning.clean_products(t.products, t.translation),
    "m6_clean_reviews": lambda t: cleaning.clean_reviews(t.reviews),
    "m7_clean_geolocation": lambda t: cleaning.clean_geolocation(t.geolocation),
    "m8_clean_sellers": lambda t: cleaning.clean_sellers(t.sellers),
    "m9_clean_payments": lambda t: cleaning.clean_payments(t.payments),
    "m14_cleaning_audit": lambda t: cleaning.cleaning_audit(t, marts.customer_lifecycle(t)),
}

MARTS: dict[str, Query] = {
    "m10_order_fact": marts.order_fact,
    "m10_order_fact_one_row_per_item": lambda t: marts.order_fact(t, per_review=False),
    "m11_order_totals": rollups.order_totals,
    "m12_customer_summary": marts.customer_summary,
    "m12_customer_summary_per_person": lambda t: marts.customer_summary(t, per_address=False, per_review=False),
    "m13_customer_lifecycle": marts.customer_lifecycle,
    "m20_rfm_features": marts.rfm_features,
    "m20_rfm_features_higher_is_better": lambda t: marts.rfm_features(t, higher_is_better=True),
    "m21_rfm_segments": lambda t: marts.rfm_segments(marts.rfm_features(t)),
    "m22_cohort_features": marts.cohort_features,
    "m23_delivery_features": marts.delivery_features,
    "m24_churn_features": marts.churn_features,
    "m25_payment_features": lambda t: marts.payment_features(t.payments),
    "m26_kpi_snapshot": marts.kpi_snapshot,
    "m27_monthly_revenue": marts.monthly_revenue,
    "m28_cohort_retention": marts.cohort_retention,
    "d1_staged_items": lambda t: star.staged_items(t.items),
    "d2_dim_customer": star.dim_customer,
    "d2_dim_customer_one_row_per_person": lambda t: star.dim_customer(t, one_row_per_person=True),
    "d3_dim_product": star.dim_product,
    "d4_dim_seller": star.dim_seller,
    "d5_dim_date": star.dim_date_of,
    "d6_fact_sales": star.fact_sales,
    "d7_mart_customer_segmentation": lambda t: storage.stored_mart(marts.rfm_segments(marts.rfm_features(t))),
    "d7_mart_monthly_revenue": lambda t: storage.stored_mart(marts.monthly_revenue(t)),
}

QUESTIONS: dict[str, Query] = {
    "q1_monthly_gmv": trading.monthly_gmv,
    "q2_repeat_share": trading.repeat_share,
    "q3_revenue_by_state": trading.revenue_by_state,
    "q4_top_categories": trading.top_categories,
    "q5_on_time_by_state": trading.on_time_by_state,
    "q5_on_time_by_state_each_delivery_once": lambda t: trading.on_time_by_state(t, per_address_row=False),
    "q6_reviews_by_lateness": trading.reviews_by_lateness,
    "q7_rfm_distribution": trading.rfm_distribution,
    "q8_cohort_matrix": trading.cohort_matrix_long,
    "q9_clv_by_state": trading.clv_by_state,
    "q9_clv_by_state_from_50_customers": lambda t: trading.clv_by_state(t, min_customers=50),
    "q10_payment_mix": trading.payment_mix,
    "q11_top_sellers": trading.top_sellers,
    "q11_top_sellers_value_once": lambda t: trading.top_sellers(t, per_review=False),
    "q12_cancellations": trading.cancellations_by_month,
    "q13_churn_by_segment": trading.churn_by_segment,
    "q14_freight_share": trading.freight_share_by_category,
    "q15_days_to_review": trading.days_to_review,
    "q16_weekday": trading.orders_by_weekday,
    "q17_basket_size": trading.basket_size_mix,
    "q18_customers_by_month_state": trading.customers_by_month_and_state,
    "q18_first_time_customers_by_month_state": lambda t: trading.customers_by_month_and_state(t, first_order_only=True),
    "q19_cumulative_gmv": trading.cumulative_gmv,
    "q20_top_sellers_per_state": trading.top_sellers_per_state,
    "q21_delivery_by_month": trading.delivery_by_month,
    "q22_detractors_by_category": trading.detractors_by_category,
    "q23_value_by_installments": trading.value_by_installments,
    "q24_order_frequency": trading.order_frequency,
    "q25_yearly_gmv": trading.yearly_gmv,
    "r1_monthly_growth": growth.monthly_growth,
    "r2_category_month_value": growth.category_month_value,
    "r3_category_concentration": growth.category_concentration,
    "r4_first_time_vs_repeat": growth.first_time_vs_repeat,
    "r5_second_purchase": growth.second_purchase,
    "r6_cohort_curves": growth.cohort_curves,
    "r7_rfm_value_segments": growth.rfm_value_segments,
    "r8_churn_funnel": growth.churn_funnel,
    "r9_on_time_by_month": growth.on_time_by_month,
    "r10_review_impact": growth.review_impact,
    "r11_late_by_state": growth.late_by_state,
    "r12_category_demand": growth.category_demand,
    "r13_state_demand": growth.state_demand,
    "r14_seller_concentration": growth.seller_concentration,
    "r15_seller_scorecard": growth.seller_scorecard,
}

ANALYTICS: dict[str, Query] = {
    "e1_headline_metrics": explore.headline_metrics,
    "e2_top_states": explore.top_states,
    "e3_payment_shares": explore.payment_shares,
    "e4_monthly_series": explore.monthly_series,
    "e5_state_revenue": explore.state_revenue,
    "e6_review_scores": explore.review_score_distribution,
    "e7_top_seller_revenue": explore.top_seller_revenue,
    "e8_top_category_revenue": explore.top_category_revenue,
    "e9_cohort_matrix_12x8": lambda t: explore.cohort_wide(t, periods=8, cohorts=12),
    "e10_recency_segments": explore.recency_segments,
    "e11_late_and_repeat": explore.late_and_repeat_rates,
    "g1_review_by_order": lifecycle.review_by_order,
    "g1_customer_reviews": lifecycle.customer_reviews,
    "g2_segment_profiles": lifecycle.recency_band_profiles,
    "g3_cohort_matrix": explore.cohort_wide,
    "g3_cohort_averages": lifecycle.cohort_averages,
    "g4_clv_table": lifecycle.clv_table,
    "g5_category_pairs": lifecycle.category_pairs,
    "g6_geo_summary": lifecycle.geo_summary,
    "g7_seller_summary": lifecycle.seller_summary,
    "g7_seller_summary_value_once": lambda t: lifecycle.seller_summary(t, per_review=False),
    "g8_product_summary": lifecycle.product_summary,
    "g9_delivery_summary": lifecycle.delivery_summary,
    "g10_first_orders": lifecycle.first_orders,
    "g11_repeat_features": lifecycle.repeat_features,
    "g12_delivery_risk_features": lifecycle.delivery_risk_features,
    "g13_phase_summary": lifecycle.phase_summary,
    "g13_phase_lists": lifecycle.phase_lists,
    "g14_peak_month": lifecycle.peak_month,
    "g15_top_decile_customers": lifecycle.top_decile_customers,
    "g16_preferred_sellers": lifecycle.preferred_sellers,
    "g17_winback_audience": lifecycle.winback_audience,
}



def _measure(measure, *by: str, slicer: measures.Slicer = measures.Slicer()) -> Query:
    return lambda t: measure(measures.Context(t, slicer), list(by))


def _sliced_report(t: Tables) -> DataFrame:
    """All six report filters at once."""
    inactive = F.when(F.col("recency_days") > 180, "inactive").otherwise("active")
    segment_of = marts.customer_lifecycle(t).select("customer_unique_id", inactive.alias("segment"))
    slicer = measures.Slicer(
        first_day="1996-01-01", last_day="2000-12-31",
        states=("NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8"),
        statuses=("delivered", "shipped"),
        categories=("type_small", "type_large", "unknown"),
        seller_states=tuple(f"NATION_{k}" for k in range(1, 25)),
        segments=("inactive",),
    )
    return measures.sliced_report(measures.Context(t, slicer, segment_of), ["purchase_month"])


# Filters of the report pages, one family each: dates, customer states, status with category and seller state.
DATES = measures.Slicer(first_day="1996-01-01", last_day="1998-06-30")
STATES = measures.Slicer(states=("NATION_1", "NATION_2", "NATION_3"))
SHELF = measures.Slicer(statuses=("delivered",), categories=("type_small", "unknown"), seller_states=("NATION_4", "NATION_5", "NATION_6"))


MEASURES: dict[str, Query] = {
    "b1_gmv_by_state": _measure(measures.gmv, "customer_state"),
    "b1_gmv_of_all_items_by_status": _measure(measures.gmv_of_items, "order_status"),
    "b2_b5_orders_and_success": _measure(measures.order_success, "purchase_month"),
    "b3_aov_by_category": _measure(measures.average_order_value, "category_english"),
    "b4_median_order_value_by_state": _measure(measures.median_order_value, "customer_state"),
    "b6_unique_customers_by_category": _measure(measures.unique_customers, "category_english"),
    "b7_repeat_rate_by_month": _measure(measures.repeat_rate, "purchase_month"),
    "b8_clv_by_state": _measure(measures.lifetime_value, "state"),
    "b9_on_time_rate_by_state": _measure(measures.on_time_rate, "customer_state"),
    "b9_sla_rate_of_all_orders": _measure(measures.sla_rate_of_all_orders, "order_status"),
    "b10_service_averages_by_state": _measure(measures.service_averages, "customer_state"),
    "b11_leading_seller_share": lambda t: measures.leading_seller_share(measures.Context(t)),
    "b12_category_share": lambda t: measures.category_share(
        measures.Context(t, measures.Slicer(categories=("type_small", "type_large")))
    ),
    "b13_cohort_retention": lambda t: measures.cohort_retention_share(measures.Context(t)),
    "b8_clv_by_state_in_dates": lambda t: measures.lifetime_value(measures.Context(t, DATES), ["state"]),
    "b13_cohort_retention_in_states": lambda t: measures.cohort_retention_share(measures.Context(t, STATES)),
    "b13_cohort_retention_in_dates": lambda t: measures.cohort_retention_share(measures.Context(t, DATES)),
    "b16_price_bands_on_shelf": lambda t: measures.price_bands(measures.Context(t, SHELF)),
    "b14_kpi_status": lambda t: measures.kpi_status(measures.Context(t)),
    "b15_detractor_relative_risk": lambda t: measures.detractor_relative_risk(measures.Context(t)),
    "b16_price_bands": lambda t: measures.price_bands(measures.Context(t)),
    "b16_basket_by_month": _measure(measures.basket_measures, "purchase_month"),
    "p17_sliced_report": _sliced_report,
}

QUALITY: dict[str, Query] = {
    "z1_profile_tables": quality.profile_tables,
    "z2_profile_columns": quality.profile_all_columns,
    "z3_orphan_counts": quality.orphan_counts,
    "z4_duplicates": quality.duplicate_report,
    "z5_missing_values": quality.missing_values,
    "z6_date_quarantine": quality.date_quarantine,
    "z7_order_outliers": quality.order_outliers,
    "z8_schema_tests": quality.schema_tests,
    "z9_freshness": quality.order_freshness,
}

STORAGE: dict[str, Query] = {
    "s1_csv_scan": storage.csv_scan,
    "s2_stage_rescan": storage.stage_rescan,
    "s2_lifecycle_from_stage": storage.lifecycle_from_stage,
    "s3_output_manifest": storage.output_manifest,
    "s4_metrics_document": storage.metrics_document,
    "s5_star_tables": storage.star_tables,
    "s6_named_views": storage.named_views,
    "s6_mart_views": storage.mart_views,
    "s5_bucketed_sales": storage.bucketed_sales,
    "s8_refreshed_months": storage.refreshed_months,
    "z8_checked_write": storage.checked_write,
    "a2_customers_by_state_check": lambda t: summaries.distinct_check(t, summaries.order_cells(t), ["customer_state"]),
    "a2_customers_by_month_check": lambda t: summaries.distinct_check(t, summaries.order_cells(t), ["purchase_month"]),
    "p12_order_value_check": lambda t: summaries.quantile_check(t, summaries.order_cells(t), ["customer_state"]),
    "a2_summaries_beside_exact": lambda t: summaries.exact_and_estimated(t, summaries.order_cells(t), ["customer_state"]),
    "a1_place_rollup": summaries.place_rollup,
    "a1_calendar_rollup": summaries.calendar_rollup,
    "s8_monthly_refresh": storage.monthly_refresh,
    "s9_daily_landing": lambda t: storage.daily_landing(t.scan("events")),
}

MODELS: dict[str, Query] = {
    "k1_standardised_features": modelling.standardised_features,
    "k2_kmeans_elbow": modelling.kmeans_elbow,
    "k3_customer_segments": modelling.customer_segments,
    "k3_kmeans_profiles": modelling.kmeans_profiles,
    "k2_elbow_check": modelling.elbow_check,
    "k7_lifetime_value_check": modelling.lifetime_value_check,
    "k13_campaign_by_score": modelling.scored_campaign,
    "k13_scored_campaign_check": modelling.scored_campaign_check,
    "k3_kmeans_check": modelling.kmeans_check,
    "k6_balanced_subsample_check": modelling.balanced_delay_check,
    "k6_forest_check": modelling.forest_check,
    "k12_audience_check": modelling.audience_check,
    "k4_encoded_features": modelling.encoded_features,
    "k5_stratified_split": modelling.stratified_split,
    "k5_plain_split": modelling.plain_split,
    "k6_k8_repeat_model": modelling.repeat_model,
    "k6_k8_delay_model": modelling.delay_model,
    "k7_k8_lifetime_value_model": modelling.lifetime_value_model,
    "k9_value_as_late_score_auc": modelling.value_as_late_score_auc,
    "k10_first_late_as_repeat_report": modelling.first_late_as_repeat_report,
    "k11_first_value_as_clv_report": modelling.first_value_as_clv_report,
    "k12_propensity_audience": modelling.propensity_audience,
    "k13_campaign": modelling.campaign,
}

LIVE: dict[str, Query] = {
    "st1_ingested_state": live.ingested_state,
    "st1_deduplicated_events": live.deduplicated_events,
    "st2_overdue_orders": live.overdue_orders,
    "st3_band_changes": live.band_changes,
    "st3_winback_band": live.winback_band,
    "st2_daily_purchases": live.daily_purchases,
    "st2_late_delivery_alerts": live.late_alerts,
    "st2_scored_alerts": live.scored_alerts,
    "st2_scored_alerts_check": live.scored_alerts_check,
    "st3_winback_triggers": live.winback_triggers,
}

QUERIES: dict[str, Query] = {
    **CLEANING, **MARTS, **QUESTIONS, **ANALYTICS, **MEASURES, **QUALITY, **STORAGE, **MODELS, **LIVE,
}
