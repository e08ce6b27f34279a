"""The nine base relations and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.functions.numbers import to_cents

# The times of an order.
ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
FULFILMENT_TIMES = ["order_delivered_carrier_date", "order_delivered_customer_date"]


def _schema(**columns: str) -> str:
    """DDL text, so that importing the module needs no session."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


# Public column names and types of the base tables.
SCHEMAS: dict[str, str] = {
    "customers": _schema(
        customer_id="string", customer_unique_id="string", customer_zip_code_prefix="string",
        customer_city="string", customer_state="string",
    ),
    "orders": _schema(
        order_id="string", customer_id="string", order_status="string",
        **{name: "timestamp_ntz" for name in ORDER_TIMES},
    ),
    "items": _schema(
        order_id="string", order_item_id="int", product_id="string", seller_id="string",
        shipping_limit_date="timestamp_ntz", price="decimal(18,2)", freight_value="decimal(18,2)",
    ),
    "payments": _schema(
        order_id="string", payment_type="string", payment_installments="int",
        payment_value="decimal(18,2)",
    ),
    "reviews": _schema(
        review_id="string", order_id="string", review_score="int", review_comment_title="string",
        review_comment_message="string", review_creation_date="timestamp_ntz",
        review_answer_timestamp="timestamp_ntz",
    ),
    "products": _schema(
        product_id="string", product_category_name="string", product_name_lenght="int",
        product_description_lenght="int", product_photos_qty="int", product_weight_g="int",
        product_length_cm="int", product_height_cm="int", product_width_cm="int",
    ),
    "sellers": _schema(
        seller_id="string", seller_zip_code_prefix="string", seller_city="string",
        seller_state="string",
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix="string", geolocation_lat="double", geolocation_lng="double",
        geolocation_city="string", geolocation_state="string",
    ),
    "translation": _schema(
        product_category_name="string", product_category_name_english="string",
    ),
}


class Tables:
    """Lazy base relations, one attribute per name in ``SCHEMAS``.

    ``headers`` is ``orders`` without the fulfilment times and ``scores`` is
    ``reviews`` without its dates. They only matter where those columns cost a
    join; here they are plain projections.
    """

    def __init__(self, **frames: DataFrame) -> None:
        for name in SCHEMAS:
            setattr(self, name, frames[name])

    @property
    def headers(self) -> DataFrame:
        return self.orders.drop(*FULFILMENT_TIMES)

    @property
    def scores(self) -> DataFrame:
        return self.reviews.drop("review_creation_date", "review_answer_timestamp")

    @property
    def item_cents(self) -> DataFrame:
        """Items with price, freight and their sum in whole cents."""
        price, freight = to_cents(F.col("price")), to_cents(F.col("freight_value"))
        return self.items.select(
            "order_id", "product_id", "seller_id", price.alias("price"), freight.alias("freight_value"),
            (price + freight).alias("total_value"),
        )

    def orders_in(self, status: str) -> DataFrame:
        """Orders of one status; sources with other codes filter their scan."""
        return self.orders.filter(F.col("order_status") == status)

    def headers_in(self, status: str) -> DataFrame:
        return self.headers.filter(F.col("order_status") == status)

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}
