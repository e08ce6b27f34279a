"""Order, customer, part and supplier tables seen as the nine base relations.

Everything here is a lazy projection or a key-wise aggregate, so filters and
column selection still reach the Parquet scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soukline.functions.numbers import MONEY
from soukline.sources.tables import Tables

# Fixed values of the mapping.
STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
PROMISED_DAYS = {"1": 600, "2": 900, "3": 1200, "4": 1500, "5": 1800}
PAYMENT_TYPE = {
    "1": "credit_card", "2": "credit_card", "3": "boleto", "4": "voucher", "5": "debit_card",
}
UNTRANSLATED = "promo"
SOURCES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _lookup(key: Column, mapping: dict) -> Column:
    out = F.lit(None)
    for source, target in reversed(mapping.items()):
        out = F.when(key == source, F.lit(target)).otherwise(out)
    return out


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _rows(*candidates: Column) -> Column:
    """Explode the non-null structs: several rows per input row in one scan."""
    return F.explode(F.filter(F.array(*candidates), lambda row: row.isNotNull()))


def _hundredths(column: str) -> Column:
    return F.floor(F.col(column) * 100 + F.lit(0.5))


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1)


class Marketplace(Tables):
    """Each relation is built when first asked for, over a typed scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._scans: dict[str, DataFrame] = {}

    def scan(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = self.spark.read.schema(SOURCES[name]).parquet(f"{self.root}/{name}.parquet")
        return self._scans[name]

    def header(self) -> list[Column]:
        return [
            _key().alias("order_id"),
            _key().alias("customer_id"),
            _lookup(F.col("o_orderstatus"), STATUS).alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + _days(F.col("o_orderkey") % 3)).alias("order_approved_at"),
            (F.col("o_orderdate") + _days(_lookup(_priority(), PROMISED_DAYS))).alias("order_estimated_delivery_date"),
        ]

    def _with_ship_dates(self, orders: DataFrame) -> DataFrame:
        spans = self.scan("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.max("l_shipdate").alias("last_ship"), F.min("l_shipdate").alias("first_ship")
        )
        return orders.join(spans, "o_orderkey", "left")

    @property
    def headers(self) -> DataFrame:
        return self.scan("orders").select(*self.header())

    @cached_property
    def orders(self) -> DataFrame:
        return order_rows(self._with_ship_dates(self.scan("orders")), self.header())

    def _coded(self, status: str) -> DataFrame:
        """The stored code is compared, so the filter reaches the scan."""
        codes = [code for code, name in STATUS.items() if name == status]
        return self.scan("orders").filter(F.col("o_orderstatus").isin(*codes))

    def orders_in(self, status: str) -> DataFrame:
        return order_rows(self._with_ship_dates(self._coded(status)), self.header())

    def headers_in(self, status: str) -> DataFrame:
        return self._coded(status).select(*self.header())

    @cached_property
    def customers(self) -> DataFrame:
        nation = F.col("c_nationkey") == F.col("n_nationkey")
        placed = self.scan("orders").join(self.scan("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return placed.join(self.scan("nation"), nation).select(
            _key().alias("customer_id"),
            F.col("o_custkey").cast("string").alias("customer_unique_id"),
            (F.col("c_nationkey") * 37).cast("string").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    def _item_ids(self) -> list[Column]:
        return [
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_suppkey").cast("string").alias("seller_id"),
        ]

    def _item_money(self) -> tuple[Column, Column]:
        """Discounted price and tax of a line, rounded half up to whole cents."""
        gross = _hundredths("l_extendedprice")
        price = F.floor((gross * (100 - _hundredths("l_discount")) + 50) / 100)
        return price, F.floor((gross * _hundredths("l_tax") + 50) / 100)

    @property
    def item_cents(self) -> DataFrame:
        price, freight = self._item_money()
        return self.scan("lineitem").select(
            *self._item_ids(), price.alias("price"), freight.alias("freight_value"), (price + freight).alias("total_value")
        )

    @cached_property
    def items(self) -> DataFrame:
        price, freight = self._item_money()
        return self.scan("lineitem").select(
            *self._item_ids(),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            (price / F.lit(100.0)).cast(MONEY).alias("price"),
            (freight / F.lit(100.0)).cast(MONEY).alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        key = F.col("o_orderkey")

        def payment(kind: Column, installments: Column, value: Column) -> Column:
            return F.struct(
                kind.alias("payment_type"),
                installments.cast("int").alias("payment_installments"),
                value.cast(MONEY).alias("payment_value"),
            )

        main = payment(_lookup(_priority(), PAYMENT_TYPE), 1 + key % 10, F.col("o_totalprice"))
        extra = F.when(key % 17 == 0, payment(F.lit("voucher"), F.lit(1), F.lit(10)))
        return self.scan("orders").select(_key().alias("order_id"), _rows(main, extra).alias("p")).select(
            "order_id", "p.*"
        )

    def _reviews(self, source: DataFrame, dates: list[Column]) -> DataFrame:
        key = F.col("o_orderkey")

        def review(number: int, score: Column) -> Column:
            return F.struct(
                F.concat(_key(), F.lit(f"-{number}")).alias("review_id"), score.cast("int").alias("review_score")
            )

        first = F.when(key % 11 != 3, review(1, 1 + key % 5))
        second = F.when(key % 53 == 0, review(2, 1 + F.floor(key / 5) % 5))
        return source.select(
            _key().alias("order_id"),
            F.when(key % 3 == 0, F.lit("title")).alias("review_comment_title"),
            F.when(key % 2 != 0, F.lit("message")).alias("review_comment_message"),
            *dates,
            _rows(first, second).alias("r"),
        ).select(
            "r.review_id", "order_id", "r.review_score", "review_comment_title", "review_comment_message",
            *[d for d in ("review_creation_date", "review_answer_timestamp") if dates],
        )

    @property
    def scores(self) -> DataFrame:
        return self._reviews(self.scan("orders"), [])

    @cached_property
    def reviews(self) -> DataFrame:
        created = F.col("last_ship") + _days(F.col("o_orderkey") % 15)
        dates = [created.alias("review_creation_date"), (created + _days(F.lit(1))).alias("review_answer_timestamp")]
        return self._reviews(self._with_ship_dates(self.scan("orders")), dates)

    @cached_property
    def products(self) -> DataFrame:
        size = F.col("p_size")
        same = ["product_name_lenght", "product_description_lenght", "product_photos_qty"]
        sides = ["product_length_cm", "product_height_cm", "product_width_cm"]
        return self.scan("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.when(F.col("p_partkey") % 50 != 0, F.lower("p_type")).alias("product_category_name"),
            *[size.alias(name) for name in same],
            (size * 100).alias("product_weight_g"),
            *[size.alias(name) for name in sides],
        )

    @cached_property
    def translation(self) -> DataFrame:
        names = self.scan("part").select(F.lower("p_type").alias("product_category_name")).distinct()
        return names.filter(F.col("product_category_name") != UNTRANSLATED).withColumn(
            "product_category_name_english", F.concat(F.lit("type_"), "product_category_name")
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return self.scan("supplier").join(self.scan("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").cast("string").alias("seller_id"),
            (F.col("s_nationkey") * 37).cast("string").alias("seller_zip_code_prefix"),
            F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        name, part = F.col("p_name"), F.col("p_partkey")
        spaced = F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" "))
        return self.scan("part").select(
            F.regexp_extract("p_brand", r"(\d+)", 1).alias("geolocation_zip_code_prefix"),
            (F.col("p_retailprice") / 100).alias("geolocation_lat"),
            F.col("p_size").cast("double").alias("geolocation_lng"),
            F.when(part % 3 == 0, F.upper(name)).when(part % 3 == 1, spaced).otherwise(name).alias("geolocation_city"),
            F.substring("p_type", 1, 2).alias("geolocation_state"),
        )


def order_rows(orders: DataFrame, header: list[Column]) -> DataFrame:
    """Orders with their shipping span; also applied to a stream of orders."""
    return orders.select(
        *header[:5],
        F.col("first_ship").alias("order_delivered_carrier_date"),
        F.col("last_ship").alias("order_delivered_customer_date"),
        header[5],
    )


def load(spark: SparkSession, root: str) -> Marketplace:
    return Marketplace(spark, root)
