import datetime as dt
import pathlib
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from soukline.session import tune  # noqa: E402
from soukline.sources.tables import SCHEMAS, Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        # Small inputs must still span several partitions, or offsets between
        # partitions would never be tested.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield tune(session)


def ts(text):
    return dt.datetime.fromisoformat(text)


class Shop:
    """Small hand-made tables; every part that is not given is empty."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {name: [] for name in SCHEMAS}

    def order(self, order_id, person, bought, *, status="delivered", arrived="same", promised=None,
              approved=None, handed=None, state="AA", city="x", items=(("p1", "s1", 100, 0),), reviews=(), payments=()):
        bought = ts(bought)
        arrived = bought if arrived == "same" else (ts(arrived) if arrived else None)
        self.rows["customers"].append((f"c{order_id}", person, "123", city, state))
        self.rows["orders"].append((
            order_id, f"c{order_id}", status, bought, ts(approved) if approved else bought,
            ts(handed) if handed else arrived, arrived, ts(promised) if promised else bought + dt.timedelta(days=10)))
        for n, (product, seller, price, freight) in enumerate(items, 1):
            self.rows["items"].append((order_id, n, product, seller, bought, Decimal(str(price)), Decimal(str(freight))))
        for n, score in enumerate(reviews, 1):
            self.rows["reviews"].append((f"{order_id}-{n}", order_id, score, None, None, bought, bought))
        for kind, terms, value in payments:
            self.rows["payments"].append((order_id, kind, terms, Decimal(str(value))))
        return self

    def product(self, product_id, category):
        self.rows["products"].append((product_id, category, 1, 1, 1, 500, 1, 1, 1))
        return self

    def seller(self, seller_id, state="AA"):
        self.rows["sellers"].append((seller_id, "1", "town", state))
        return self

    def tables(self):
        if not self.rows["products"]:
            self.product("p1", "toys")
        if not self.rows["sellers"]:
            self.seller("s1")
        if not self.rows["translation"]:
            kinds = sorted({r[1] for r in self.rows["products"] if r[1]})
            self.rows["translation"] = [(k, k) for k in kinds]
        return Tables(**{n: self.spark.createDataFrame(r, SCHEMAS[n]) for n, r in self.rows.items()})


@pytest.fixture
def shop(spark):
    return Shop(spark)
