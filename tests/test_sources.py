import pytest
from pyspark.sql import functions as F

from soukline import session
from soukline.operators import marts
from soukline.sources import readers, sinks


def test_csv_keeps_zips_nulls_and_quotes(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        'c1,u1,01234,"rio, de janeiro",RJ\nc2,u2,,sp,SP\n')
    got = readers.read_csv(spark, str(tmp_path / "customers.csv"), "customers").collect()
    assert (got[0].customer_zip_code_prefix, got[0].customer_city) == ("01234", "rio, de janeiro")
    assert got[1].customer_zip_code_prefix is None
    (tmp_path / "reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"two\nlines ""said""",2018-01-02 00:00:00,2018-01-03 10:20:30\n')
    row = readers.read_csv(spark, str(tmp_path / "reviews.csv"), "reviews").first()
    assert row.review_comment_message == 'two\nlines "said"' and row.review_answer_timestamp.second == 30


def test_stage_round_trip(spark, shop, tmp_path):
    t = shop.order("o1", "p", "2020-01-01", reviews=(4,), payments=(("boleto", 1, 5),)).tables()
    sinks.write_stage(t.named(), str(tmp_path / "stage"))
    again = readers.read_stage(spark, str(tmp_path / "stage"))
    assert marts.order_fact(again).collect() == marts.order_fact(t).collect()
    sinks.write_stage(t.named(), str(tmp_path / "csv"), fmt="csv")
    paths = {name: f"{tmp_path}/csv/{name}" for name in t.named()}
    assert marts.order_fact(readers.read_csv_tables(spark, paths)).collect() == marts.order_fact(t).collect()


def test_refresh_rewrites_only_the_given_months(spark, tmp_path):
    path = str(tmp_path / "fact")
    old = spark.createDataFrame([("2020-01", 1), ("2020-02", 2)], "purchase_month string, v int")
    sinks.refresh_months(old, path)
    sinks.refresh_months(spark.createDataFrame([("2020-02", 9)], "purchase_month string, v int"), path)
    got = spark.read.parquet(path).select(F.date_format(F.col("purchase_month").cast("date"), "yyyy-MM"), "v").collect()
    assert sorted(map(tuple, got)) == [("2020-01", 1), ("2020-02", 9)]


def test_metrics_are_one_document(spark, tmp_path):
    sinks.write_metrics(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("part-*"))) == 1


def test_table_and_views(spark, shop, tmp_path):
    t = shop.order("o1", "p", "2020-01-01").tables()
    sinks.register_views(t.named())
    assert spark.sql("SELECT count(*) FROM items JOIN orders USING (order_id)").first()[0] == 1


def test_landing_is_partitioned_by_day(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-02-03 10:00:00' AS ts, 1 AS v")
    sinks.land_daily(df, str(tmp_path / "land"), F.col("ts"))
    sinks.land_daily(df, str(tmp_path / "land"), F.col("ts"))
    assert (tmp_path / "land" / "year=2024" / "month=2" / "day=3").is_dir()
    assert spark.read.parquet(str(tmp_path / "land")).count() == 2


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
