import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from soukline.functions import clock, numbers, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def at(value):
    return F.lit(dt.datetime.fromisoformat(value)).cast("timestamp_ntz")


def test_four_day_differences(spark):
    bought, arrived = at("2020-01-02T13:00:00"), at("2020-01-01T01:00:00")
    row = one(
        spark, whole=clock.whole_days(arrived, bought), floor=clock.floor_days(arrived, bought),
        part=clock.fractional_days(arrived, bought), days=clock.calendar_days(arrived, bought),
    )
    assert tuple(row) == (-1, -2, -1.5, -1)


def test_month_arithmetic(spark):
    first = F.lit(dt.date(2017, 1, 31))
    later = [dt.date(2017, 1, 31), dt.date(2017, 2, 1), dt.date(2017, 12, 15), dt.date(2018, 1, 1)]
    row = one(spark, **{f"m{i}": clock.months_apart(F.lit(d), first) for i, d in enumerate(later)})
    assert tuple(row) == (0, 1, 11, 12)


def test_day_names_and_keys(spark):
    sunday = at("2024-03-10T08:00:00")
    row = one(spark, zero=clock.sunday_zero(sunday), name=clock.weekday_name(sunday),
              key=clock.day_key(sunday), month=clock.month_label(sunday))
    assert tuple(row) == (0, "Sunday", 20240310, "2024-03")


def folded(value):
    decomposed = unicodedata.normalize("NFKD", value.strip().lower())
    return " ".join("".join(ch for ch in decomposed if ord(ch) < 128).split())


def test_text_is_folded_and_spaced(spark):
    row = one(spark, accents=text.standardize_text(F.lit("  São   PAULO ")), nbsp=text.standardize_text(F.lit("a\u00a0\tb")),
              dropped=text.standardize_text(F.lit("a ★ b")), none=text.standardize_text(F.lit(None).cast("string")))
    assert tuple(row) == ("sao paulo", "a b", "a b", None)


def test_folding_is_lossless_on_every_character(spark):
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    rows = [(f"a{chr(c)}b {chr(c)}",) for c in points] + [(x,) for x in ("tōkyō", "Łódź", "ﬁm", "１２", "", "  ")]
    df = spark.createDataFrame(rows, "v string")
    got = df.select("v", text.standardize_text(F.col("v")).alias("f")).collect()
    # letters that only one of the two runtimes' Unicode versions lower-cases are not the library's
    assert [(r.v, r.f) for r in got if r.f != folded(r.v)] == []


def test_zero_pad_never_shortens(spark):
    row = one(spark, a=text.zero_pad(F.lit("123")), b=text.zero_pad(F.lit("12345")), c=text.zero_pad(F.lit("123456")))
    assert tuple(row) == ("00123", "12345", "123456")


def test_rounding_and_safe_division(spark):
    row = one(
        spark, up=numbers.rounded(F.lit(3.125)), down=numbers.rounded(F.lit(-3.125)), none=numbers.ratio(F.lit(10), F.lit(0)),
        zero=numbers.divide_or(F.lit(10), F.lit(0)), unknown=numbers.flag(F.lit(None).cast("int") > 1),
        low=numbers.bounded(F.lit(0), low=1), high=numbers.bounded(F.lit(9), high=5),
    )
    assert tuple(row) == (3.13, -3.13, None, 0.0, 0, 1, 5)


def test_bands_are_closed_on_the_right(spark):
    edges, labels = [-1, 90, 180, 365, None], ["a", "b", "c", "d"]
    values = [0, 90, 91, 180, 365, 366, None, -1]
    row = one(spark, **{f"v{i}": numbers.right_closed_band(F.lit(v).cast("int"), edges, labels) for i, v in enumerate(values)})
    assert tuple(row) == ("a", "a", "b", "b", "c", "d", None, None)


def test_surrogate_key_is_the_md5_prefix(spark):
    import hashlib
    row = one(spark, key=numbers.surrogate_key(F.lit("abc")))
    assert row.key == int(hashlib.md5(b"abc").hexdigest()[:15], 16)


def test_a_folding_plan_is_built_quickly(spark):
    import time
    text.standardize_text(F.col("x"))
    start = time.perf_counter()
    for _ in range(10):
        text.standardize_text(F.col("x"))
    assert time.perf_counter() - start < 0.5
