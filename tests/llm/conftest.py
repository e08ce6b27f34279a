import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that the operators use themselves, as extra columns of a table.
CLASHES = [
    "n_words", "kept", "row", "h", "fp", "k_id", "k_h", "size", "key", "g", "score", "f_lang", "cluster", "label",
    "weight", "pick", "held_out", "root", "time", "spans", "host", "path", "rule", "verdict", "reject_reason",
]


def clean(n, seed=0, words=80):
    return " ".join(f"w{(seed * 7919 + n * 104729 + k * 31 + k * k) % 5003}" for k in range(words))


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ties."""
    long = clean(1, 9, 120_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", None, 7), (4, "one", None, "b", 3),
        (5, "one two", "de", "b", 7), (None, clean(5), "en", "a", 100), (6, long, "en", "a", len(long)),
        (7, "ünïcode ß 漢字 🎉 " * 30, "fr", "ü", None), (8, "\x00 null byte", "en", "a", 10), (9, "12 34 !!", "en", "a", 8),
    ]
    rows += [(20, clean(20), "en", "a", 1)] * 3 + [(21, clean(20), "en", "a", 1), (22, clean(20).upper(), "en", None, 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCUMENTS)
    return df.selectExpr("*", *[f"'x' AS {name}" for name in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCUMENTS).repartition(3)

    return make
