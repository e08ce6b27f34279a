from pyspark.sql import functions as F

from soukline.session import cut, shuffles_freed
from soukline.sources import sinks

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_stored_results_give_their_shuffles_back(spark, tmp_path):
    counts = spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count()
    before = shuffle_files(spark)
    kept = cut(counts)
    sinks.write_stage({"counts": counts}, str(tmp_path))
    assert shuffle_files(spark) <= before
    # both the stored rows and the plan itself can still be read, again and again
    for df in (kept, counts, counts, spark.read.parquet(f"{tmp_path}/counts")):
        assert df.agg(F.sum("count")).first()[0] == 5000


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(KEY, None)
    try:
        with shuffles_freed(spark):
            assert spark.conf.get(KEY) == "true"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(KEY, "false") == (before or "false")
