"""Helpers of the operators: copies by salt, intermediate tables."""

import os
import urllib.parse

from pyspark.sql import functions as F

from sonoquery.llm.frames import WRITING, cut, scratch, spread


def size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def folder(df):
    return os.path.dirname(urllib.parse.urlparse(df.inputFiles()[0]).path)


def test_copies_are_counted(spark):
    df = cut(spark.range(100).select("id", F.struct("id").alias("o"), F.array("id").alias("_salt0"), F.lit(None).alias("none").cast("string")))
    got = spread(df, 16)
    plain = df.withColumn("salt", F.explode(F.lit(list(range(16)))))
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert size(got) >= 16 * size(df) > size(plain) / 2
    assert spread(df.where("false"), 4).count() == 0


def test_shuffle_files_go_when_the_table_stands(spark):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files(spark)
    done = cut(df.join(df.withColumnRenamed("count", "again"), "k"))
    assert not shuffle_files(spark) - before
    assert done.count() == 10 and done.where("count = again").count() == 10
    assert all(spark.conf.get(k, None) is None for k in WRITING)


def test_settings_of_the_user_stay(spark):
    key = "spark.sql.sources.fileCompressionFactor"
    spark.conf.set(key, "2.0")
    try:
        assert cut(spark.range(3)).count() == 3 and spark.conf.get(key) == "2.0"
    finally:
        spark.conf.unset(key)


def test_scratch(spark):
    with scratch() as written:
        gone, stays = cut(spark.range(5)), cut(spark.range(6))
        folders = [folder(gone), folder(stays)]
        written.remove(stays)
    assert [os.path.exists(f) for f in folders] == [False, True]
    assert stays.count() == 6 and os.path.exists(folder(cut(spark.range(2))))
