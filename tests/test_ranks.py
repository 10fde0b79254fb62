"""Row numbers by ranges of the key."""

from pyspark.sql import functions as F

from hireplane.operators.ranks import ranked


def test_numbers_follow_the_order(spark):
    rows = [(f"k{(i * 37) % 500:03d}" if i % 50 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, i int").repartition(7)
    got = ranked(df, ["key", "i"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(500))
    assert [(r.key, r.i) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_equal_keys_and_empty_tables(spark):
    assert sorted(r["rank"] for r in ranked(spark.range(60).withColumn("k", F.lit(1)), ["k"]).collect()) == list(range(60))
    assert ranked(spark.range(0), ["id"]).count() == 0
