"""Hot-key salting returns exactly the plain join."""
from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.skew import hot_keys, salted_join


def _check(spark, big, small):
    cond = F.col("d") <= F.col("q")
    plain = big.join(small, (F.col("name") == F.col("n")) & cond)
    salted = salted_join(big, small, "name", "n", condition=cond)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    semi_plain = big.join(small, F.col("name") == F.col("n"), "left_semi")
    semi = salted_join(big, small, "name", "n", how="left_semi")
    assert sorted(map(tuple, semi.collect())) == sorted(map(tuple, semi_plain.collect()))


def test_one_name_holds_half_of_the_references(spark):
    big = spark.createDataFrame(
        [("hot", i, i % 7) for i in range(400)] + [(f"k{i % 40}", i, i % 7) for i in range(400)],
        "name string, src bigint, q bigint",
    )
    small = spark.createDataFrame(
        [("hot", "A", 1), ("hot", "B", 5), ("k3", "C", 0), ("k5", "D", 9)], "n string, cls string, d bigint"
    )
    (hot,) = hot_keys(big, small, "name", "n").collect()
    assert hot["_hot"] == "hot" and hot["_split_big"] and hot["_buckets"] > 1
    _check(spark, big, small)


def test_one_name_holds_half_of_the_definitions(spark):
    big = spark.createDataFrame([("hot", 1, 6), ("hot", 2, 0)] + [(f"k{i}", i, 3) for i in range(60)], "name string, src bigint, q bigint")
    small = spark.createDataFrame([("hot", f"c{i}", i % 7) for i in range(300)] + [(f"k{i % 60}", "x", 1) for i in range(300)], "n string, cls string, d bigint")
    hot = [r for r in hot_keys(big, small, "name", "n").collect() if r["_hot"] == "hot"]
    assert len(hot) == 1 and not hot[0]["_split_big"]
    _check(spark, big, small)
    _check(spark, big.limit(0), small)
