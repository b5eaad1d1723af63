"""Hot-key splitting for equi-joins whose key may hold a large share of the work.

A key's work is the number of pairs it makes: its rows on one side times its rows on the
other.  ``salted_join`` finds the keys that make more than a task's mean share of all
pairs, and splits each over as many salt values as it has such shares: the larger of its two
sides is spread over them, the other is repeated once per salt value.  Other keys join as
before.  The result is exactly the plain join.

Fewer keys than tasks can make more than a task's mean share each, so the list of hot keys
is bounded by ``spark.sql.shuffle.partitions`` and is broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(big: DataFrame, small: DataFrame, big_key: str, small_key: str) -> DataFrame:
    """(_hot, _buckets, _split_big) of the keys that make more than a task's mean share of the pairs."""
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = big.groupBy(F.col(big_key).alias("_hot")).agg(F.count(F.lit(1)).alias("_l"))
    right = small.groupBy(F.col(small_key).alias("_k")).agg(F.count(F.lit(1)).alias("_r"))
    # a key without partner still costs its own rows
    pairs = left.join(right, F.col("_hot") == F.col("_k"), "left").select(
        "_hot", "_l", F.coalesce("_r", F.lit(0)).alias("_r")).withColumn("_w", F.col("_l").cast("double") * F.greatest("_r", F.lit(1)))
    total = pairs.select(F.coalesce(F.sum("_w"), F.lit(0.0))).scalar()
    return pairs.filter(F.col("_w") * tasks > total).select(
        "_hot", F.ceil(F.col("_w") * tasks / total).cast("int").alias("_buckets"), (F.col("_l") >= F.col("_r")).alias("_split_big"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    big_key: str,
    small_key: str,
    condition: Column | None = None,
    how: str = "inner",
    salt_cols: list[str] | None = None,
) -> DataFrame:
    """``big`` join ``small`` on big_key == small_key (plus ``condition``), hot keys split.

    ``salt_cols`` are columns of ``big`` hashed to pick a row's salt (default: all).
    ``how`` must keep every matching pair once: inner or left_semi (which always spreads ``big``).
    """
    assert how in ("inner", "left_semi")
    hot = hot_keys(big, small, big_key, small_key)
    if how == "left_semi":
        hot = hot.withColumn("_split_big", F.lit(True))
    hot = F.broadcast(hot)  # both joins below read the same broadcast; nothing runs before the result is asked for

    def salted(side: DataFrame, key: str, spread: Column, cols: list[str], name: str) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(*cols), F.col("_buckets")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_buckets") - 1)
        salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).when(spread, one).otherwise(every)
        return side.join(hot, F.col(key) == F.col("_hot"), "left").select(*side.columns, F.explode(salts).alias(name))

    left = salted(big, big_key, F.col("_split_big"), salt_cols or big.columns, "_salt")
    right = salted(small, small_key, ~F.col("_split_big"), small.columns, "_salt_r")
    cond = (F.col(big_key) == F.col(small_key)) & (F.col("_salt") == F.col("_salt_r"))
    return left.join(right, cond if condition is None else cond & condition, how).drop("_salt", "_salt_r")
