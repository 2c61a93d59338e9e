"""Input partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys with more than this share of the rows are hot: there are fewer than its inverse of them, whatever the size of the data
HOT_SHARE = 1 / 200
#: but a key of so few rows is not worth the trouble
HOT_LEAST = 50_000
#: parts that the rows of a hot key are dealt out over
SALT = 32


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores (few small files) dealt out over all cores, for work that is heavy per row. A scan
    with enough splits, which any large table has, stays as it is and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def lookup(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner", salt: int = SALT) -> DataFrame:
    """``left`` joined with ``right``, in which a key occurs once. Rows of the keys in ``hot``, a frame of fewer than 1 / ``HOT_SHARE`` rows,
    are dealt out over ``salt`` parts by their other columns; the row of ``right`` that they meet is there in each."""
    few = F.broadcast(hot.select(*on).withColumn("__hot", F.lit(True)))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salt))).otherwise(0).cast("int")
    a = left.join(few, on, "left").withColumn("__part", part).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(few, on, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return a.join(b, [*on, "__part"], how).drop("__part")


def hot_keys(counted: DataFrame, count: str, total: int) -> DataFrame:
    """The rows of ``counted`` (a key and its number of rows, of ``total`` in all) whose keys are hot."""
    return counted.where(F.col(count) > max(total * HOT_SHARE, HOT_LEAST))
