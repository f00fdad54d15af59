"""Statistics of timed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.storage import keep

#: parts that a range of values is counted in, a round
BUCKETS = 256
_LARGEST = 1.7976931348623157e308


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """0 for the low end of a range, BUCKETS - 1 for its high end, and what lies between in order."""
    # halves, so that no difference overflows; ends beyond all numbers count as the largest
    half = {name: F.least(F.greatest(c.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST)) / 2 for name, c in (("v", value), ("a", low), ("b", high))}
    part = F.when(half["b"] > half["a"], F.floor((half["v"] - half["a"]) / (half["b"] - half["a"]) * (BUCKETS - 2))).otherwise(0)
    inner = 1 + F.least(F.greatest(part, F.lit(0)), F.lit(BUCKETS - 3))
    return F.when(value == low, 0).when(value == high, BUCKETS - 1).otherwise(inner).cast("int")


def ranked_values(values: DataFrame, ranks: DataFrame, by: str, value: str) -> DataFrame:
    """(by, found): the value of a rank, counted from 1, in each group of values; ranks(by, low, high, rank) also has each group's least and greatest value.

    Exact selection for all groups at once: each round counts a group's values in BUCKETS parts of the range that holds the rank, and goes on in one part, from its least to its greatest value. Rounds
    end when every range is one value. No group is sorted or put in one task: what meets by group are counts of parts. Values of one rank's part alone are counted again.
    """
    key, found = F.col(by).alias("__by"), None
    ranges = keep(ranks.select(key, "low", "high", "rank"), "ranges")
    while True:
        settled = ranges.where("low <=> high").select("__by", F.col("low").alias("found"))
        found = settled if found is None else found.unionByName(settled)
        open_ = ranges.where("not low <=> high")
        if open_.isEmpty():
            return found.withColumnRenamed("__by", by)
        v = F.col("__v")
        inside = values.select(key, F.col(value).alias("__v")).join(open_, "__by").where((v >= F.col("low")) & (v <= F.col("high")))
        counted = inside.groupBy("__by", "rank", _bucket(v, F.col("low"), F.col("high")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        # at most BUCKETS rows of a group
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("__by").orderBy("part")))
        chosen = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        ranges = keep(chosen.select("__by", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "ranges")


def timing_stats(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, min_value, max_value, mean_value, median_value, n); the median is the upper one of an even number. Nulls do not count, nor do rows without a group."""
    summed = runs.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.count(value).alias("n")).where("n > 0")
    kept = keep(summed, "summed")
    ranks = kept.select(by, F.col("min_value").alias("low"), F.col("max_value").alias("high"), (F.floor(F.col("n") / 2) + 1).alias("rank"))
    median = ranked_values(runs.where(F.col(value).isNotNull()), ranks, by, value).withColumnRenamed("found", "median_value")
    return kept.join(median, by).select(by, "min_value", "max_value", "mean_value", "median_value", "n")
