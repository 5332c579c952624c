"""Profiles, data-quality counters, distributions and de-duplication of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sample deviation of a value by key; null keys go."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"))


def describe(df: DataFrame, value: Column) -> DataFrame:
    """Count, mean, deviation, least, quartiles (linear) and most of an expression."""
    quartile = lambda q: F.round(F.percentile("v", F.lit(q)), 6)
    return df.select(value.alias("v")).agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").cast("double").alias("least"),
        quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max("v").cast("double").alias("most"))


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """Share of rows in equal-width bins from the least to the most value; the last bin has its upper border."""
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    borders = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total")).first()
    lo, hi = (F.lit(x).cast("double") for x in (borders.lo, borders.hi))
    bin_of = F.when(hi == lo, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / ((hi - lo) / bins))))
    return rows.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.count("*") / borders.total, 9).alias("share"))


def completeness(required: list[str]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in required])


def keep_most_complete(df: DataFrame, key: str, required: list[str], order: str) -> DataFrame:
    """One row a key: that with the fewest nulls, then the first by order."""
    ranked = df.withColumn("n_present", completeness(required))
    return _first(ranked, [key], [F.col("n_present").desc(), F.col(order)])


def keep_max(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row a key: that with the highest value, then the first by order."""
    return _first(df, keys, [F.col(value).desc_nulls_last(), F.col(order)])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _first(df, keys, [F.col(c).asc_nulls_last() for c in order])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # row_number() = 1 lets Spark keep one row a key in each task before the shuffle.
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def counters(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows, rows after the first of their key, nulls and distinct values."""
    return df.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("duplicated"), F.count_if(F.col(column).isNull()).alias("missing"), F.count_distinct(column).alias("n_distinct"))


def mean_of_columns(columns: list[str]) -> Column:
    """Mean over columns of a row, nulls skipped."""
    there = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, b: a + b) / F.size(there))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in one frame only, with the side they are on."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
