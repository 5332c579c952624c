"""Long time series: canonical form, shortlists of anomalous series, context windows, review padding (W1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a canonical series; freq is optional (fixed values).
CANONICAL = ("indicator_id", "indicator_name", "geography_id", "geography_name", "period", "value", "is_imputed", "anomaly_score", "outlier_count")
SERIES = ("indicator_id", "geography_id")


def rename_to_canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns that are there to known canonical names; mapping: canonical name to source name."""
    known = {src: name for name, src in mapping.items() if src in df.columns and name in (*CANONICAL, "freq")}
    return df.withColumnsRenamed(known)


def validate(df: DataFrame, required: tuple[str, ...] = CANONICAL) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def imputed_flag(flag: str | Column) -> Column:
    """A flag as boolean, null as false."""
    return F.coalesce((F.col(flag) if isinstance(flag, str) else flag).cast("boolean"), F.lit(False))


def year_columns(df: DataFrame) -> list[str]:
    """Columns whose names are integers."""
    return [c for c in df.columns if c.strip().lstrip("+-").isdigit()]


def wide_to_long(df: DataFrame, ids: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """One row for each id and year column; nulls are kept."""
    years = year_columns(df)
    return df.unpivot(ids, years, "_year", value).withColumn(period, F.expr("try_cast(_year AS INT)")).drop("_year")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all shared columns, null keys equal to null keys."""
    shared = [c for c in left.columns if c in right.columns]
    names = {c: f"_right_{c}" for c in shared}
    other = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in shared])
    return left.join(other, on, "left").drop(*names.values())


def restrict_to_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct keys with their rows of df; keys without rows stay, with nulls."""
    return keys.distinct().join(df, keys.columns, "left")


def scored(series: DataFrame, thresholds: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """Add anomaly_score (the absolute z-score within the series, 0 for constant ones) and outlier_count (thresholds reached)."""
    per = Window.partitionBy(*SERIES)
    spread = F.stddev_samp("value").over(per)
    z = F.when(spread > 0, F.abs(F.col("value") - F.avg("value").over(per)) / spread).otherwise(0.0)
    with_score = series.withColumn("anomaly_score", F.coalesce(F.round(z, 6), F.lit(0.0)))
    return with_score.withColumn("outlier_count", reduce(lambda a, b: a + b, [(F.col("anomaly_score") >= t).cast("int") for t in thresholds]))


def shortlist(series: DataFrame, by: str = "sum", min_outliers: int = 3, limit: int | None = 10_000) -> DataFrame:
    """Series with anomalous points by their summed or highest score, best first: a top-k report."""
    points = series.where((F.col("outlier_count") >= min_outliers) & ~F.col("is_imputed") & F.col(SERIES[0]).isNotNull() & F.col(SERIES[1]).isNotNull())
    agg = {"sum": F.sum, "max": F.max}[by]
    ranked = points.groupBy(*SERIES).agg(F.count("*").alias("n_points"), F.round(agg("anomaly_score"), 6).alias("score"))
    ranked = ranked.orderBy(F.col("score").desc_nulls_last(), *SERIES)
    return ranked.limit(limit) if limit else ranked


def anomaly_ranges(series: DataFrame, window: int = 3, min_outliers: int = 3) -> DataFrame:
    """Per series, the ranges [p - window, p + window] of anomalous periods, clipped to the series, merged where they share a period."""
    per = Window.partitionBy(*SERIES)
    bounded = series.withColumns({"first": F.min("period").over(per), "last": F.max("period").over(per)})
    points = bounded.where((F.col("outlier_count") >= min_outliers) & ~F.col("is_imputed"))
    ranges = points.select(*SERIES, F.greatest("first", F.col("period") - window).alias("lo"), F.least("last", F.col("period") + window).alias("hi")).distinct()
    order = Window.partitionBy(*SERIES).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (before < F.col("lo")), 1).otherwise(0)).over(order)
    return ranges.withColumn("island", island).groupBy(*SERIES, "island").agg(F.min("lo").alias("window_start"), F.max("hi").alias("window_end")).drop("island")


def context_windows(series: DataFrame, window: int = 3, min_outliers: int = 3) -> DataFrame:
    """The merged ranges with the series' rows inside each, by period."""
    ranges = anomaly_ranges(series, window, min_outliers)
    rows = series.select(*SERIES, "period", "value", "is_imputed")
    inside = ranges.join(rows, list(SERIES)).where(F.col("period").between(F.col("window_start"), F.col("window_end")))
    return inside.groupBy(*SERIES, "window_start", "window_end").agg(F.array_sort(F.collect_list(F.struct("period", "value", "is_imputed"))).alias("series"))


def review_padding(series: DataFrame, windows: DataFrame, padding: int = 5) -> DataFrame:
    """For windows (series keys, window_start, window_end), the series within padding of each."""
    rows = series.select(*SERIES, "period", "value")
    near = windows.join(rows, list(SERIES), "left").where(F.col("period").between(F.col("window_start") - padding, F.col("window_end") + padding))
    return near.groupBy(*SERIES, "window_start", "window_end").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("timeseries"))


def first_name(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The name that comes first by order, for each key."""
    return df.groupBy(key).agg(F.min_by(name, order).alias(name))


def last_name(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The name that comes last by order, for each key."""
    return df.groupBy(key).agg(F.max_by(name, order).alias(name))


def with_names(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Look up a name, falling back on the key itself."""
    return df.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))
