"""Queries on anomaly explanation and on profiling rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import explanations as ex
from tidemark.operators import quality as q
from tidemark.operators import timeseries as ts
from tidemark.sources.tables import table


def event_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily series of events: indicator is the event type, geography the user, value the day's sum."""
    e = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    daily = e.groupBy(F.col("event_type").alias("indicator_id"), F.col("user_id").cast("string").alias("geography_id"), day.alias("period")).agg(F.round(F.sum("value"), 4).alias("value"), (F.count("*") > 2).alias("is_imputed"))
    return ts.scored(daily)


SERIES_SQL = """
daily AS (SELECT event_type AS indicator_id, CAST(user_id AS VARCHAR) AS geography_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
  round(sum(value), 4) AS value, count(*) > 2 AS is_imputed FROM events GROUP BY 1, 2, 3),
z AS (SELECT *, stddev_samp(value) OVER w AS sd, avg(value) OVER w AS mean FROM daily WINDOW w AS (PARTITION BY indicator_id, geography_id)),
s AS (SELECT indicator_id, geography_id, period, value, is_imputed, coalesce(round(CASE WHEN sd > 0 THEN abs(value - mean) / sd ELSE 0.0 END, 6), 0.0) AS anomaly_score FROM z),
series AS (SELECT *, CAST(anomaly_score >= 1.0 AS INTEGER) + CAST(anomaly_score >= 1.5 AS INTEGER) + CAST(anomaly_score >= 2.0 AS INTEGER) AS outlier_count FROM s)"""

RANGES_SQL = SERIES_SQL + """,
bounds AS (SELECT *, min(period) OVER w AS first, max(period) OVER w AS last FROM series WINDOW w AS (PARTITION BY indicator_id, geography_id)),
ranges AS (SELECT DISTINCT indicator_id, geography_id, greatest(first, period - 3) AS lo, least(last, period + 3) AS hi FROM bounds WHERE outlier_count >= 3 AND NOT is_imputed),
marked AS (SELECT *, max(hi) OVER (PARTITION BY indicator_id, geography_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranges),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR before < lo THEN 1 ELSE 0 END) OVER (PARTITION BY indicator_id, geography_id ORDER BY lo, hi) AS island FROM marked),
windows AS (SELECT indicator_id, geography_id, min(lo) AS window_start, max(hi) AS window_end FROM islands GROUP BY indicator_id, geography_id, island)"""


def points_text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: F.concat(x["period"].cast("string"), F.lit(":"), F.format_string("%.4f", x["value"]))), ";")


def ts_scored_series(spark, d):
    return event_series(spark, d)


def ts_shortlist_sum(spark, d):
    return ts.shortlist(event_series(spark, d), "sum", limit=None)


def ts_shortlist_max(spark, d):
    return ts.shortlist(event_series(spark, d), "max", limit=None)


def ts_context_windows(spark, d):
    return ts.context_windows(event_series(spark, d)).select("indicator_id", "geography_id", "window_start", "window_end", points_text("series").alias("series"))


def ts_review_padding(spark, d):
    series = event_series(spark, d)
    return ts.review_padding(series, ts.anomaly_ranges(series)).select("indicator_id", "geography_id", "window_start", "window_end", points_text("timeseries").alias("timeseries"))


def _yearly(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    years = sorted(r.year for r in o.select("year").distinct().collect())  # column names of a wide table
    return o.groupBy("o_custkey").pivot("year", years).agg(F.round(F.sum("o_totalprice"), 2))


def wide_to_long(spark, d):
    return ts.wide_to_long(_yearly(spark, d), ["o_custkey"])


def natural_left_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"), "c_mktsegment")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return ts.natural_left_join(c, n)


def key_restrict(spark, d):
    o = table(spark, d, "orders")
    keys = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).withColumn("c_mktsegment", F.lit("BUILDING"))
    return ts.restrict_to_keys(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), keys)


def dimension_names(spark, d):
    """First and last status by customer, by order key, with a fallback for customers without orders."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"), "o_orderkey")
    first = ts.first_name(o, "key", "name", "o_orderkey").withColumnRenamed("name", "first_name")
    last = ts.last_name(o, "key", "name", "o_orderkey").withColumnRenamed("name", "last_name")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return ts.with_names(ts.with_names(c, first, "key", "first_name"), last, "key", "last_name")


def _explainers(spark, d):
    """Two explainers of documents: the label, and a rule on length."""
    a = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "data_error").when(F.col("quality") == 1, "real_event").otherwise("unknown").alias("classification"), (0.5 + 0.5 * F.col("quality")).alias("confidence"))
    docs = table(spark, d, "documents")
    b = docs.where("n_chars > 200").select("doc_id", F.when(F.col("n_chars") > 4000, "data_error").when(F.col("n_chars") > 800, "real_event").otherwise("unknown").alias("classification"), F.least(F.lit(1.0), F.col("n_chars") / 8000).alias("confidence"))
    return a, b


EXPLAINERS_SQL = """
a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'data_error' WHEN quality = 1 THEN 'real_event' ELSE 'unknown' END AS classification, CAST(0.5 + 0.5 * quality AS DOUBLE) AS confidence FROM labels),
b AS (SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'data_error' WHEN n_chars > 800 THEN 'real_event' ELSE 'unknown' END AS classification, least(1.0, CAST(n_chars AS DOUBLE) / 8000) AS confidence FROM documents WHERE n_chars > 200)"""


def explainer_outer_join(spark, d):
    a, b = _explainers(spark, d)
    j = ex.outer_join({"a": a, "b": b}, ["doc_id"], ["classification", "confidence"])
    return j.select("doc_id", "classification_a", "classification_b", F.round("confidence_a", 6).alias("confidence_a"), F.round("confidence_b", 6).alias("confidence_b"))


def explainer_agreement(spark, d):
    a, b = _explainers(spark, d)
    found = ex.agreement(ex.by_context({"a": a, "b": b}, ["doc_id"], "classification", "classification"))
    return found.select("doc_id", "n_explainers", "agreement", "primary")


def agreement_rate(spark, d):
    a, b = _explainers(spark, d)
    j = ex.outer_join({"a": a, "b": b}, ["doc_id"], ["classification"]).na.drop()
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("classification_a") == F.col("classification_b")).cast("int")) * 100, 6).alias("percent"))


def crosstab_margins(spark, d):
    a, b = _explainers(spark, d)
    return ex.crosstab(ex.outer_join({"a": a, "b": b}, ["doc_id"], ["classification"]), "classification_a", "classification_b")


def confidence_corr(spark, d):
    a, b = _explainers(spark, d)
    return ex.outer_join({"a": a, "b": b}, ["doc_id"], ["confidence"]).na.drop().agg(F.count("*").alias("n"), F.round(F.corr("confidence_a", "confidence_b"), 6).alias("corr"))


def classification_profile(spark, d):
    return q.profile(_explainers(spark, d)[1], "classification", "confidence")


def rating_by_group(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rated = l.join(p, l.l_partkey == p.p_partkey).withColumn("rating", q.mean_of_columns(["l_quantity", "l_discount", "l_tax"]))
    return rated.groupBy("p_brand").agg(F.round(F.avg("rating"), 6).alias("mean_rating"), F.count("*").alias("n"))


def describe_lengths(spark, d):
    return q.describe(table(spark, d, "documents"), F.length("text"))


def length_histogram(spark, d):
    return q.histogram(table(spark, d, "documents"), F.log10(F.length("text") + 1.0))


def keep_max_row(spark, d):
    return q.keep_max(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber").select("l_orderkey", "l_extendedprice")


def first_wins(spark, d):
    return q.first_wins(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def last_wins(spark, d):
    return q.last_wins(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def completeness_dedup(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    l = l.withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return q.keep_most_complete(l, "l_partkey", ["discount", "tax"], "ord").groupBy("l_partkey", "n_present").agg(F.min("ord").alias("ord"))


def quality_counters(spark, d):
    return q.counters(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


def set_difference(spark, d):
    return q.unmatched(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def feedback_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.round("value", 4).alias("value"))
    return ex.latest_feedback(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def legacy_ids(spark, d):
    """Ids of both kinds, written for each customer and order priority, and parsed again."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ind"), F.col("o_custkey").cast("string").alias("geo"))
    custom = F.concat(F.lit("nosearch-h1-"), "ind", F.lit("-"), "geo", F.lit("-"), F.md5("ind"))
    parsed = ex.parse_legacy_id(custom)
    return o.select("o_orderkey", parsed["indicator_id"].alias("indicator_id"), parsed["geography_id"].alias("geography_id"), ex.compact_id(F.col("ind"), F.col("geo")).alias("compact_id"))


QUERIES = {f.__name__: f for f in (
    ts_scored_series, ts_shortlist_sum, ts_shortlist_max, ts_context_windows, ts_review_padding, wide_to_long, natural_left_join, key_restrict, dimension_names, explainer_outer_join, explainer_agreement, agreement_rate,
    crosstab_margins, confidence_corr, classification_profile, rating_by_group, describe_lengths, length_histogram, keep_max_row, first_wins, last_wins, completeness_dedup, quality_counters, set_difference, feedback_upsert, legacy_ids,
)}

_SHORT = SERIES_SQL + " SELECT indicator_id, geography_id, count(*) AS n_points, round({f}(anomaly_score), 6) AS score FROM series WHERE outlier_count >= 3 AND NOT is_imputed GROUP BY 1, 2"
_POINTS = "string_agg(period || ':' || printf('%.4f', value), ';' ORDER BY period)"

ORACLE = {
    "ts_scored_series": f"WITH {SERIES_SQL} SELECT * FROM series",
    "ts_shortlist_sum": "WITH " + _SHORT.format(f="sum"),
    "ts_shortlist_max": "WITH " + _SHORT.format(f="max"),
    "ts_context_windows": f"WITH {RANGES_SQL} SELECT w.indicator_id, w.geography_id, window_start, window_end, {_POINTS} AS series FROM windows w JOIN series s ON w.indicator_id = s.indicator_id AND w.geography_id = s.geography_id AND period BETWEEN window_start AND window_end GROUP BY 1, 2, 3, 4",
    "ts_review_padding": f"WITH {RANGES_SQL} SELECT w.indicator_id, w.geography_id, window_start, window_end, {_POINTS} AS timeseries FROM windows w JOIN series s ON w.indicator_id = s.indicator_id AND w.geography_id = s.geography_id AND period BETWEEN window_start - 5 AND window_end + 5 GROUP BY 1, 2, 3, 4",
    "wide_to_long": "SELECT c.o_custkey, y.period, s.value FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS period FROM orders) y LEFT JOIN (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2) s ON c.o_custkey = s.o_custkey AND y.period = s.period",
    "natural_left_join": "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey",
    "key_restrict": "SELECT k.c_custkey, k.c_mktsegment, c_acctbal FROM (SELECT DISTINCT o_custkey AS c_custkey, 'BUILDING' AS c_mktsegment FROM orders WHERE o_orderstatus = 'F') k LEFT JOIN customer c ON k.c_custkey = c.c_custkey AND k.c_mktsegment = c.c_mktsegment",
    "dimension_names": "SELECT c_custkey AS key, coalesce(f, CAST(c_custkey AS VARCHAR)) AS first_name, coalesce(l, CAST(c_custkey AS VARCHAR)) AS last_name FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS f, arg_max(o_orderpriority, o_orderkey) AS l FROM orders GROUP BY 1) o ON c_custkey = o_custkey",
    "explainer_outer_join": f"WITH {EXPLAINERS_SQL} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.classification AS classification_a, b.classification AS classification_b, round(a.confidence, 6) AS confidence_a, round(b.confidence, 6) AS confidence_b FROM a FULL JOIN b ON a.doc_id = b.doc_id",
    "explainer_agreement": f"WITH {EXPLAINERS_SQL}, u AS (SELECT doc_id, classification FROM a UNION ALL SELECT doc_id, classification FROM b) SELECT doc_id, CAST(count(*) AS INTEGER) AS n_explainers, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT classification) = 1 THEN 'agree' ELSE 'disagree' END AS agreement, min(classification) AS primary FROM u WHERE doc_id IS NOT NULL GROUP BY 1",
    "agreement_rate": f"WITH {EXPLAINERS_SQL} SELECT count(*) AS n, round(avg(CAST(a.classification = b.classification AS INTEGER)) * 100, 6) AS percent FROM a JOIN b ON a.doc_id = b.doc_id",
    "crosstab_margins": f"WITH {EXPLAINERS_SQL} SELECT CASE WHEN grouping(a.classification) = 1 THEN 'All' ELSE a.classification END AS classification_a, CASE WHEN grouping(b.classification) = 1 THEN 'All' ELSE b.classification END AS classification_b, count(*) AS n FROM a JOIN b ON a.doc_id = b.doc_id GROUP BY CUBE (a.classification, b.classification)",
    "confidence_corr": f"WITH {EXPLAINERS_SQL} SELECT count(*) AS n, round(corr(a.confidence, b.confidence), 6) AS corr FROM a JOIN b ON a.doc_id = b.doc_id",
    "classification_profile": f"WITH {EXPLAINERS_SQL} SELECT classification, count(confidence) AS n, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS std FROM b GROUP BY 1",
    "rating_by_group": "SELECT p_brand, round(avg((l_quantity + l_discount + l_tax) / 3), 6) AS mean_rating, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "describe_lengths": "SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS least, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, CAST(max(v) AS DOUBLE) AS most FROM (SELECT length(text) AS v FROM documents)",
    "length_histogram": "WITH r AS (SELECT log10(length(text) + 1.0) AS v FROM documents WHERE text IS NOT NULL), b AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS total FROM r) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(19, floor((v - lo) / ((hi - lo) / 20))) END AS INTEGER) AS bin, count(*) AS n, round(CAST(count(*) AS DOUBLE) / any_value(total), 9) AS share FROM r, b GROUP BY 1",
    "keep_max_row": "SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1",
    "first_wins": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1",
    "last_wins": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "quality_counters": "SELECT count(*) AS n, count(*) - count(DISTINCT o_custkey) AS duplicated, count(*) FILTER (o_orderstatus IS NULL) AS missing, count(DISTINCT o_orderstatus) AS n_distinct FROM orders",
    "set_difference": "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "feedback_upsert": "SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "legacy_ids": "SELECT o_orderkey, o_orderpriority AS indicator_id, CAST(o_custkey AS VARCHAR) AS geography_id, 'a1' || left(sha256(o_orderpriority || chr(0) || CAST(o_custkey AS VARCHAR)), 32) AS compact_id FROM orders",
    "completeness_dedup": "WITH x AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS ord, CAST(nullif(l_discount, 0.0) IS NOT NULL AS INTEGER) + CAST(nullif(l_tax, 0.0) IS NOT NULL AS INTEGER) AS n_present FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n_present DESC, ord) AS k FROM x) SELECT l_partkey, n_present, ord FROM y WHERE k = 1",
}
