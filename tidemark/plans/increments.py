"""Queries that run tables through the incremental operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.session import shared_dir, ship
from tidemark.sources.paging import JsonPages, write_pages
from tidemark.sources.tables import table
from tidemark.streaming import upsert as up


def _stream(spark, d: str, name: str):
    schema = table(spark, d, name).schema
    path = f"{d}/{name}.parquet"
    # A single file is streamed by its folder and name.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_upsert(spark, d):
    """The newest event of each user and type, kept by a stream."""
    folder = _folder(spark)
    events = _stream(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    up.upsert(events, f"{folder}/state", f"{folder}/progress", ["user_id", "event_type"], ["ts", "event_id"]).awaitTermination()
    return up.Snapshots(spark, f"{folder}/state").latest().select("user_id", "event_type", "event_id")


def stream_families(spark, d):
    """Customers' names by market segment, integrated wave by wave."""
    folder = _folder(spark)
    waves = _stream(spark, d, "customer").select("c_mktsegment", F.array("c_name").alias("names"))
    up.family_waves(waves, f"{folder}/state", f"{folder}/progress", "c_mktsegment", "names").awaitTermination()
    return up.Snapshots(spark, f"{folder}/state").latest().select("c_mktsegment", F.size("names").alias("n"), F.md5(F.array_join("names", ",")).alias("names_md5"))


def windowed_counts(spark, d):
    """Event counts by day and type: the streaming aggregation's plan, on the whole table."""
    daily = up.windowed_counts(table(spark, d, "events"))
    return daily.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


PARTS = "p_partkey long, p_name string, p_brand string, p_size int"


def _catalogue(spark, d) -> str:
    """The parts as a paged catalogue."""
    ship(spark)
    spark.dataSource.register(JsonPages)
    folder = f"{_folder(spark)}/pages"
    write_pages(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), folder, "p_partkey", 500)
    return folder


def paged_parts(spark, d):
    """Parts of a brand read page by page from a catalogue of unknown length."""
    pages = spark.read.format("json_pages").option("path", _catalogue(spark, d)).option("fields", PARTS).option("page_size", 200).load()
    return pages.where("p_brand IN ('Brand#1', 'Brand#2')")


def paged_parts_first(spark, d):
    """The pages' first 150 items: no task asks for more."""
    return spark.read.format("json_pages").option("path", _catalogue(spark, d)).option("fields", PARTS).option("page_size", 40).option("max_items", 150).load()


def paged_parts_stream(spark, d):
    """The catalogue as a stream, its offset kept by Spark, written and read again; a second run finds nothing new."""
    folder, catalogue = _folder(spark), _catalogue(spark, d)
    for _ in range(2):
        pages = spark.readStream.format("json_pages").option("path", catalogue).option("fields", PARTS).option("page_size", 500).load()
        pages.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PARTS).parquet(f"{folder}/out").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def fuzzy_waves(spark, d):
    """Families of part names in three waves by size, each merged into the families so far by the likeness of their keys."""
    parts = table(spark, d, "part").select("p_size", F.concat_ws(" ", "p_name", "p_type").alias("key"), F.array("p_brand").alias("names"))
    waves = up.FamilyWaves(spark, _folder(spark))
    for number, sizes in enumerate(("p_size <= 5", "p_size BETWEEN 6 AND 30", "p_size > 30")):
        waves.integrate(parts.where(sizes).select("key", "names"), number)
    return waves.families.latest().select("key", F.size("names").alias("n"), F.md5(F.array_join("names", ",")).alias("names_md5"))


QUERIES = {f.__name__: f for f in (stream_upsert, stream_families, windowed_counts, paged_parts, paged_parts_first, paged_parts_stream, fuzzy_waves)}

ORACLE = {
    "paged_parts": "SELECT p_partkey, p_name, p_brand, CAST(p_size AS INTEGER) AS p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')",
    "paged_parts_first": "SELECT p_partkey, p_name, p_brand, CAST(p_size AS INTEGER) AS p_size FROM part WHERE p_partkey < 150",
    "paged_parts_stream": "SELECT p_brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY 1",
    "stream_upsert": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stream_families": "SELECT c_mktsegment, CAST(count(DISTINCT c_name) AS INTEGER) AS n, md5(string_agg(DISTINCT c_name, ',' ORDER BY c_name)) AS names_md5 FROM customer GROUP BY 1",
    "windowed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
}
