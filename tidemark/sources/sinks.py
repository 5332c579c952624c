"""Writing results: JSON Lines, compressed JSON, partitioned tables, batch requests with their id map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, gzip: bool = False, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Containers as JSON text, header first."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode(mode).csv(path, header=True)


def write_batch(requests: DataFrame, path: str, map_path: str, request: str = "request", keys: tuple[str, ...] = ("custom_id", "indicator_id", "geography_id")) -> None:
    """Request texts, and beside them the table from custom ids to series keys."""
    requests.select(request).write.mode("overwrite").text(path)
    requests.select(*keys).distinct().write.mode("overwrite").parquet(map_path)
