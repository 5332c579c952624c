"""Reading tables and files: Parquet tables, mapped CSV, JSON records in their several layouts, catalog pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.timeseries import rename_to_canonical, validate
from tidemark.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mapped_csv(spark: SparkSession, path: str, mapping: dict[str, str], pattern: str | None = None, check: bool = True) -> DataFrame:
    """A CSV file under canonical names; with pattern, rows whose source indicator matches it from its beginning."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if pattern is not None:
        source = mapping["indicator_id"]
        if source not in df.columns:
            raise KeyError(source)
        df = df.where(F.col(source).rlike(f"^(?:{pattern})"))
    df = rename_to_canonical(df, mapping)
    return validate(df) if check else df


def json_records(spark: SparkSession, path: str, schema: str | None = None, lines: bool | None = None) -> DataFrame:
    """JSON or JSON Lines; where lines isn't said, the first line decides."""
    if lines is None:
        first = spark.read.text(path).limit(1).collect()
        lines = bool(first) and first[0].value.strip().startswith("{") and first[0].value.strip().endswith("}")
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def json_folder(spark: SparkSession, folder: str, glob: str = "*_dedup.json", schema: str | None = None) -> DataFrame:
    """All matching JSON files under a folder with their paths; unreadable files are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(folder).withColumn("source_file", F.input_file_name())


def records_of_map(payload: Column, value: str) -> Column:
    """An array of values from a JSON text that is an array, or a map of records."""
    return F.coalesce(F.from_json(payload, f"array<{value}>"), F.map_values(F.from_json(payload, f"map<string,{value}>")))


def pages(total: int, size: int) -> list[tuple[int, int]]:
    """(offset, limit) of the requests that fetch total records."""
    return [(k, size) for k in range(0, total, size)]


def fetch(spark: SparkSession, requests: list[tuple[int, int]], get_page, schema: str) -> DataFrame:
    """Records of a paged API, one task a page: get_page(offset, limit) returns rows; a page that fails three times gives no rows
    but an error row in _error."""
    def run(frames):
        for frame in frames:
            for offset, limit in zip(frame["offset"], frame["limit"], strict=True):
                failure = None
                for _ in range(3):
                    try:
                        rows = pd.DataFrame(get_page(int(offset), int(limit)))
                        yield rows.assign(_offset=int(offset), _error=None)
                        failure = None
                        break
                    except OSError as error:
                        failure = str(error)
                if failure is not None:
                    yield pd.DataFrame({"_offset": [int(offset)], "_error": [failure]})

    full = StructType.fromDDL(schema).add("_offset", "long").add("_error", "string")

    def aligned(frames):
        for frame in run(frames):
            yield frame.reindex(columns=full.names)

    asked = spark.createDataFrame(requests, "offset bigint, limit bigint").repartition(max(1, len(requests)))
    return asked.mapInPandas(aligned, full)
