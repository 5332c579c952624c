"""Sources that are read page by page: an offset, a limit, and a mark whether there is more.

A source is a subclass of PagedSource with a name, a schema and page(); Spark reads it in batch and as a stream:

    spark.dataSource.register(JsonPages)
    spark.read.format("json_pages").option("path", folder).option("fields", "id long, title string").load()

How many records there are is not known beforehand. In batch, each of `tasks` tasks reads every tasks-th page until a page says that there is no more, so
at most one page a task is asked for in vain, and no task waits for another. `max_items` ends all of them at that offset. Comparisons of a
column with a value go into the request where the source says that it can filter by the column, with the option push_filters=true in a session with
spark.sql.python.filterPushdown.enabled.

As a stream the offset is kept in Spark's checkpoint. The end is found by doubling and halving over the pages, in a number of requests that grows
with the logarithm of the records; each page up to there is a task of its own. A batch that failed is read again between the same offsets;
with availableNow Spark runs one batch a start, so what came after the failure is in the next one.

A page that fails with an OSError is asked for `tries` times, with growing pauses; then its task fails, and Spark runs it again elsewhere.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Page:
    """Records of a page; next is the offset after its last record (by default the page's offset and as many as it has)."""

    rows: list[dict]
    has_more: bool
    next: int | None = None


@dataclass
class Pages(InputPartition):
    """The pages at first, first + step and so on, before stop."""

    first: int
    step: int
    stop: int | None


class PagedSource(DataSource):
    """Options: page_size (100), tasks (16), tries (3), pause in seconds before the second try (0.1), max_items, and those of the source itself."""

    #: Columns by which the source can filter itself, with the names of the request's parameters.
    filters: dict[str, str] = {}

    def page(self, params: dict[str, str], offset: int, limit: int) -> Page:
        """At most limit records from offset on that meet params."""
        raise NotImplementedError

    def number(self, option: str, default: int) -> int:
        return int(self.options.get(option, default))

    def ask(self, params: dict[str, str], offset: int, limit: int) -> Page:
        """page(), tried again after an OSError."""
        tries = self.number("tries", 3)
        for k in range(tries):
            try:
                return self.page(params, offset, limit)
            except OSError:
                if k == tries - 1:
                    raise
                time.sleep(float(self.options.get("pause", 0.1)) * 2**k)
        raise ValueError("tries must be 1 at least")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("push_filters") == "true" else PagedReader)(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self, schema)


def _rows(source: PagedSource, names: list[str], params: dict[str, str], pages: Pages) -> Iterator[tuple]:
    offset, size = pages.first, source.number("page_size", 100)
    while pages.stop is None or offset < pages.stop:
        got = source.ask(params, offset, size if pages.stop is None else min(size, pages.stop - offset))
        for row in got.rows:
            yield tuple(row.get(c) for c in names)
        if not got.has_more:
            return
        offset += pages.step


class PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource, schema: StructType):
        self.source, self.names, self.params = source, schema.names, {}

    def partitions(self) -> list[Pages]:
        size, tasks = self.source.number("page_size", 100), self.source.number("tasks", 16)
        stop = self.source.number("max_items", -1)
        if stop >= 0:
            tasks = max(1, min(tasks, -(-stop // size)))
        return [Pages(k * size, tasks * size, stop if stop >= 0 else None) for k in range(tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.source, self.names, self.params, partition)


class FilteringReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.source.filters:
                self.params[self.source.filters[f.attribute[0]]] = str(f.value)
            yield f  # a server may understand a filter more loosely, so Spark looks again


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, source: PagedSource, schema: StructType):
        self.source, self.names, self.known = source, schema.names, 0

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        size = self.source.number("page_size", 100)
        ask = lambda k: self.source.ask({}, k * size, size)
        # The last page is the first without more; it is at low or after it, and before or at high.
        low = self.known
        last, high = ask(low), low
        while last.has_more:
            low, high = high + 1, 2 * high + 1
            last = ask(high)
        while low < high:
            middle = (low + high) // 2
            got = ask(middle)
            if got.has_more:
                low = middle + 1
            else:
                last, high = got, middle
        self.known = high
        end = high * size + len(last.rows) if last.next is None else last.next
        stop = self.source.number("max_items", -1)
        return {"offset": min(end, stop) if stop >= 0 else end}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        size = self.source.number("page_size", 100)
        return [Pages(k, size, min(k + size, end["offset"])) for k in range(start["offset"], end["offset"], size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.source, self.names, {}, partition)


class JsonPages(PagedSource):
    """A catalogue kept as JSON lines, written by write_pages(): offsets are values of a whole-number key, and a page is the records of a stretch of keys.

    Options: path, fields (the schema).
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return self.options["fields"]

    def page(self, params: dict[str, str], offset: int, limit: int) -> Page:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_stream(f"{path}/about.json") as file:
            about = json.loads(file.read())
        key, width, rows = about["key"], about["width"], []
        for stretch in range(offset // width, -(-min(offset + limit, about["end"]) // width)):
            for found in files.get_file_info(fs.FileSelector(f"{path}/records/stretch={stretch}", allow_not_found=True)):
                if found.base_name.endswith(".json"):
                    with files.open_input_stream(found.path) as file:
                        rows += [r for r in map(json.loads, file.read().splitlines()) if offset <= r[key] < offset + limit]
        return Page(sorted(rows, key=lambda r: r[key]), offset + limit < about["end"], min(offset + limit, about["end"]))


def write_pages(df, path: str, key: str, width: int = 100) -> None:
    """df as a catalogue that JsonPages reads; key is a column of whole numbers from 0, and a file holds width of its values. Rows without a key are left out."""
    from pyspark.sql import functions as F

    rows = df.where(F.col(key) >= 0)
    rows.withColumn("stretch", F.floor(F.col(key) / width)).repartition("stretch").write.partitionBy("stretch").json(f"{path}/records")
    end = rows.agg(F.coalesce(F.max(key) + 1, F.lit(0)).cast("long").alias("end")).first().end
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about.json")
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(json.dumps({"key": key, "width": width, "end": end}).encode()))
    out.close()
