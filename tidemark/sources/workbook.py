"""Workbooks (.xlsx) read in tasks: a file a task at a time, its sheets' rows as a stream of batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import ship

#: The number formats of dates and times that have no text of their own, and the day on which counting starts (and in files of the other system).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
ROWS = 1_000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str) -> list:
    return [c for c in node.iter() if _local(c.tag) == name]


def _text(node) -> str:
    """The text of a string item, its runs joined, without phonetic ones."""
    out = []
    for child in node:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _rows_of(part, name: str) -> Iterator:
    """The elements of a name one by one; what was read is dropped at once."""
    above = []
    for event, node in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if _local(node.tag) == name:
            yield node
            if above:
                above[-1].remove(node)


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _is_date(code: str) -> bool:
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|general', "", code.lower())))


class _Book:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        tree = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = []
        for s in _children(tree, "sheet"):
            target = targets[next(v for k, v in s.items() if _local(k) == "id" and k != "id")]
            self.sheets.append((s.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
        self.zero = DAY_ZERO_1904 if any(p.get("date1904") in ("1", "true") for p in _children(tree, "workbookPr")) else DAY_ZERO
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as part:
                self.strings = [_text(s) for s in _rows_of(part, "si")]
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in _children(styles, "numFmt")}
            used = [int(x.get("numFmtId", 0)) for group in _children(styles, "cellXfs") for x in group]
            self.dates = {i for i, f in enumerate(used) if (_is_date(own[f]) if f in own else f in DATE_FORMATS)}

    def value(self, cell) -> str | None:
        kind, found = cell.get("t", "n"), {_local(c.tag): c for c in cell}
        if kind == "inlineStr":
            return _text(found["is"]) if "is" in found else None
        text = found["v"].text if "v" in found else None
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return "true" if text == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            when = self.zero + timedelta(seconds=round(float(text) * 86_400))
            return when.strftime("%Y-%m-%d") if float(text) == int(float(text)) else when.strftime("%Y-%m-%d %H:%M:%S")
        return text

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """Numbers of rows and their cells; rows without any value are left out, and cells that aren't there are null."""
        with self.zip.open(part) as file:
            before = 0
            for row in _rows_of(file, "row"):
                before = int(row.get("r", before + 1))
                cells: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [self.value(cell)]
                while cells and cells[-1] is None:
                    cells.pop()
                if cells:
                    yield before, cells


def _read(spark: SparkSession, path: str | list[str], sheet: str | None, names: list[str] | None) -> DataFrame:
    ship(spark)
    fields = [("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), *([("cells", pa.list_(pa.string()))] if names is None else [(f"c{i}", pa.string()) for i in range(len(names))])]
    layout = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    book = _Book(content.as_py())
                    for title, part in book.sheets:
                        if sheet is not None and title != sheet:
                            continue
                        head, out = None, []
                        for number, cells in book.rows(part):
                            if names is None:
                                out.append((file, title, number, cells))
                            elif head is None:
                                places = {c.strip(): i for i, c in reversed(list(enumerate(cells))) if c}
                                head = [places.get(n) for n in names]
                            else:
                                out.append((file, title, number, *[cells[i] if i is not None and i < len(cells) else None for i in head]))
                            if len(out) >= ROWS:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), layout.types)], schema=layout)
                                out = []
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), layout.types)], schema=layout)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as fault:
                    raise ValueError(f"not a workbook: {file}") from fault

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ddl = "file string, sheet string, row int, " + ("cells array<string>" if names is None else ", ".join(f"c{i} string" for i in range(len(names))))
    return files.mapInArrow(run, ddl)


def workbook_rows(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """Rows (file, sheet, row, cells) of all workbooks at path, or of their sheet of that name; cells are texts from column A on.

    Numbers are as they are written, dates ISO texts by their format, truth values true or false, formulas what they gave last, faults and
    missing cells null; trailing nulls and rows without values are left out. A task reads a file whole (Spark's limit is 2 GB) and holds its shared texts, but one
    row of cells at a time; files are dealt to tasks. A file that is no workbook raises.
    """
    return _read(spark, path, sheet, None)


def workbook(spark: SparkSession, path: str | list[str], schema: StructType | str, sheet: str | None = None) -> DataFrame:
    """A sheet, or all sheets, of the workbooks at path as a table of the schema, with file, sheet and row before.

    The first row with values names the columns, in each sheet for itself and in any order (of two equal names the first); a column of the schema that isn't
    there is null, as is a value that its type doesn't take. Other columns aren't read into rows.
    """
    layout = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = _read(spark, path, sheet, layout.names)
    return out.select("file", "sheet", "row", *[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(layout)])
