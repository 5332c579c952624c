"""Paragraphs of marked-up pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructType

#: Elements at whose beginning or end an open paragraph ends (fixed values).
BLOCKS = frozenset("p div ul ol li dl table tr td th h1 h2 h3 h4 h5 h6 article section main header footer nav aside form blockquote pre hr body html address figure fieldset".split())

#: Bytes of paragraphs that go back to Spark at once.
PIECE = 1 << 20


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.open: list[str] | None = None

    def end(self) -> None:
        text = " ".join("".join(self.open or ()).split())
        if text:
            self.found.append(text)
        self.open = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end()
            self.open = [] if tag == "p" else None
        elif tag == "br" and self.open is not None:
            self.open.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end()

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open.append(data)


def paragraphs(html: str | None) -> list[str]:
    """The texts of a page's p elements, inline elements and all, references decoded, white space as single spaces."""
    reader = _Paragraphs()
    reader.feed(html or "")
    reader.close()
    reader.end()
    return reader.found


def with_paragraphs(pages: DataFrame, html: str, to: str) -> DataFrame:
    """pages with their paragraphs in place of their html. A task holds one page's parts and PIECE bytes of paragraphs at once."""
    others = [c for c in pages.columns if c != html]
    schema = StructType([pages.schema[c] for c in others]).add(to, ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = batch.column(batch.num_columns - 1), batch.select(others)
            first, found, held = 0, [], 0
            for i in range(batch.num_rows):
                found.append(paragraphs(texts[i].as_py()))
                held += sum(map(len, found[-1])) + 100
                if held >= PIECE or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*rest.slice(first, len(found)).columns, pa.array(found, pa.list_(pa.string()))], [*others, to])
                    first, found, held = i + 1, [], 0

    return pages.select(*others, html).mapInArrow(run, schema)
