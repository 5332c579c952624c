"""Small things records need: keys, lists of one, leaf values, dates in place, mentions in records, merged pages, reduced vectors (W2, W4, W6, W7)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, flexible_date
from tidemark.functions.vectors import l2_normalize
from tidemark.operators.curation import with_chunks
from tidemark.operators.metadata import path

TEXT = "struct<text:string,start:int,`end`:int,confidence:double>"
ENTRY = f"struct<mention_name:{TEXT},dataset_name:string,start:int,`end`:int,specificity_tag:string,dataset_tag:string,label:string,confidence:double,score:double,acronym:string,is_used:string>"


def short_id(text: Column) -> Column:
    """Eight hexadecimal digits that name a prompt."""
    return F.substring(F.md5(text), 1, 8)


def memo_key(query: Column, record: Column, model: Column) -> Column:
    """The key under which a judge's verdict is kept."""
    return F.sha1(F.concat_ws("\0", query, record, model))


def collection_name(model: str, kind: str | None = None) -> str:
    """A stable name for a model's vectors of a kind of records."""
    return "__".join([model.replace("/", "__"), *([kind] if kind else [])])


def as_list(value: Column) -> Column:
    """A score as a list; nothing as a list of 0."""
    return F.array(F.coalesce(value.cast("double"), F.lit(0.0)))


def indexed(values: Column, field: str) -> Column:
    """A field of each struct in a map from number to struct, in the order of the numbers."""
    return F.transform(F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"][field].alias("v")))), lambda x: x["v"])


def joined_fields(values: Column, cap: int) -> Column:
    """A list's distinct values in their order, joined and cut."""
    return F.substring(F.array_join(F.array_distinct(F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != "")), ", "), 1, cap)


def leaf_values(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows (key, value): each distinct value in a JSON record, texts cut at commas and squeezed, empty ones left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, found = [], []
            for k, record in zip(frame[key], frame[payload], strict=True):
                todo, seen = [json.loads(record)] if record else [], set()
                while todo:
                    node = todo.pop()
                    if isinstance(node, (dict, list)):
                        todo += node.values() if isinstance(node, dict) else node
                    elif node is not None:
                        text = str(node).lower() if isinstance(node, bool) else str(node)
                        seen.update(v for v in (" ".join(x.split()) for x in text.split(",")) if v)
                keys += [k] * len(seen)
                found += sorted(seen)
            yield pd.DataFrame({key: keys, "value": found})

    src = df.select(key, payload)
    return src.mapInPandas(run, f"`{key}` {src.schema[0].dataType.simpleString()}, value string")


def iso_dates(payload: Column, paths: list[str]) -> Column:
    """A map from dotted path to ISO date for the dates that a record has there; what can't be read stays as it is."""
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.coalesce(F.date_format(flexible_date(path(payload, p)), "yyyy-MM-dd"), path(payload, p)).alias("d")) for p in paths])
    return F.map_from_entries(F.filter(entries, lambda e: e["d"].isNotNull()))


def with_provenance(provenance: Column, idno: Column, day: Column) -> Column:
    """A record's provenance (array of harvest_date, altered, namespace, identifier) marked as extracted: its first entry, or a new one."""
    entry = lambda harvested, i: F.struct(F.coalesce(F.nullif(harvested, F.lit("")), day).alias("harvest_date"), F.lit(True).alias("altered"), F.lit("AI_EXTRACTED").alias("namespace"), i.alias("identifier"))
    new = F.array(entry(F.lit(None).cast("string"), F.coalesce(idno, F.lit("unknown"))))
    return F.when(F.coalesce(F.size(provenance), F.lit(0)) < 1, new).otherwise(F.transform(provenance, lambda p, k: F.when(k == 0, entry(p["harvest_date"], p["identifier"])).otherwise(F.struct(p["harvest_date"].alias("harvest_date"), p["altered"].alias("altered"), p["namespace"].alias("namespace"), p["identifier"].alias("identifier")))))


def mentions(df: DataFrame, keys: list[str], datasets: str) -> DataFrame:
    """Rows (keys, text, start, end, confidence, tag, acronym) of the mentions in JSON records: a list or a single one, newer field names before older ones."""
    raw = F.col(datasets)
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, f"array<{ENTRY}>")).otherwise(F.array(F.from_json(raw, ENTRY)))
    e = df.select(*keys, F.explode(listed).alias("e"))
    name = F.col("e.mention_name")
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(f"e.{c}"), F.lit("")) for c in cs], F.lit(""))
    made = e.select(*keys, clean_text(F.coalesce(name["text"], F.col("e.dataset_name"))).alias("text"), F.coalesce(name["start"], F.col("e.start")).alias("start"), F.coalesce(name["end"], F.col("e.end")).alias("end"), F.coalesce(name["confidence"], F.col("e.confidence"), F.col("e.score"), F.lit(0.0)).alias("confidence"), first("specificity_tag", "dataset_tag", "label").alias("tag"), F.col("e.acronym").alias("acronym"))
    return made.where("text <> ''")


def for_harmonization(df: DataFrame, named_only: bool = True) -> DataFrame:
    """Mentions (text, tag, acronym) counted by text and tag as (text, label, count, acronym); only named ones unless told otherwise."""
    kept = df.where(F.col("tag") == "named") if named_only else df
    return kept.groupBy("text", F.col("tag").alias("label")).agg(F.count("*").alias("count"), F.min(F.nullif("acronym", F.lit(""))).alias("acronym"))


def shifted(spans: Column, offset: Column) -> Column:
    """Spans (array of text, start, end) of a chunk as spans of its document."""
    return F.transform(spans, lambda s: F.struct(s["text"].alias("text"), (s["start"] + offset).alias("start"), (s["end"] + offset).alias("end")))


def merged_chunks(pages: DataFrame, doc: str, page: str, text: str, meta: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """A document's pages joined by empty lines and cut into chunks; each has the first page's meta."""
    whole = pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda p: p[text]), "\n\n").alias("text"), F.min_by(meta, page).alias(meta))
    return with_chunks(whole, "text", size, overlap)


def reduced(items: DataFrame, id_col: str, vec_col: str, dims: int = 64, above: int = 150) -> DataFrame:
    """Rows (id_col, v): unit vectors on their dims strongest directions, made unit again; as they are up to above rows or dims numbers.

    The directions come from the sum of the vectors' products, a square of the vectors' length that Spark adds up, whatever the number of rows.
    """
    unit = items.select(id_col, l2_normalize(F.col(vec_col)).alias("v"))
    size = unit.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size.n or size.n <= above or size.d <= dims:
        return unit
    d = size.d

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = np.asarray(batch[0].flatten(), float).reshape(-1, d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["k", "x"])

    rows = unit.select("v").mapInArrow(products, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(d * d)
    gram[rows.column("k").to_numpy()] = rows.column("x").to_numpy()
    top = np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1][:, :dims]
    top *= np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])  # signs are free: the largest number is positive
    shared = items.sparkSession.sparkContext.broadcast(top)
    kind = unit.schema[0].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch[1].flatten(), float).reshape(-1, d) @ shared.value
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch[0], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], [id_col, "v"])

    return unit.mapInArrow(project, f"`{id_col}` {kind}, v array<double>")


def highlights(payload: Column) -> Column:
    """Records of a highlights file as JSON texts: a list of them, or the values of a map."""
    listed = F.filter(F.from_json(payload, "array<string>"), lambda r: F.trim(r).startswith("{"))
    return F.when(F.trim(payload).startswith("["), listed).otherwise(F.map_values(F.from_json(payload, "map<string,string>")))


def recent(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by an order: a feature of the start page."""
    return df.orderBy(F.col(order).desc()).limit(n)


def folders(files: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct folders of a name in which files (paths) lie."""
    return files.select(F.regexp_extract(column, rf"^(.*/{name})/[^/]+$", 1).alias("folder")).where("folder <> ''").distinct()
