"""Annotated pages: rectangles of an annotation tool, pages by document, predictions, mismatches (W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least extent that a rectangle gets.
LEAST = 1e-9
TASK = "struct<file:string,page:int,updated:string,results:array<struct<id:string,label:string,x:double,y:double,width:double,height:double>>>"


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def rect_to_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A rectangle in per cent as (x1, y1, x2, y2) in 0..1, never empty."""
    x1, y1, x2, y2 = _unit(x / 100), _unit(y / 100), _unit(x / 100 + width / 100), _unit(y / 100 + height / 100)
    far = lambda a, b: F.when(b <= a, _unit(a + LEAST)).otherwise(b)
    return F.array(x1, y1, far(x1, x2), far(y1, y2))


def box_to_rect(box: Column) -> Column:
    """The rectangle in per cent of a box in 0..1."""
    return F.struct((box[0] * 100).alias("x"), (box[1] * 100).alias("y"), ((box[2] - box[0]) * 100).alias("width"), ((box[3] - box[1]) * 100).alias("height"))


def pages_of_tasks(tasks: DataFrame, task: str) -> DataFrame:
    """Rows (doc_id, page, objects) from annotation tasks as JSON: the newest task of a page; pages without rectangles go."""
    t = tasks.select(F.from_json(task, TASK).alias("t")).select(F.col("t.file").alias("doc_id"), "t.page", "t.updated", "t.results")
    newest = t.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("updated").desc_nulls_last()))).where("_k = 1")
    objects = F.transform("results", lambda r: F.struct(r["id"].alias("id"), r["label"].alias("label"), rect_to_box(r["x"], r["y"], r["width"], r["height"]).alias("box")))
    return newest.where(F.size("results") > 0).select("doc_id", "page", objects.alias("objects"))


def tasks_of_pages(pages: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, page, task): a page's predictions as an annotation task's JSON."""
    results = F.transform("objects", lambda o: F.struct(o["id"].alias("id"), F.lit("rectanglelabels").alias("type"), F.struct(box_to_rect(o["box"]).alias("rect"), F.array(o["label"]).alias("rectanglelabels")).alias("value")))
    return pages.select("doc_id", "page", F.to_json(F.struct(F.struct(F.col("doc_id").alias("file"), "page").alias("meta"), F.array(F.struct(F.lit(model).alias("model_version"), results.alias("result"))).alias("predictions"))).alias("task"))


def with_label(objects: Column, label: str) -> Column:
    """The objects of a label; pages without any keep an empty list."""
    return F.filter(objects, lambda o: o["label"] == label)


def by_document(pages: DataFrame, order: str) -> DataFrame:
    """By document a map from page to objects; of several rows for a page the last by order."""
    last = pages.groupBy("doc_id", "page").agg(F.max_by("objects", order).alias("objects"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "objects")))).alias("pages"))


def annotations_by_document(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document with its pages in order, none as an empty list: one file each with write.partitionBy('doc_id')."""
    listed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "objects"))).alias("pages"))
    return documents.join(listed, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(listed.schema["pages"].dataType)))


def mismatches(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: (key, side)."""
    a, b = truth.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("truth")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("found")))


def prediction_objects(pages: DataFrame, left_out: DataFrame, score: str = "score") -> DataFrame:
    """A row for each object of the pages whose document isn't left out."""
    kept = pages.join(left_out.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select("doc_id", "page", F.explode("objects").alias("o")).select("doc_id", "page", "o.*")


def first_documents(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The documents of both lists, of equal keys the first list's."""
    both = a.select("*", F.lit(0).alias("_s")).unionByName(b.select("*", F.lit(1).alias("_s")))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_s", *[c for c in a.columns if c != key]))).where("_k = 1").drop("_s", "_k")


def table_or_figure(label: Column, names: dict[str, str]) -> Column:
    """Figure or Table for a detector's label, by itself or by a lower-case name; null for any other."""
    text = F.trim(label)
    return F.when(text.isin("Figure", "Table"), text).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(text)))


def page_groups(pages: DataFrame, doc: str, page: str, size: int) -> DataFrame:
    """Pages of a document in groups of so many, as group."""
    return pages.withColumn("group", F.floor((F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1) / size))
