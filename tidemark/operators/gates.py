"""Gates on pages, names, mentions and reviews: what is kept, and why the rest is not (W1, W2, W3, W7)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_acronym, is_english, is_references_page

#: Parts of words that speak for a dataset, and words of names of institutions.
DATASET_PARTS = "survey census database db registry registries indicator index indices microdata data study studies report map statistics stats profile panel round assessment".split()
INSTITUTIONS = "corp corporation inc llc ltd co company unhcr unicef undp iom bank ministry agency office survey census dataset indicator index world center centre group foundation union organization organisation".split()
#: Spans and relations that meet in a task.
ROWS = 1_000_000


def dense_rows(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows with at least so many values that aren't null among the columns."""
    return df.where(sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) >= least)


def before_references(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """A document's pages up to the first page of references or an appendix in its second half."""
    per = Window.partitionBy(doc)
    half = F.floor(F.count("*").over(per) / 2)
    first = F.min(F.when(is_references_page(F.col(text)) & (F.col("_k") >= half), F.col("_k"))).over(per)
    numbered = df.withColumn("_k", F.row_number().over(per.orderBy(page)) - 1)
    return numbered.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_k") < F.col("_first"))).drop("_k", "_first")


def is_personal_name(name: Column) -> Column:
    """Two or three capitalised words of letters that name no dataset and no institution; brackets don't count."""
    bare = F.trim(F.regexp_replace(name, r"\s*[(\[{].*?[)\]}]\s*", " "))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    capital = F.forall(words, lambda w: w.rlike(r"^\p{Lu}\p{L}*$"))
    dataset = F.lower(name).rlike("|".join(map(re.escape, DATASET_PARTS)))
    return ~dataset & F.size(words).between(2, 3) & capital & ~F.exists(words, lambda w: F.lower(w).isin(*INSTITUTIONS))


def confident(confidence: Column, least: float) -> Column:
    """At least so confident; no confidence counts as certain."""
    return F.coalesce(confidence, F.lit(1.0)) >= least


def is_dataset(*tags: Column) -> Column:
    """Whether none of the tags says that it is none."""
    return ~F.coalesce(F.array_contains(F.array(*tags), "non-dataset"), F.lit(False))


def is_used(usage: Column) -> Column:
    """Whether something is said of the use."""
    return ~F.coalesce(usage, F.lit("")).isin("", "na")


def skip_reason(text: Column, verdict: Column) -> Column:
    """Why a page isn't read: it isn't English, or a classifier's verdict (NO_DATA) says so; null if it is."""
    return F.when(~is_english(text), "non_english").when(verdict == "NO_DATA", "no_data")


def is_self_link(head: Column, tail: Column) -> Column:
    """Whether a relation's tail is empty, its head, or more than half of it."""
    h, t = F.lower(F.trim(head)), F.lower(F.trim(F.coalesce(tail, F.lit(""))))
    return (t == "") | (h == t) | (h.contains(t) & (F.length(t) / F.length(h) > 0.5))


def best_relations(spans: DataFrame, relations: DataFrame, keys: list[str], kind: str = "has_producer") -> DataFrame:
    """For each span (keys, start, end, text) the most confident tail of a kind's relations (keys, kind, head_start, head_end, tail, confidence), itself left out.

    Spans may be given several times. They meet the relations in as many tasks as keep a task's rows of both at ROWS, so a task sorts no more when there are more of them. Both are counted first.
    """
    mine = relations.where(F.col("kind") == kind).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("head_start").alias("_start"), F.col("head_end").alias("_end"), F.col("tail").alias("_tail"), F.col("confidence").alias("_c"))
    at = [*keys, "start", "end"]
    pieces = max(spans.sparkSession.sparkContext.defaultParallelism, -(-(spans.count() + mine.count()) // ROWS))
    told = [F.col(k) == F.col(f"_{k}") for k in at] + [~is_self_link(F.col("text"), F.col("_tail"))]
    found = spans.select(*at, "text").repartition(pieces, *at).distinct().join(mine.repartition(pieces, *[f"_{k}" for k in at]), told, "left")
    return found.groupBy(*at, "text").agg(F.max(F.when(F.col("_tail").isNotNull(), F.struct("_c", "_tail")))["_tail"].alias("tail"))


def candidate_names(df: DataFrame, name: str) -> DataFrame:
    """Names of over two letters that are no numbers, with is_acronym."""
    return df.where((F.length(name) > 2) & ~F.col(name).rlike(r"^\p{N}+$")).withColumn("is_acronym", is_acronym(F.col(name)))


def valid_facets(facets: Column, keys: list[str], ratings: list[str]) -> Column:
    """Known facets with their explainers' ratings, names trimmed; a rating that isn't known raises, a facet without ratings goes."""
    checked = F.transform_values(facets, lambda k, inner: F.transform_values(
        F.map_filter(F.transform_keys(inner, lambda n, r: F.trim(n)), lambda n, r: n != ""),
        lambda n, r: F.when(F.trim(r).isin(*ratings), F.trim(r)).otherwise(F.raise_error(F.concat(F.lit("unknown rating: "), F.coalesce(r, F.lit("null")))).cast("string"))))
    return F.map_filter(F.map_filter(checked, lambda k, inner: k.isin(*keys)), lambda k, inner: F.size(inner) > 0)


def valid_basis(value: Column, allowed: list[str]) -> Column:
    """The basis of a verdict; explicit where none is said, an unknown one raises."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v == "", "explicit").when(v.isin(*allowed), v).otherwise(F.raise_error(F.concat(F.lit("unknown basis: "), v)).cast("string"))


def renders(has_truth: Column, has_found: Column, mode: str) -> Column:
    """Whether a page is shown: with true boxes ('gt'), found ones ('pred'), either ('union') or in any case ('all')."""
    rules = {"gt": has_truth, "pred": has_found, "union": has_truth | has_found, "all": F.lit(True)}
    if mode not in rules:
        raise ValueError(f"mode must be one of {sorted(rules)}")
    return rules[mode]


def entities(*fields: Column) -> Column:
    """The first of several fields (arrays) that isn't empty."""
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in fields], F.slice(fields[0], 1, 0))


def best_entity(found: Column) -> Column:
    """The most confident of an array of entities, the first of equals; no confidence counts as 0."""
    ranked = F.transform(found, lambda e, k: F.struct(F.coalesce(e["confidence"], F.lit(0.0)).alias("c"), (-k).alias("k"), e.alias("e")))
    return F.array_max(ranked)["e"]


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the first column in which a row has nothing."""
    fault = F.coalesce(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no value in {c}")) for c in columns])
    return df.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
