"""Clusters of mentions merged across names and acronyms, and families of names (W2, W3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.harmonize import leaders
from tidemark.operators.mentions import acronym_pairs, fuzzy_pairs, ratio, ratio_pairs
from tidemark.session import cut


def union_set(column: str) -> Column:
    """All values of a group's arrays, once each, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.slice(F.col(column), 1, 0))))))


def merge_clusters(df: DataFrame, group: str, lists: list[str], forms: str = "forms") -> DataFrame:
    """By group one cluster: the name, rank and confidence of the best (lowest rank, longest name, surest), counts and form counts summed, lists united.

    df: name, rank, confidence, count, forms (map of form to count), list columns.
    """
    best = F.max_by(F.struct("name", "rank", "confidence"), F.struct(-F.col("rank"), F.length("name"), F.col("confidence"), F.col("name"))).alias("_b")
    main = df.groupBy(group).agg(best, F.sum("count").alias("count"), F.count("*").alias("n_merged"), *[union_set(c).alias(c) for c in lists])
    each = df.select(group, F.explode(forms).alias("_f", "_n")).groupBy(group, "_f").agg(F.sum("_n").alias("_n"))
    counted = each.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_f", "_n")))).alias(forms))
    return main.join(counted, group, "left").select(group, "_b.*", "count", "n_merged", forms, *lists)


def merge_similar_clusters(df: DataFrame, lists: list[str], forms: str = "forms") -> DataFrame:
    """Clusters whose names are fuzzy duplicates, or one the other's acronym, as one. df: as in merge_clusters(), names distinct."""
    names = cut(df.select("name").distinct())
    either = acronym_pairs(names.select("name", F.col("name").alias("other")), "name", "other")
    edges = fuzzy_pairs(names, "name").unionByName(either.select(F.col("short").alias("a"), F.col("long").alias("b")).where("a <> b"))
    found = components(edges)
    placed = df.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("cluster", F.coalesce("component", "name")).drop("component")
    return merge_clusters(placed, "cluster", lists, forms)


def acronym_map(df: DataFrame, base: str, acronym: str) -> DataFrame:
    """By base name its acronyms, trimmed, once each, in order; names without any are left out."""
    return df.where(F.trim(acronym) != "").groupBy(base).agg(F.array_sort(F.collect_set(F.trim(acronym))).alias("acronyms"))


def boost_acronyms(pairs: DataFrame, acronyms: DataFrame, base: str, least: float = 0.95) -> DataFrame:
    """Pairs (a, b, similarity) with at least so much where both names share an acronym, such pairs added."""
    each = acronyms.select(F.col(base).alias("name"), F.explode("acronyms").alias("acronym"))
    other = each.toDF("b", "acronym")
    shared = each.toDF("a", "acronym").join(other, "acronym").where("a < b").select("a", "b", F.lit(least).alias("similarity"))
    return pairs.select("a", "b", "similarity").unionByName(shared).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def absorb_acronyms(df: DataFrame, key: str, name: str, acronym: str) -> DataFrame:
    """Rows (key, into): in the order of keys a family with an acronym takes in the later ones whose name holds it; who was taken in takes none.

    Names meet acronyms by their parts of the acronyms' lengths, so nothing is compared that can't hold.
    """
    defined = df.where(F.trim(acronym) != "").select(F.col(key).alias("v"), F.lower(F.trim(acronym)).alias("part"))
    lengths = sorted(r.n for r in defined.select(F.length("part").alias("n")).distinct().collect())
    text = F.lower(F.col(name))

    def parts_of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.concat(*map(parts_of, lengths))) if lengths else F.array().cast("array<string>")
    pairs = df.select(F.col(key).alias("u"), F.explode(parts).alias("part")).join(defined, "part").where("v < u").select(F.col("v").alias("a"), F.col("u").alias("b")).distinct()
    nodes = df.select(F.lit(1).alias("block"), F.col(key).alias("node"), (-F.col(key)).alias("order"))
    return leaders(nodes, pairs, "block", "node", "order").select(F.col("node").alias(key), F.col("leader").alias("into"))


def is_acronym_variant(word: Column, acronym: Column) -> Column:
    """The acronym itself, with an ending, or as a word of its own."""
    w, a = F.lower(word), F.lower(acronym)
    return w.startswith(a) | F.rlike(w, F.concat(F.lit(r"\b\Q"), a, F.lit(r"\E\b")))


def family_keys(families: DataFrame, least: float = 85.0) -> DataFrame:
    """Rows (key, canonical): each family's base name, its variants that are an acronym's or alike enough, and its acronym; of equal keys that of the last family.

    families: ord, name, base, acronym, variants (array).
    """

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    short = F.nullif(F.trim(F.coalesce("acronym", F.lit(""))), F.lit(""))
    named = families.withColumns({"_s": short, "canonical": F.when(short.isNotNull(), F.concat("name", F.lit(" ("), "acronym", F.lit(")"))).otherwise(F.col("name"))})
    variants = named.select("ord", F.explode(F.array_distinct("variants")).alias("key"), "base", "_s", "canonical").where(F.coalesce(is_acronym_variant(F.col("key"), F.col("_s")), F.lit(False)) | (alike("key", "base") >= least))
    every = named.select("ord", F.lit(0).alias("k"), F.col("base").alias("key"), "canonical").unionByName(variants.select("ord", F.lit(1).alias("k"), "key", "canonical")).unionByName(named.where("_s IS NOT NULL").select("ord", F.lit(2).alias("k"), F.lower("_s").alias("key"), "canonical"))
    return every.groupBy("key").agg(F.max_by("canonical", F.struct("ord", "k")).alias("canonical"))


def consolidate(families: DataFrame, keys: DataFrame, least: float = 85.0) -> DataFrame:
    """Families of equal target as one: by key, else by the most alike key with a ratio of at least least, else their own name; aliases united.

    families: name, base, aliases (array).
    """
    known = cut(keys.select("key", F.col("canonical").alias("target")))
    exact = cut(families.join(known, F.col("base") == F.col("key"), "left").drop("key"))
    open_names = exact.where("target IS NULL").select("base").distinct()
    pairs = ratio_pairs(open_names.select(F.col("base").alias("n")).union(known.select("key")).distinct(), "n", least)
    both = pairs.select("a", "b", "ratio").union(pairs.select("b", "a", "ratio"))
    near = both.join(open_names, F.col("a") == F.col("base")).join(known, F.col("b") == F.col("key")).groupBy("base").agg(F.max_by("target", F.struct("ratio", "key")).alias("near"))
    placed = exact.join(near, "base", "left").withColumn("target", F.coalesce("target", "near", "name"))
    return placed.groupBy("target").agg(union_set("aliases").alias("aliases"), F.count("*").alias("n_families"))
