"""Detection evaluation: boxes, greedy matching, precision and recall by label (W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import area, iou, overlap
from tidemark.session import cut


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def iou_pairs(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Pairs of boxes (g, p) of equal keys that overlap enough; truth and found: keys, id, box."""
    g, p = truth.select(*keys, F.col("id").alias("g"), F.col("box").alias("gb")), found.select(*keys, F.col("id").alias("p"), F.col("box").alias("pb"))
    return g.join(p, keys).withColumn("iou", iou(F.col("pb"), F.col("gb"))).where(F.col("iou") >= least)


def greedy_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches: the highest overlap first, ties by found then true box."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "p", "g", "pb", "gb")))
    taken = lambda kept, m: F.exists(kept, lambda x: (x["p"] == m["p"]) | (x["g"] == m["g"]))
    kept = F.aggregate("x", F.slice("x", 1, 0), lambda acc, m: F.when(taken(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
    return pairs.groupBy(*keys).agg(listed.alias("x")).select(*keys, F.explode(kept).alias("m")).select(*keys, "m.p", "m.g", "m.pb", "m.gb", (-F.col("m.k")).alias("iou"))


def evaluate(truth: DataFrame, found: DataFrame, page: str, label: str, thresholds: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """By threshold and label, and over all labels (label 'all'): matches, precision, recall, mean overlap, coverage and purity; null where nothing is to divide by."""
    out = None
    pairs = cut(iou_pairs(truth, found, [page, label], min(thresholds)))  # once, for the least threshold
    for t in thresholds:
        m = greedy_match(pairs.where(F.col("iou") >= t), [page, label])
        sums = m.groupBy(label).agg(F.count("*").alias("tp"), F.sum("iou").alias("i"), F.sum(overlap(F.col("pb"), F.col("gb")) / area(F.col("gb"))).alias("c"), F.sum(overlap(F.col("pb"), F.col("gb")) / area(F.col("pb"))).alias("u"))
        totals = truth.groupBy(label).agg(F.count("*").alias("n_true")).join(found.groupBy(label).agg(F.count("*").alias("n_found")), label, "full_outer").join(sums, label, "left").na.fill(0)
        names = ["n_true", "n_found", "tp", "i", "c", "u"]
        both = totals.groupBy(label).agg(*[F.sum(c).alias(c) for c in names]).unionByName(totals.agg(F.lit("all").alias(label), *[F.sum(c).alias(c) for c in names]))
        share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
        one = both.select(F.lit(t).alias("threshold"), label, "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), share("tp", "n_found").alias("precision"), share("tp", "n_true").alias("recall"), share("i", "tp").alias("mean_iou"), share("c", "tp").alias("coverage"), share("u", "tp").alias("purity"))
        out = one if out is None else out.unionByName(one)
    return out


def filter_small(objects: Column, least: float = 0.008) -> Column:
    """Objects whose box has at least an area; pages keep their (perhaps empty) list."""
    return F.filter(objects, lambda o: area(o["box"]) >= least)
