"""How five filters of documents interact: what each removes at every place of every order, alone, and on average.

Filters (words are maximal runs without white space, case-sensitive):

    A  under 50 words
    B  100 * distinct words < 65 * words
    C  100 * capitals A-Z > 5 * code points
    D  any of # $ % & * |
    E  the text is that of a document with a smaller id, removed or not

A to D are told from the text by Spark's expressions. E is an existential self-join: a left-semi join on hash, exact text and smaller id.
Its right side has one row for each text that several rows have (summed in the tasks before the shuffle), and a hash of more than 1/SHARES of all rows
is dealt to as many pieces, so a group of copies of any size is spread and never paired with itself. The ids that fail E are then united with the
others' failures and come together as bits; all counts follow from how many rows of a part have which bits.

Null texts are empty texts, null sources the part ''. A row without an id never fails E and makes no other row fail it; rows with the same id don't
either, as neither id is smaller. Repeated rows count as often as they stand there. Of several label rows of an id one with 1 is enough. An empty table
has no parts. Other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
#: A hash of more than this share of the rows is dealt to several tasks; so at most as many hashes are broadcast.
SHARES = 512
SPACE = r"[\x20\x09-\x0D]+"
SAME = ["doc_id", "part", "h", "n"]


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h, n, mask): bits of the filters A to D, which a text (column x) fails by itself."""
    split = docs.withColumn("w", F.array_remove(F.split("x", SPACE), ""))
    fails = (
        F.size("w") < 50,
        100 * F.size(F.array_distinct("w")) < 65 * F.size("w"),
        100 * F.regexp_count("x", F.lit("[A-Z]")).cast("long") > 5 * F.length("x").cast("long"),
        F.col("x").rlike("[#$%&*|]"),
    )
    return split.select(*SAME, sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).alias("mask"))


def later_copies(docs: DataFrame, shares: int = SHARES) -> DataFrame:
    """Rows (doc_id, part, h, n) whose text a smaller id has too."""
    told = docs.where(F.col("doc_id").isNotNull())
    firsts = staged(told.groupBy("h", "x").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select(F.col("h").alias("rh"), F.col("x").alias("rx"), "least", "rows"))
    share = max(1.0, docs.count() / shares)
    hot = F.broadcast(firsts.where(F.col("rows") > share).groupBy(F.col("rh").alias("hh")).agg(F.ceil(F.sum("rows") / share).cast("int").alias("pieces")))
    left = told.join(hot, F.col("h") == F.col("hh"), "left").withColumn("piece", F.coalesce(F.pmod(F.hash("doc_id"), F.col("pieces")), F.lit(0)))
    right = firsts.join(hot, F.col("rh") == F.col("hh"), "left").select("rh", "rx", "least", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("rp"))
    exists = (F.col("h") == F.col("rh")) & (F.col("piece") == F.col("rp")) & (F.col("x") == F.col("rx")) & (F.col("least") < F.col("doc_id"))
    return left.join(right, exists, "left_semi").select(*SAME)


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", shares: int = SHARES) -> DataFrame:
    """(doc_id, part, mask, rows): the filters a document fails, as bits with A lowest; rows of equal id, part and text count together."""
    text = F.coalesce(text_col, F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("x"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    own, copies = own_failures(docs), later_copies(docs, shares)
    both = own.withColumn("one", F.lit(1)).unionByName(copies.withColumns({"mask": F.lit(16), "one": F.lit(0)}))
    return both.groupBy(*SAME).agg(F.bit_or("mask").alias("mask"), F.sum("one").alias("rows")).select("doc_id", "part", "mask", "rows")


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): how many rows of a part fail exactly these filters, and how many of them have the labels."""
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    joined = failed.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    count = lambda c: F.sum(F.col("rows") * F.coalesce(c, F.lit(0)))
    return joined.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), count("q").alias("good"), count("t").alias("toxic"))


def audit(df: DataFrame, labels: DataFrame, shares: int = SHARES, **columns) -> DataFrame:
    """Per part, order and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counted = combinations(failures(df, shares=shares, **columns), labels)
    # A part has at most 32 combinations, and each of them 600 places in the orders.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("c"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))

    def bit(place: Column | int) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(LETTERS), F.substring("filter_order", F.lit(place) if isinstance(place, int) else place, F.lit(1))) - 1)

    before = sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(LETTERS))), F.lit(0))
    placed = steps.withColumns({"own": bit(F.col("step")), "before": before})
    fails, gone = lambda m: m["mask"].bitwiseAND(F.col("own")) != 0, lambda m: m["mask"].bitwiseAND(F.col("before")) != 0

    def total(which, value=lambda m: m["rows"]) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda s, m: s + F.when(which(m), value(m)).otherwise(F.lit(0).cast("long")))

    removed = lambda m: fails(m) & ~gone(m)
    return placed.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # A filter comes first among the k that a document fails in 120 / k orders.
        total(fails, lambda m: m["rows"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(m["mask"]))).alias("shapley"),
    )


#: DuckDB SQL of the audit.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (q) AS good, count(*) FILTER (t) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY 1, 2),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM a, a b, a c, a d, a e WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
  list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
j AS (SELECT part, filter_order, step, n, good, toxic, mask, own, mask & own <> 0 AS fails, mask & coalesce(before, 0)::INT <> 0 AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
