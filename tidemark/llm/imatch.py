"""I-Match fingerprints with Spark expressions only.

Terms are runs of letters and digits in lower case. The lexicon holds the terms whose inverse document frequency lies in a
band; it is cut into randomised subsets by a hash of the term, at three sampling rates with SLOTS subsets each, so that short and
long documents both have subsets with few terms. The sorted distinct terms that a document has in a subset are hashed; its
fingerprint is the list of its subsets with their hashes. A document of up to FEW distinct terms adds subsets of all its terms but those too common for
the lexicon, as it may have hardly any of the lexicon's. A document with terms but none in any subset has the hash of all its terms.

A term that a share of at least COMMON[0] of the documents has is in the lexicon or too common for it: as the shares of all terms sum to the mean number of distinct
terms in a document, these are at most that mean / COMMON[0] terms whatever the corpus size, and can be broadcast.

Null texts count as empty and have an empty fingerprint, as has any text without terms; a null id comes before all others.
Each row gives one row; rows with equal id and text are one document in the order of ids; texts under one id are ordered by their hash. The document after the last is
the first; a lone document is its own next. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, staged

#: Share of the documents that have a lexicon term: at least and at most.
COMMON = (0.0005, 0.05)
#: Subsets at each rate, and by rate, one of how many terms is taken.
SLOTS, RATES = 32, (1, 6, 36)
#: Hexadecimal digits of a subset's hash in a fingerprint.
DIGITS = 6
#: Distinct terms of a short document, at most; its subsets of all terms come after the lexicon's.
FEW = 128
#: Subsets in use from which a rate other than the first counts in a comparison.
ENOUGH = 8
#: Rows in a range of ids, about.
RANGE = 200_000
#: The lexicon is broadcast up to so many terms (its bound for documents of up to 1,000 distinct terms in the mean).
BROADCAST = 2_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexicon(docs: DataFrame, text_col: str = "text", common: tuple[float, float] = COMMON) -> DataFrame:
    """Rows (h, band): hashes of the terms in the band (true) and of those more common (false), from the document frequencies over all of docs."""
    each = docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    counts = each.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n"))
    total = docs.count()
    return cut(counts.where(F.col("n") >= common[0] * total).select("h", (F.col("n") <= max(2.0, common[1] * total)).alias("band")))


def fingerprints(rows: DataFrame, lexicon: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Rows (keys, fingerprint), one for each distinct keys of rows."""
    small = lexicon.count() <= BROADCAST
    none = F.xxhash64(F.lit(""))
    found = rows.select(*keys, F.array_distinct(terms(F.col(text_col))).alias("a")).withColumns({"whole": F.when(F.size("a") > 0, F.xxhash64("a")), "few": F.size("a") <= FEW})
    # The empty term stands in every row, so that no row is lost.
    each = found.select(*keys, "whole", "few", F.explode(F.array_append("a", F.lit(""))).alias("term")).select(*keys, "whole", "few", F.xxhash64("term").alias("h"))
    each = each.join(F.broadcast(lexicon) if small else lexicon, "h", "left").where(F.coalesce("band", F.col("few")) | (F.col("h") == none))
    # Each rate takes its terms by one part of a second hash, and cuts them into subsets by another.
    mixed = F.xxhash64("h", F.lit(1))
    one, two, three, whole = (k * SLOTS + F.pmod(mixed, F.lit(SLOTS)).cast("int") for k in range(4))
    taken = [F.pmod(F.shiftright(mixed, 8), F.lit(rate)) == 0 for rate in RATES]
    of_band = F.when(taken[2], F.array(one, two, three)).when(taken[1], F.array(one, two)).otherwise(F.array(one))
    slots = F.when(F.col("h") == none, F.array(F.lit(-1))).otherwise(F.concat(F.when(F.col("band"), of_band).otherwise(F.slice(of_band, 1, 0)), F.when(F.col("few"), F.array(whole)).otherwise(F.slice(of_band, 1, 0))))
    # The row of the empty term carries the hash of all terms.
    each = each.select(*keys, F.when(F.col("h") == none, F.col("whole")).otherwise(F.col("h")).alias("h"), F.explode(slots).alias("slot"))
    hashed = each.groupBy(*keys, "slot").agg(F.array_distinct(F.array_sort(F.collect_list("h"))).alias("x")).select(*keys, "slot", F.when(F.size("x") > 0, F.xxhash64("x")).alias("value"))
    part = F.when(F.col("slot") >= 0, F.concat(F.lpad(F.hex("slot"), 2, "0"), F.substring(F.hex("value"), -DIGITS, DIGITS)))
    joined = hashed.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("p"), F.max(F.when(F.col("slot") < 0, F.col("value"))).alias("whole"))
    alone = F.coalesce(F.concat(F.lit("zz"), F.hex("whole")), F.lit(""))
    return joined.select(*keys, F.lower(F.when(F.size("p") > 0, F.array_join("p", ".")).otherwise(alone)).alias("fingerprint"))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal subsets among those in use, at the rate (or among all terms) where it is highest; 1 for equal fingerprints, from 0 to 1."""
    a, b = F.split(one, r"\."), F.split(other, r"\.")
    best = []
    for k in range(len(RATES) + 1):
        low, high = f"{k * SLOTS:02x}", f"{k * SLOTS + SLOTS - 1:02x}~"
        at_rate = lambda x, low=low, high=high: F.filter(x, lambda p: p.between(low, high))
        mine, its = at_rate(a), at_rate(b)
        used = F.size(F.array_union(F.transform(mine, lambda p: F.substring(p, 1, 2)), F.transform(its, lambda p: F.substring(p, 1, 2))))
        best.append(F.when(used >= (1 if k in (0, len(RATES)) else ENOUGH), F.size(F.array_intersect(mine, its)) / used).otherwise(0.0))
    return F.when(one == other, 1.0).otherwise(F.coalesce(F.greatest(*best), F.lit(0.0)))


def _successors(ids: DataFrame, per_range: int) -> DataFrame:
    """ids (d, v, n) with the next document's nd, nv: a window within ranges of ids, and the ranges' first rows."""
    ranges = max(1, ids.count() // per_range)
    ids = staged(ids.repartitionByRange(ranges, "d", "v").withColumn("range", F.spark_partition_id()))
    # One row a range.
    firsts = sorted((r.range, r.m.d, r.m.v) for r in ids.groupBy("range").agg(F.min(F.struct("d", "v")).alias("m")).collect())
    follow = ids.sparkSession.createDataFrame([(r, *firsts[(k + 1) % len(firsts)][1:]) for k, (r, _, _) in enumerate(firsts)], "range int, fd bigint, fv bigint")
    order = Window.partitionBy("range").orderBy("d", "v")
    ids = ids.withColumns({"nd": F.lead("d").over(order), "nv": F.lead("v").over(order)})
    return ids.join(F.broadcast(follow), "range").select("d", "v", "n", F.coalesce("nd", "fd").alias("nd"), F.coalesce("nv", "fv").alias("nv"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: tuple[float, float] = COMMON, per_range: int = RANGE) -> DataFrame:
    """Per document (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    text, least = F.coalesce(F.col(text_col), F.lit("")), -(2**63)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("d"), F.xxhash64(text).alias("v"), text.alias("t"))
    band = lexicon(docs.select("t"), "t", common)
    ids = cut(_successors(cut(docs.groupBy("d", "v").agg(F.first(F.length("t")).alias("n"))), per_range))
    # The texts are dealt out by document once, to as many tasks as the session says, and both joins and all grouping below keep to that.
    wanted = ids.select(F.col("nd").alias("d"), F.col("nv").alias("v"), F.col("d").alias("pd"), F.col("v").alias("pv"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    tails = docs.join(wanted.hint("shuffle_hash"), ["d", "v"]).select(F.col("pd").alias("d"), F.col("pv").alias("v"), F.expr("substring(t, 1, k)").alias("tail"), "k")
    tails = tails.groupBy("d", "v").agg(F.first(F.struct("tail", "k")).alias("x"))
    edited = docs.join(tails.hint("shuffle_hash"), ["d", "v"]).withColumn("e", F.expr("concat(substring(t, 1, length(t) - x.k), x.tail)"))
    both = edited.select("d", "v", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("t")), F.struct(F.lit(1).alias("w"), F.col("e").alias("t")))).alias("x")).select("d", "v", "x.w", "x.t")
    prints = fingerprints(both, band, ["d", "v", "w"], "t").groupBy("d", "v").agg(F.max(F.when(F.col("w") == 0, F.col("fingerprint"))).alias("f"), F.max(F.when(F.col("w") == 1, F.col("fingerprint"))).alias("g"))
    facts = edited.select("d", "v", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"))
    told = staged(facts.join(prints, ["d", "v"]).join(ids.select("d", "v", "nd", "nv"), ["d", "v"]))
    before = ids.select(F.col("nd").alias("d"), F.col("nv").alias("v"), F.col("d").alias("pd"), F.col("v").alias("pv"))
    other = told.select("d", "v", "f").dropDuplicates(["d", "v"]).join(before, ["d", "v"]).select(F.col("pd").alias("d"), F.col("pv").alias("v"), F.col("f").alias("nf"))
    own = F.when(F.col("d") != least, F.col("d")).cast(df.schema[id_col].dataType)
    return told.join(other, ["d", "v"]).select(own.alias(id_col), "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("g").alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("nf")).alias("near_next"))
