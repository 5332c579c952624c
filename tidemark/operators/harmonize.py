"""Families of dataset names: character n-gram similarity, leader clustering, incremental waves (W3)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.vectors import dot, l2_normalize
from tidemark.session import cut


@F.pandas_udf(StringType())
def ascii_name(names: pd.Series) -> pd.Series:
    """Compatibility letters as ASCII, lower case, other signs as spaces, squeezed; null as ''."""
    plain = names.fillna("").map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())
    return plain.str.replace(r"[^a-z0-9\s]", " ", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams within words, each word with a space on either side; a word shorter than n gives itself once."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(word: Column, n: int) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda k: F.substring(padded, k, F.lit(n)))

    # A padded word no longer than n is one gram, counted for the smallest such n only.
    sizes = [F.flatten(F.transform(F.filter(words, (lambda n: lambda w: (F.length(w) + 2 >= n) if n > low else F.lit(True))(n)), (lambda n: lambda w: of(w, n))(n))) for n in range(low, high + 1)]
    return F.concat(*sizes)


def tfidf(df: DataFrame, key: str, text: str, block: str | None = None) -> DataFrame:
    """Rows (block, key, gram, weight): count times ln((1 + n) / (1 + df)) + 1, of length 1 for each key. With block, names are counted within theirs."""
    rows = df.select((F.col(block) if block else F.lit(0)).alias("block"), F.col(key).alias("key"), F.col(text).alias("t"))
    tf = rows.select("block", "key", F.explode(char_grams(F.col("t"))).alias("gram")).groupBy("block", "key", "gram").agg(F.count("*").alias("tf"))
    if block:
        sizes = rows.groupBy("block").agg(F.count_distinct("key").alias("n"))
        idf = tf.groupBy("block", "gram").agg(F.count("*").alias("df")).join(sizes, "block").select("block", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    else:
        n = rows.select(F.count_distinct("key").alias("n")).first().n
        idf = tf.groupBy("block", "gram").agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = tf.join(idf, ["block", "gram"]).select("block", "key", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("block", "key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, ["block", "key"]).select("block", "key", "gram", (F.col("w") / F.col("len")).alias("weight"))


def similar_names(df: DataFrame, key: str, text: str, least: float = 0.5, block: str | None = None) -> DataFrame:
    """Pairs (a, b, similarity), a < b, with TF-IDF cosine of at least least; with block, pairs (block, a, b, similarity) of names within theirs.

    A prefix filter keeps the join small: a pair that reaches least shares a gram outside the frequent grams whose joint weight
    is under least in either name.
    """
    rows = tfidf(df, key, text, block)
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("block", "gram")))
    tail = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("block", "key").orderBy(F.col("df").desc(), "gram").rowsBetween(Window.unboundedPreceding, 0))
    prefix = rows.withColumn("tail", tail).where(F.col("tail") >= least * least - 1e-9).select("block", "key", "gram")
    pairs = prefix.join(prefix.withColumnRenamed("key", "other"), ["block", "gram"]).where("key < other").select("block", "key", "other").distinct()
    a, b = rows.select("block", "key", "gram", F.col("weight").alias("wa")), rows.select("block", F.col("key").alias("other"), "gram", F.col("weight").alias("wb"))
    scored = pairs.join(a, ["block", "key"]).join(b, ["block", "other", "gram"]).groupBy("block", "key", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    found = scored.where(F.col("similarity") >= least)
    return found.select(*([F.col("block").alias(block)] if block else []), F.col("key").alias("a"), F.col("other").alias("b"), "similarity")


def combined_names(df: DataFrame, key: str, text: str, vector: str, least: float = 0.85, sparse: float = 0.5) -> DataFrame:
    """Pairs (a, b, similarity, by_letters, by_vector), a < b, of names whose cosines of letter n-grams and of vectors, weighted sparse and 1 - sparse, come to at least least.

    No cosine of vectors is over 1, so the n-grams must reach (least - (1 - sparse)) / sparse by themselves: only such pairs, from similar_names(), meet their vectors, and no pair is lost. Where that bound
    is not above 0 the vectors alone could do, and all pairs would be candidates: this is refused. A key must have one text and vector; keys without a vector pair with none.
    """
    bound = (least - (1 - sparse)) / sparse
    if bound <= 0:
        raise ValueError("least must be over 1 - sparse, as vectors alone would reach it otherwise")
    pairs = similar_names(df, key, text, bound).withColumnRenamed("similarity", "by_letters")
    unit = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), l2_normalize(F.col(vector)).alias("v"))
    one, two = unit.toDF("a", "va"), unit.toDF("b", "vb")
    met = pairs.join(one, "a").join(two, "b").withColumn("by_vector", dot(F.col("va"), F.col("vb")))
    both = met.withColumn("similarity", sparse * F.col("by_letters") + (1 - sparse) * F.col("by_vector"))
    return both.where(F.col("similarity") >= least).select("a", "b", "similarity", "by_letters", "by_vector")


#: Links of a block that one task settles by itself.
LINKS = 200_000


def _settle(links: pd.DataFrame) -> pd.DataFrame:
    """The leader of each name u of a block, from its links to earlier names v, in the order of the names."""
    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    place = lambda n, name: (pd.isna(n), 0 if pd.isna(n) else -n, name)
    earlier: dict = {}
    order: dict = {}
    for u, n, v, m in zip(links["u"], links["n"], links["v"], links["m"], strict=True):
        key = plain(u)
        order[key] = (place(n, key), u)
        earlier.setdefault(key, []).append((place(m, plain(v)), plain(v), v))
    follows, found = set(), []
    for key in sorted(order, key=lambda k: order[k][0]):
        first = next((v for _, k, v in sorted(earlier[key], key=lambda x: x[0]) if k not in follows), None)
        if first is not None:
            follows.add(key)
        found.append((links["block"].iloc[0], order[key][1], order[key][1] if first is None else first))
    return pd.DataFrame(found, columns=["block", "u", "leader"])


def leaders(df: DataFrame, pairs: DataFrame, block: str, name: str, count: str, links: int = LINKS) -> DataFrame:
    """Leader clustering within blocks: by count (then name) a name joins the first leader it is paired with, else leads.

    A block's pairs are those of similar_names(); names of different blocks never meet. A block of at most so many links is settled in one pass over them. Of larger ones each round settles the names
    that have an earlier leader with nothing open before it, or nothing open at all; what is settled leaves the loop, so a round joins only what is open with what was settled last.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct()
    names = df.groupBy(F.col(block).alias("block"), F.col(name).alias("u")).agg(F.max(count).alias("n"))
    other = names.toDF("other", "v", "m")
    earlier = (F.col("m") > F.col("n")) | (F.col("m").eqNullSafe(F.col("n")) & (both["v"] < F.col("u"))) | (F.col("n").isNull() & F.col("m").isNotNull())
    left = cut(names.join(both, "u").join(other, (both["v"] == other["v"]) & F.col("block").eqNullSafe(F.col("other"))).where(earlier).select("block", "u", "n", both["v"], "m"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    sizes = left.groupBy(F.col("block").alias("b2")).agg((F.count("*") > links).alias("large"))
    left = left.join(sizes, same("block", "b2")).drop("b2")
    result = left.select("block", "u", F.col("v").alias("leader")).schema
    parts = [left.where("NOT large").drop("large").groupBy("block").applyInPandas(_settle, result)]
    open_links = cut(left.where("large").drop("large").withColumn("leads", F.lit(False)))
    linked = left.select(F.col("block").alias("b2"), F.col("u").alias("u2")).distinct()
    leading = names.join(linked, same("block", "b2") & same("u", "u2"), "left_anti").select("block", "u", F.col("u").alias("leader"))
    last = leading
    while not open_links.isEmpty():
        told = open_links.join(last.select(F.col("block").alias("b2"), F.col("u").alias("v2"), (F.col("u") == F.col("leader")).alias("l")), same("block", "b2") & (F.col("v") == F.col("v2")), "left")
        # A neighbour that follows another is out of the way; one that leads is known from now on.
        known = cut(told.withColumns({"gone": F.coalesce(~F.col("l"), F.lit(False)), "leads": F.col("leads") | F.coalesce("l", F.lit(False))}).select("block", "u", "n", "v", "m", "leads", "gone"))
        place = F.struct(F.col("m").isNull(), -F.col("m"), F.col("v"))
        first = F.min_by(F.when(~F.col("gone"), F.struct("v", "leads")), F.when(~F.col("gone"), place))
        settled = known.groupBy("block", "u").agg(first.alias("first")).where("first IS NULL OR first.leads").select("block", "u", F.coalesce("first.v", "u").alias("leader"))
        last = cut(settled)
        parts.append(last)
        open_links = cut(known.where("NOT gone").drop("gone").join(last.select(F.col("block").alias("b2"), F.col("u").alias("u2")), same("block", "b2") & (F.col("u") == F.col("u2")), "left_anti"))
    found = leading
    for part in parts:
        found = found.unionByName(part)
    rows = df.select(block, name, count).distinct()
    return rows.join(found.toDF("b2", "u2", "leader"), F.col(block).eqNullSafe(F.col("b2")) & F.col(name).eqNullSafe(F.col("u2"))).select(block, name, count, "leader")


def families(settled: DataFrame, block: str, name: str, count: str) -> DataFrame:
    """By leader the family: canonical name, summed count, aliases in order."""
    return settled.groupBy(block, "leader").agg(F.sum(count).alias("n"), F.array_sort(F.collect_set(F.when(F.col(name) != F.col("leader"), F.col(name)))).alias("aliases"))


def integrate(master: DataFrame, incoming: DataFrame, key: str, names: str) -> DataFrame:
    """The master families with a wave of incoming ones: equal keys get the union of their names, new keys are appended."""
    both = master.select(key, names).unionByName(incoming.select(key, names))
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias(names))


def pick_canonical(df: DataFrame, key: str, name: str, count: str, has_country: str, has_year: str, acronym: str) -> DataFrame:
    """By key a name without country and year, else without country, else any; with an acronym first, then the most frequent."""
    tier = F.when(~F.col(has_country) & ~F.col(has_year), 0).when(~F.col(has_country), 1).otherwise(2)
    return df.groupBy(key).agg(F.min_by(name, F.struct(tier, F.col(acronym).isNull().cast("int"), -F.col(count), F.col(name))).alias("canonical"))


def prototypes(df: DataFrame, block: str, name: str, count: str, place: str, least: float = 0.85) -> DataFrame:
    """Within each block (a country) groups of alike names: (block, prototype, n, aliases). Names lead in the order of place; a group's most frequent one (the first of equals) is its prototype.

    Rows without a block are left out. Names are alike by TF-IDF cosine over the block's names.
    """
    rows = df.where(F.col(block).isNotNull()).groupBy(block, name).agg(F.max(count).alias("_n"), F.min(place).alias("_p"))
    pairs = similar_names(rows, name, name, least, block)
    keyed = rows.select(F.struct(block, name).alias("node"), F.col(block).alias("all"), (-F.col("_p")).alias("order"))
    both = pairs.select(F.struct(F.col(block), F.col("a").alias(name)).alias("a"), F.struct(F.col(block), F.col("b").alias(name)).alias("b"))
    settled = leaders(keyed, both, "all", "node", "order").select(f"node.{block}", f"node.{name}", F.col(f"leader.{name}").alias("_l")).join(rows, [block, name])
    grouped = settled.groupBy(block, "_l").agg(F.max_by(name, F.struct("_n", -F.col("_p"))).alias("prototype"), F.sum("_n").alias("n"), F.array_sort(F.collect_set(name)).alias("_names"))
    return grouped.select(block, "prototype", "n", F.array_remove("_names", F.col("prototype")).alias("aliases"))
