"""Representative chunks of documents: k-means within every document at once (W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine
from tidemark.session import cut, staged

#: Chunks of a document that meet its centres in one group; a longer document is dealt to several.
PIECE = 5_000


def _nearest(v: Column, centres: Column) -> Column:
    """Squared distance (9 digits) and number of the nearest centre, the lower number in a tie."""
    def away(c: Column) -> Column:
        return F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.round(away(c), 9).alias("d"), i.alias("i"))))


def document_clusters(df: DataFrame, doc: str, item: str, vec: str, k: int = 10, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """k-means within each document: rows (doc, item, v, pieces, d, i) with each chunk's distance and cluster, and rows (doc, c) of centres.

    The first centre is the chunk with the lowest item, each further one the chunk farthest from those before (the lowest item in a tie), so k
    is capped at a document's distinct vectors. Then rounds of means, fewer if nothing moves; a cluster without chunks keeps its centre.
    All documents move together: a round joins the centres, at most k a document, to the chunks, which were dealt once by document and piece, and
    adds up sums that are combined in each task first, so a document with a third of all chunks is no single task. Rows without a document or a
    vector are no chunks. Vectors have one length; another length raises.
    """
    chunks = df.where(F.col(doc).isNotNull() & F.col(vec).isNotNull()).select(F.col(doc).alias("doc"), F.col(item).alias("item"), F.col(vec).cast("array<double>").alias("v"))
    sizes = chunks.groupBy("doc").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    base = staged(chunks.join(sizes, "doc").withColumn("piece", F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int")))
    found = base.select(F.size("v").alias("n")).head()
    base = base.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "piece").persist()
    dims = found.n if found else 0
    centres = cut(base.groupBy("doc").agg(F.array(F.min_by("v", "item")).alias("c"), F.first("pieces").alias("pieces")))

    def placed() -> DataFrame:
        each = centres.select("doc", "c", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        return base.join(each, ["doc", "piece"]).withColumn("near", _nearest(F.col("v"), F.col("c"))).select("doc", "item", "v", "c", "near.d", "near.i")

    for _ in range(k - 1):
        far = placed().groupBy("doc").agg(F.min_by(F.struct("d", "v"), F.struct((-F.col("d")).alias("d"), "item")).alias("far"))
        centres = cut(centres.join(far, "doc").select("doc", F.when(F.col("far.d") > 0, F.concat("c", F.array("far.v"))).otherwise(F.col("c")).alias("c"), "pieces", (F.col("far.d") > 0).alias("more")))
        if not centres.where("more").head(1):
            break
    for _ in range(rounds):
        mean = placed().groupBy("doc", "i").agg(F.array(*[F.avg(F.element_at("v", n + 1)) for n in range(dims)]).cast("array<double>").alias("m"))
        means = mean.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))  # at most k a document
        moved = F.transform("c", lambda c, i: F.coalesce(F.col("m")[i], c))
        centres = cut(centres.join(means, "doc").select("doc", moved.alias("c"), "pieces", (moved != F.col("c")).alias("more")))
        if not centres.where("more").head(1):
            break
    out = staged(placed())
    base.unpersist()
    return out, centres.select("doc", "c")


def document_representatives(df: DataFrame, doc: str, item: str, vec: str, k: int = 10, rounds: int = 10) -> DataFrame:
    """By document and cluster the chunk with the highest cosine to the centre, the lowest item in a tie: rows (doc, cluster, item, n).

    See document_clusters. Equal items of a document are chunks of their own.
    """
    found, _ = document_clusters(df, doc, item, vec, k, rounds)
    like = F.round(cosine(F.col("v"), F.get("c", F.col("i"))), 9)
    return found.groupBy(F.col("doc").alias(doc), F.col("i").alias("cluster")).agg(F.min_by("item", F.struct((-like).alias("s"), "item")).alias(item), F.count("*").alias("n"))
