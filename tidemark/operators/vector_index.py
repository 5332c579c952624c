"""A written nearest-neighbour index: vectors in lists by k-means, as 8-bit residuals, and searched from disk.

    folder/centroids   list, centroid and how many rows it has
    folder/codes       list=<list>/: id, part, scale and the residual to the centroid as bytes
    folder/vectors     list=<list>/: id and the unit vector
    folder/about       rows, dimensions, lists, and the lists to search for the wished recall

The lists are fitted on about `sample` rows (a bound on what is fitted, not on what is indexed: every row is). How many lists have to be searched for a recall depends on how the vectors cluster,
so it is measured when the index is built, on the sample: the exact neighbours of some sample rows, and in which of the row's nearest lists each of them lies.

A search finds each query's nearest lists, reads only the partitions of lists that any query asks for, and lets parts of their codes, dealt by id, meet blocks of queries: each list's codes are scored
against the queries that ask for it, and a pair of a part and a block gives one shortlist a query, not one for each list. The best of each query are rescored by the exact vectors. A task holds about
65,536 codes, QUERIES queries and BLOCK by ROWS products.

Rows without a vector or id are left out; a vector of zeros has a similarity of 0 with all. Equal similarities go by id. An empty table gives an index in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, l2_normalize
from tidemark.operators.search import knn, met
from tidemark.session import cut

#: Rows of a file of an index and codes scored at once, queries that a task holds, and rows of a block of scores.
ROWS, QUERIES, BLOCK = 20_000, 16_000, 256
#: Rows whose neighbours decide how many lists are searched, and the margin to the wished recall.
PROBED, MARGIN = 500, 0.02


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _units(items: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return items.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(vec_col)).alias("v"))


def _nearest(units: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """(id, v, lists): the n nearest lists of each vector, nearest first."""
    shared = units.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c**2).sum(1) / 2
        for batch in batches:
            order = np.argsort(half - _matrix(batch[1]) @ c.T if batch.num_rows else np.zeros((0, len(c))), axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    return units.select("id", "v").mapInArrow(run, "id bigint, v array<double>, lists array<int>")


def build_index(items: DataFrame, path: str, recall: float = 0.9, k: int = 10, lists: int | None = None, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> None:
    """Write an index of all items to a new folder. lists: by default the square root of the rows, 16 at least and sample / 20 at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = items.sparkSession
    units = _units(items, id_col, vec_col)
    size = units.count()
    lists = min(max(1, size), lists or int(min(max(16, size**0.5), max(16, sample // 20))))
    drawn = lambda df, n: df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**12)) < 10**12 * min(1.0, n / max(1, size)))
    some = cut(drawn(units, sample))
    found = KMeans(k=lists, seed=seed, featuresCol="f", maxIter=15).fit(some.select(array_to_vector("v").alias("f"))).clusterCenters() if size > 1 else [np.array(x.v) for x in units.collect()]
    centroids = np.array(found) if len(found) else np.zeros((1, 1))
    # Where the sample's own neighbours lie.
    asked = drawn(some, PROBED)
    own = _nearest(some, centroids, 1).select("id", F.element_at("lists", 1).alias("own"))
    order = _nearest(asked, centroids, len(centroids)).select(F.col("id").alias("query_id"), "lists")
    pairs = knn(some.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), asked.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), k).select("query_id", "id")
    reach = pairs.join(own, "id").join(order, "query_id").select(F.array_position("lists", F.col("own")).alias("at")).agg(F.percentile("at", min(1.0, recall + MARGIN))).first()[0]
    shared = spark.sparkContext.broadcast(centroids)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            v, at = _matrix(batch[1]), batch[2].to_numpy()
            rest = v - c[at] if len(at) else v
            scale = np.abs(rest).max(axis=1, initial=0.0) / 127
            codes = np.round(rest / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(scale), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "list", "scale", "code"])

    placed = _nearest(units, centroids, 1).select("id", "v", F.element_at("lists", 1).alias("list"))
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, size // (ROWS * lists))))).write.partitionBy("list").parquet(f"{path}/vectors")
    placed = spark.read.schema("id bigint, v array<double>, list int").parquet(f"{path}/vectors").select("id", "v", "list")
    counts = placed.groupBy("list").agg(F.count("*").alias("rows")).collect()  # a row for each list
    sizes = {r.list: r.rows for r in counts}
    spark.createDataFrame([(j, [float(x) for x in c], sizes.get(j, 0)) for j, c in enumerate(centroids)], "list int, centroid array<double>, rows bigint").write.parquet(f"{path}/centroids")
    parts = F.broadcast(spark.read.parquet(f"{path}/centroids").select("list", F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS)).alias("parts")))
    codes = placed.mapInArrow(coded, "id bigint, list int, scale double, code binary").join(parts, "list")
    codes.select("id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "scale", "code", "list").repartition("list", "part").write.partitionBy("list").parquet(f"{path}/codes")
    told = [(size, centroids.shape[1], len(centroids), int(min(len(centroids), reach or 1)), float(recall))]
    spark.createDataFrame(told, "rows bigint, dims int, lists int, probes int, recall double").coalesce(1).write.json(f"{path}/about")


def about(spark: SparkSession, path: str) -> DataFrame:
    """What the index says of itself: one row."""
    return spark.read.schema("rows bigint, dims int, lists int, probes int, recall double").json(f"{path}/about")


def _codes(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The codes of some lists: other partitions aren't read."""
    return spark.read.schema("id bigint, part int, scale double, code binary, list int").parquet(f"{path}/codes").where(F.col("list").isin(lists))


def _merge(sims: np.ndarray, ids: np.ndarray, who: np.ndarray, near: np.ndarray, what: np.ndarray) -> None:
    """Put a list's items among the nearest so far (near, what) of the queries who; -inf where there is none."""
    n = near.shape[1]
    rows = np.flatnonzero((sims > near[who].min(axis=1)[:, None]).any(axis=1))
    both, names = np.concatenate([near[who[rows]], sims[rows]], axis=1), np.concatenate([what[who[rows]], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
    best = np.argpartition(-both, n - 1, axis=1)[:, :n]
    near[who[rows]], what[who[rows]] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)


def search_index(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, shortlist: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", queries_a_task: int = QUERIES) -> DataFrame:
    """Approximate top-k: rows (query_id, rank, id, sim), without the query itself. probes: lists searched for each query (as the index says); shortlist: candidates rescored exactly (4 k)."""
    spark = queries.sparkSession
    known = about(spark, path).first()
    probes, shortlist = min(known.lists, probes or known.probes), shortlist or 4 * k
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most sample / 20
    centroids = np.array([r.centroid for r in rows])
    near = _nearest(_units(queries if known.rows else queries.limit(0), id_col, vec_col), centroids, probes)
    asked = cut(near.select("id", "v", "lists"))
    touched = sorted(r.list for r in asked.select(F.explode("lists").alias("list")).distinct().collect())  # a row for each list
    shared = spark.sparkContext.broadcast(centroids)

    def score(q: pa.Table, items: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and items.num_rows:
            c, names, vectors, ids = shared.value, q.column("id").to_numpy(), _matrix(q.column("v").combine_chunks()), items.column("id").to_numpy()
            codes = np.stack([np.frombuffer(x, np.int8) for x in items.column("code").to_pylist()])
            at, scale = items.column("list").to_numpy(), items.column("scale").to_numpy().astype(np.float32)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(c)))
            listed = np.asarray(q.column("lists").combine_chunks().flatten()).reshape(len(names), -1)
            for first in range(0, len(names), BLOCK):
                mine = slice(first, first + BLOCK)
                block, searched = vectors[mine], np.zeros((len(names[mine]), len(c)), bool)
                np.put_along_axis(searched, listed[mine], True, axis=1)
                near, what = np.full((len(block), shortlist), -np.inf), np.zeros((len(block), shortlist), np.int64)
                for n in np.flatnonzero(np.diff(ends, prepend=0)):
                    who = np.flatnonzero(searched[:, n])
                    them = order[ends[n - 1] if n else 0 : ends[n]]
                    for j in range(0, len(them) if len(who) else 0, ROWS):
                        some = them[j : j + ROWS]
                        sims = (block[who] @ c[n])[:, None] + block[who].astype(np.float32) @ (codes[some].astype(np.float32) * scale[some, None]).T
                        sims[names[mine][who][:, None] == ids[some]] = -np.inf
                        _merge(sims, ids[some], who, near, what)
                rows, columns = np.nonzero(np.isfinite(near))
                found.append((names[mine][rows], what[rows, columns], near[rows, columns]))
        return pa.table(dict(zip(("query_id", "id", "near"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    n_codes = sum(r.rows for r in rows if r.list in set(touched))
    scored = met(asked, asked.count(), _codes(spark, path, touched).select("id", "list", "scale", "code"), n_codes, score, "query_id bigint, id bigint, near double", queries_a_task)
    first = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "id")
    short = scored.withColumn("r", F.row_number().over(first)).where(F.col("r") <= shortlist).select("query_id", "id")
    vectors = spark.read.schema("id bigint, v array<double>, list int").parquet(f"{path}/vectors").where(F.col("list").isin(touched))
    exact = short.join(vectors.select("id", "v"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    best = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    sims = exact.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 9).alias("sim"))
    return sims.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
