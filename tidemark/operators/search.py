"""Search: exact and inverted-file nearest neighbours, BM25, hybrid blending, ranking metrics, hard negatives (W5, W6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.vectors import dequantize, dot, l2_normalize, min_max, quantize
from tidemark.session import cut, staged

#: Queries and items that a task compares, the least number of parts, the side of a block of products, and pairs of query and term that are broadcast.
BLOCK, PART, PARTS, TILE, TERMS = 16_000, 65_536, 8, 1_024, 1_000_000
#: Pairs of query and document that are scored in a task.
PAIRS = 1_000_000
#: Centroids broadcast at once.
CENTROIDS = 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def top_k(ids: np.ndarray, v: np.ndarray, names: np.ndarray, q: np.ndarray, sims: np.ndarray, found: np.ndarray) -> None:
    """Put items (ids, v) among the best so far of each query (names, q): sims (descending, -inf where there is none yet) and found, by similarity and then id, without the query itself.

    TILE by TILE products are held at once; what can't come among a query's best isn't sorted.
    """
    k = sims.shape[1]
    for at in range(0, len(names), TILE):
        mine = slice(at, at + TILE)
        for first in range(0, len(ids), TILE):
            raw, them = q[mine] @ v[first : first + TILE].T, ids[first : first + TILE]
            least = sims[mine, -1]
            if raw.shape[1] > k + 1 and not np.isfinite(least).all():
                least = np.fmax(least, -np.partition(-raw, k, axis=1)[:, k])
            rows, columns = np.nonzero(raw >= least[:, None] - 2e-9)  # more than rounding may add
            other = (names[mine][rows] != them[columns]) & np.isfinite(raw[rows, columns])
            rows, columns = rows[other], columns[other]
            if not len(rows):
                continue
            touched = np.zeros(len(raw), bool)
            touched[rows] = True
            had, place = np.nonzero(np.isfinite(sims[mine]) & touched[:, None])
            who = np.concatenate([had, rows])
            near = np.concatenate([sims[mine][had, place], np.round(raw[rows, columns], 9)])
            what = np.concatenate([found[mine][had, place], them[columns]])
            order = np.lexsort((what, -near, who))
            who, near, what = who[order], near[order], what[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            kept = rank < k
            sims[at + who[kept], rank[kept]], found[at + who[kept], rank[kept]] = near[kept], what[kept]


def met(queries: DataFrame, n_queries: int, items: DataFrame, n_items: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK, part: int = PART) -> DataFrame:
    """run() over each pair of a block of queries and a part of the items (both with an id), so a task holds about block queries and part items, whatever the tables' sizes.

    There are PARTS parts at least, so that small tables are shared out too. Products take time rather than space, so each pair has a partition of its own.
    """
    parts, blocks = max(PARTS, -(-n_items // part)), max(1, -(-n_queries // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    keys = ["_block", "_part"]
    left = queries.withColumn("_block", own(blocks)).withColumn("_part", every(parts)).repartition(2 * parts * blocks, *keys)
    right = items.withColumn("_part", own(parts)).withColumn("_block", every(blocks)).repartition(2 * parts * blocks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _vectors(t: pa.Table, name: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a table's rows."""
    v = _matrix(t.column(name).combine_chunks())
    return t.column("id").to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _best(names: np.ndarray, sims: np.ndarray, found: np.ndarray) -> pa.Table:
    rows, columns = np.nonzero(np.isfinite(sims))
    return pa.table({"query_id": pa.array(names[rows], pa.int64()), "id": pa.array(found[rows, columns], pa.int64()), "sim": pa.array(sims[rows, columns], pa.float64())})


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _named(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))


def knn(items: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, part: int = PART) -> DataFrame:
    """Exact top-k by cosine: rows (query_id, rank, id, sim), without the query itself; equal similarities by id.

    Blocks of queries meet parts of the items (met()), and each pair gives a query's k best of the part. All pairs are compared, so the time grows with the product of the tables, the space of a
    task doesn't grow.
    """

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = asked.column("id").to_numpy()
        sims, found = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)
        if len(names) and held.num_rows:
            top_k(*_vectors(held), *_vectors(asked), sims, found)
        return _best(names, sims, found)

    return _first(met(_named(queries, id_col, vec_col), queries.count(), _named(items, id_col, vec_col), items.count(), best, "query_id bigint, id bigint, sim double", block, part), k)


def centroids_by_label(items: DataFrame, label: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector of each label."""
    each = items.select(label, F.posexplode(vec_col).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def assign(items: DataFrame, centroids: DataFrame, label: str, vec_col: str = "embedding", most: int = CENTROIDS) -> DataFrame:
    """The label of the centroid with the highest dot product for each item, the lower label in a tie.

    Centroids (one a label) are counted; up to most of them go to the tasks by broadcast. More go in blocks by a hash of their labels, one pass over the items each, and a pass
    keeps the better of its own and the earlier label; the items are written between passes, so no two blocks are held at once. A null label is left out.
    """
    spark, kind = items.sparkSession, centroids.schema[label].dataType
    known = centroids.where(F.col(label).isNotNull())
    blocks = max(1, -(-known.count() // most))
    others = [c for c in items.columns if c != vec_col]
    now = items.select(*others, vec_col, F.lit(None).cast(kind).alias("assigned"), F.lit(float("-inf")).alias("_s"))
    for b in range(blocks):
        got = known.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == b).orderBy(label).select(label, "centroid").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast((got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), float)))

        def better(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, c = shared.value
            for batch in batches:
                v, label_of, score = _matrix(batch.column(vec_col)), batch.column("assigned").to_pylist(), batch.column("_s").to_numpy().copy()
                for at in range(0, len(names) if len(v) else 0, 1_024):
                    s = np.round(v @ c[at : at + 1_024].T, 9)
                    best = np.argmax(s, axis=1)
                    top = s[np.arange(len(v)), best]
                    for i in np.flatnonzero(top >= score):
                        name = names[at + best[i]]
                        if top[i] > score[i] or label_of[i] is None or name < label_of[i]:
                            label_of[i], score[i] = name, top[i]
                column = batch.schema.get_field_index("assigned")
                out = batch.set_column(column, "assigned", pa.array(label_of, batch.schema.field(column).type))
                yield out.set_column(out.schema.get_field_index("_s"), "_s", pa.array(score))

        now = now.mapInArrow(better, now.schema)
        if b < blocks - 1:
            now = staged(now)
            shared.unpersist()
    return now.drop("_s", vec_col)


def ivf(items: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Approximate top-k: k-means lists fitted on about sample rows, all rows indexed, the nearest probes lists searched for each query.

    There are as many lists as the square root of the rows, 16 at least and sample / 20 at most. By default 10 of them are searched, and half of them where there are more
    than 20: vectors without clusters need that for a recall of 0.9 (clustered ones do with fewer). Queries meet parts of the lists as in knn(); pairs are multiplied in blocks and never become rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = _named(items, id_col, vec_col).withColumn("v", l2_normalize(F.col("v")))
    size = max(1, unit.count())
    share = min(1.0, sample / size)
    lists = lists or int(min(max(16, size**0.5), max(16, sample // 20)))
    probes = min(lists, probes or max(10, -(-lists // 2)))
    model = KMeans(k=lists, seed=seed, featuresCol="f", maxIter=15).fit(unit.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select(array_to_vector("v").alias("f")))
    centers = items.sparkSession.sparkContext.broadcast(np.array(model.clusterCenters()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int32)
            for at in range(0, batch.num_rows, TILE):
                own[at : at + TILE] = np.argmin((c**2).sum(1) - 2 * _matrix(batch[1].slice(at, TILE)) @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(own)], ["id", "v", "list"])

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = asked.column("id").to_numpy()
        sims, found = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64)
        if len(names) and held.num_rows:
            c, q, (ids, v) = centers.value, _vectors(asked)[1], _vectors(held)
            searched = np.zeros((len(names), lists), bool)
            for at in range(0, len(q), TILE):
                order = np.argpartition((c**2).sum(1) - 2 * q[at : at + TILE] @ c.T, probes - 1, axis=1)[:, :probes]
                np.put_along_axis(searched[at : at + TILE], order, True, axis=1)
            order = np.argsort(held.column("list").to_numpy(), kind="stable")
            ends = np.cumsum(np.bincount(held.column("list").to_numpy(), minlength=lists))
            for n in np.flatnonzero(np.diff(ends, prepend=0)):
                mine, them = np.flatnonzero(searched[:, n]), order[ends[n - 1] if n else 0 : ends[n]]
                s, f = sims[mine], found[mine]
                top_k(ids[them], v[them], names[mine], q[mine], s, f)
                sims[mine], found[mine] = s, f
        return _best(names, sims, found)

    indexed = unit.mapInArrow(nearest, "id bigint, v array<double>, list int")
    asked = _named(queries, id_col, vec_col)
    return _first(met(asked, queries.count(), indexed, size, best, "query_id bigint, id bigint, sim double"), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean share of each query's exact neighbours that were found."""
    a = approximate.groupBy("query_id").agg(F.collect_set("id").alias("a"))
    e = exact.groupBy("query_id").agg(F.collect_set("id").alias("e"))
    joined = e.join(a, "query_id", "left")
    return joined.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.size(F.array_intersect("e", F.coalesce("a", F.array().cast("array<bigint>")))) / F.size("e")), 6).alias("recall"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query_id", query_text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top-k documents of each query: rows (query_id, rank, id, score); equal scores by id. fielded_bm25() with one field."""
    return fielded_bm25(docs, queries, {text_col: 1.0}, k, id_col, query_col, query_text, k1, b)


def fielded_bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], k: int = 10, id_col: str = "doc_id", query_col: str = "query_id", query_text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top-k documents of each query over several fields with weights: rows (query_id, rank, id, score); equal scores by id.

    A term's count in a field is divided by the field's length against the mean of that field; the fields' counts, times their weights, are summed before the sum is saturated. A term's
    frequency is that of the documents with it in any field. A null field is empty.

    Documents are dealt out once, by id: counts of terms, scores and each task's own k best of a query follow where they are, so only these travel besides. There are as many tasks as keep the
    pairs of a query and a document at PAIRS in one, if every document had a word of every query. The queries' terms are broadcast up to TERMS of them, and joined beyond.
    """
    names = list(fields)
    asked = cut(queries.select(F.col(query_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")))
    few = asked.count() <= TERMS
    sent = lambda df: F.broadcast(df) if few else df
    terms = asked.select("term").distinct()
    words = lambda df: df.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(f"w{j}") for j, c in enumerate(names)])
    stats = words(docs).agg(F.count("*").alias("n"), *[F.avg(F.size(f"w{j}")).alias(f"m{j}") for j in range(len(names))]).first()
    held = words(docs).select(F.explode(F.array_distinct(F.concat(*[f"w{j}" for j in range(len(names))]))).alias("term"))
    df = cut(held.join(sent(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(asked.join(sent(df), "term").select("term", "query_id", idf.alias("idf")))
    share = lambda j, c: fields[c] / (1 - b + b * F.size(f"w{j}") / F.lit(float(stats[f"m{j}"] or 1)))
    fielded = F.explode(F.array(*[F.struct(share(j, c).alias("one"), F.col(f"w{j}").alias("w")) for j, c in enumerate(names)]))
    pieces = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-stats.n * asked.select("query_id").distinct().count() // PAIRS))
    dealt = words(docs.select(id_col, *names).repartition(pieces, id_col)).select("id", fielded.alias("f"))
    hits = dealt.select("id", "f.one", F.explode("f.w").alias("term")).join(sent(terms), "term", "left_semi").groupBy("id", "term").agg(F.sum("one").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)
    scored = hits.join(sent(weights), "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int = 10, semantic_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """Blend (query_id, id, sim) and (query_id, id, score): each side on the scale of its least and best hit, a missing side 0.

    A best score of 0 counts as 1 and a range of 0 as 1.
    """

    def scaled(df: DataFrame, value: str, name: str) -> DataFrame:
        per = Window.partitionBy("query_id")
        high = F.max(value).over(per)
        return df.withColumn(name, min_max(F.col(value), F.min(value).over(per), F.when(high == 0, 1.0).otherwise(high))).select("query_id", "id", name)

    both = scaled(semantic, "sim", "s").join(scaled(lexical, "score", "l"), ["query_id", "id"], "full_outer")
    blended = both.select("query_id", "id", F.round(semantic_weight * F.coalesce("s", F.lit(0.0)) + lexical_weight * F.coalesce("l", F.lit(0.0)), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return blended.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranking_metrics(rankings: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean recall and nDCG at each k and reciprocal rank over the whole list, from (query_id, id, rank) and (query_id, id)."""
    found = positives.join(rankings.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    columns = [F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    for k in ks:
        hit = F.col("rank") <= k
        columns += [F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}"), F.round(F.avg(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}")]
    return found.agg(*columns)


def hard_negatives(rankings: DataFrame, positives: DataFrame, vectors: DataFrame, skip: int = 3, window: int = 30, n: int = 3, max_sim: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Of each query's ranks after skip up to window, the positive left out, at most n negatives not too like the positive, in the order of a hash."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rest = rankings.join(positives.withColumnRenamed("id", "positive"), "query_id").where("id <> positive").withColumn("k", F.row_number().over(order)).where((F.col("k") > skip) & (F.col("k") <= window))
    unit = vectors.select(F.col(id_col).alias("id"), l2_normalize(F.col(vec_col)).alias("v"))
    near = rest.join(unit, "id").join(unit.select(F.col("id").alias("positive"), F.col("v").alias("pv")), "positive").where(F.round(dot(F.col("v"), F.col("pv")), 9) <= max_sim)
    drawn = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws("-", "query_id", "id")), "id")
    return near.withColumn("pick", F.row_number().over(drawn)).where(F.col("pick") <= n).select("query_id", "positive", "id", "pick")


def following(items: DataFrame, label: str, id_col: str, width: int = 10_000) -> DataFrame:
    """Rows (id_col, next): the next id of the same label; null after the last. Ids must be distinct.

    Ids are met within stretches of width; beyond a stretch it is the first id of the label's next stretch, so no label comes together in one task.
    """
    rows = items.select(F.col(label).alias("_l"), F.col(id_col), F.floor(F.col(id_col) / width).alias("_s"))
    firsts = rows.groupBy("_l", "_s").agg(F.min(id_col).alias("_f"))
    ahead = firsts.select("_l", "_s", F.lead("_f").over(Window.partitionBy("_l").orderBy("_s")).alias("_n"))
    within = rows.withColumn("_w", F.lead(id_col).over(Window.partitionBy("_l", "_s").orderBy(id_col)))
    return within.join(ahead, within["_l"].eqNullSafe(ahead["_l"]) & (within["_s"] == ahead["_s"]), "left").select(id_col, F.coalesce("_w", "_n").alias("next"))


def quantization_quality(items: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Least and mean cosine of vectors with what 8-bit numbers keep of them."""
    q = quantize(F.col("v"))
    both = items.select(l2_normalize(F.col(vec_col)).alias("v")).withColumn("q", q).withColumn("back", dequantize(F.col("q.scale"), F.col("q.qv")))
    cosine = dot(F.col("v"), F.col("back")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("back"), F.col("back")))
    return both.agg(F.round(F.min(cosine), 6).alias("least"), F.round(F.avg(cosine), 6).alias("mean"))


def valid_queries(queries: DataFrame, records: DataFrame, record_id: str = "record_id", id_col: str = "id") -> DataFrame:
    """Queries whose record exists."""
    return queries.join(records.select(F.col(id_col).alias(record_id)), record_id, "left_semi")


def token_recall(query: Column, record: Column) -> Column:
    """Share of a query's distinct words that a record has; 0 without words."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(record))) / F.size(q)).otherwise(0.0)


def enriched(results: DataFrame, titles: DataFrame, id_col: str = "id") -> DataFrame:
    """Results with the records' fields; what a result has itself wins."""
    others = [c for c in titles.columns if c != id_col]
    found = results.join(titles.select(id_col, *[F.col(c).alias(f"_{c}") for c in others]), id_col, "left")
    return found.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in results.columns else F.col(f"_{c}") for c in others}).drop(*[f"_{c}" for c in others])


def formatted(results: DataFrame, k: int, source: str, threshold: float = 0.0) -> DataFrame:
    """Results of one mode: scores at or above the threshold, the first k by rank, with their source."""
    return results.where((F.col("score") >= threshold) & (F.col("rank") <= k)).withColumn("source", F.lit(source))


def reranked(results: DataFrame, logit: str, k: int) -> DataFrame:
    """The k best of each query by a judge's logit, its sigmoid as score; equal ones by id."""
    score = 1 / (1 + F.exp(-F.col(logit)))
    order = Window.partitionBy("query_id").orderBy(F.col(logit).desc(), "id")
    return results.withColumns({"score": score, "rank": F.row_number().over(order)}).where(F.col("rank") <= k)


def search_mode(n_items: int, model_ready: bool, flat_limit: int = 2_000) -> str:
    """Words only without a model; exact search up to flat_limit items, inverted lists beyond."""
    return "lexical" if not model_ready else "flat" if n_items <= flat_limit else "lists"


def leaderboard(metrics: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Models with the best value of each column marked (<column>_best) and their place by one of them."""
    marks = metrics.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    best = marks.first()  # one row
    return metrics.withColumns({f"{c}_best": F.col(c).eqNullSafe(F.lit(best[f"_{c}"])) for c in columns} | {"sort_key": -F.col(by)})


def write_index(items: DataFrame, assigned: DataFrame, centroids: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """An index as Parquet: 8-bit vectors partitioned by list, the lists' centroids, and a manifest row."""
    q = quantize(l2_normalize(F.col(vec_col)))
    rows = items.join(assigned.select(id_col, F.col("assigned").alias("list")), id_col).withColumn("_q", q)
    rows.select(id_col, "list", F.col("_q.scale").alias("scale"), F.col("_q.qv").alias("qv")).write.mode("overwrite").partitionBy("list").parquet(f"{path}/items")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    items.agg(F.count("*").alias("n_items"), F.lit("sq8").alias("kind")).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark, path: str, lists: list | None = None) -> DataFrame:
    """An index's vectors, of some lists only if they are named: other partitions aren't read."""
    found = spark.read.parquet(f"{path}/items")
    found = found if lists is None else found.where(F.col("list").isin(*lists))
    return found.withColumn("v", dequantize(F.col("scale"), F.col("qv")))


def dangling(links: DataFrame, items: DataFrame, link: str, id_col: str) -> DataFrame:
    """Links to items that don't exist: none in a sound index."""
    return links.join(items.select(F.col(id_col).alias(link)), link, "left_anti")
