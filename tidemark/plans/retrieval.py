"""Queries on vectors, search, metadata and detection evaluation, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import vectors as vx
from tidemark.functions.markup import with_paragraphs
from tidemark.operators import evaluation as ev
from tidemark.operators import metadata as md
from tidemark.operators import representatives as dr
from tidemark.operators import search as se
from tidemark.operators import vector_index as vi
from tidemark.session import shared_dir
from tidemark.sources.tables import table


def _asked(e):
    """The stated query set: every vector whose id is divisible by 20."""
    return e.where("vec_id % 20 = 0")


def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", vx.l2_normalize(F.col("embedding")))
    return e.select("vec_id", F.round(vx.norm(F.col("embedding")), 5).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


def sq8_quantize(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", vx.quantize(F.col("embedding")))
    return e.select("vec_id", F.round("q.scale", 9).alias("scale"), F.array_join(F.transform("q.qv", lambda x: x.cast("string")), ",").alias("qv"))


def sq8_quality(spark, d):
    return se.quantization_quality(table(spark, d, "embeddings"))


def vector_truncation(spark, d):
    e = table(spark, d, "embeddings")
    cosine = vx.cosine(vx.truncate(F.col("embedding"), 32), F.slice(vx.l2_normalize(F.col("embedding")), 1, 32))
    kept = vx.dot(F.slice("embedding", 1, 32), F.slice("embedding", 1, 32)) / vx.dot(F.col("embedding"), F.col("embedding"))
    return e.select("vec_id", F.round(cosine, 6).alias("cosine"), F.round(kept, 6).alias("kept"))


def knn_exact(spark, d):
    e = table(spark, d, "embeddings")
    return se.knn(e, _asked(e)).select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("sim", 6).alias("sim"))


def knn_recall(spark, d):
    e = table(spark, d, "embeddings")
    return se.recall(se.ivf(e, _asked(e)), se.knn(e, _asked(e)))


def centroid_assign(spark, d):
    e = table(spark, d, "embeddings")
    return se.assign(e, se.centroids_by_label(e, "label"), "label").groupBy("label", "assigned").agg(F.count("*").alias("n"))


def bm25_topk(spark, d):
    return se.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def fielded_bm25(spark, d):
    """Benchmark items against documents by two fields: the first line weighs three times as much as the whole text."""
    docs = table(spark, d, "documents").withColumn("title", F.element_at(F.split("text", "\n"), 1))
    asked = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    return se.fielded_bm25(docs, asked, {"title": 3.0, "text": 1.0}).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _index(spark, d) -> str:
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    vi.build_index(table(spark, d, "embeddings"), path)
    return path


def index_search(spark, d):
    """The written index with all its lists searched: 8-bit candidates, rescored exactly."""
    found = vi.search_index(_asked(table(spark, d, "embeddings")), _index(spark, d), probes=2**31 - 1, shortlist=100)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round("sim", 6).alias("sim"))


def index_recall(spark, d):
    """Recall of the written index at the lists that it chose for 0.9, and their share."""
    path, e = _index(spark, d), table(spark, d, "embeddings")
    about = vi.about(spark, path).first()
    return se.recall(vi.search_index(_asked(e), path), se.knn(e, _asked(e))).withColumns({"lists": F.lit(about.lists), "probes": F.lit(about.probes)})


def hybrid_blend(spark, d):
    """Benchmark items against documents: BM25 on one side, on the other the vectors under the same ids."""
    e = table(spark, d, "embeddings")
    b = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    asked = e.join(b.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    lexical = se.bm25(table(spark, d, "documents"), b, 30)
    return se.hybrid(se.knn(e, asked, 30), lexical).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _positives(spark, d):
    """The first vector after a query that has its label."""
    e = table(spark, d, "embeddings")
    return _asked(se.following(e, "label", "vec_id")).where("next IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("next").alias("id"))


def ranking_metrics(spark, d):
    e = table(spark, d, "embeddings")
    return se.ranking_metrics(se.knn(e, _asked(e), 50), _positives(spark, d), (1, 5, 10, 50))


def hard_negatives(spark, d):
    e = table(spark, d, "embeddings")
    return se.hard_negatives(se.knn(e, _asked(e), 31), _positives(spark, d), e)


def _catalog(spark, d):
    """A JSON record for each customer with orders: an indicator or a microdata study."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("k"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"))
    period = F.array(F.struct(F.date_format("a", "yyyy-MM-dd").alias("start"), F.date_format("b", "yyyy-MM-dd").alias("end")))
    who, where = F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.col("c_mktsegment").alias("name"))), F.array(F.struct(F.col("r_name").alias("name")), F.struct(F.col("n_name").alias("name")))
    indicator = F.to_json(F.struct(F.struct(F.col("c_name").alias("idno"), who.alias("authoring_entity"), where.alias("ref_country"), period.alias("time_periods"), F.lit("By customer").alias("definition_long")).alias("series_description")))
    study = F.to_json(F.struct(F.struct(F.struct(F.col("c_name").alias("idno")).alias("title_statement"), who.alias("authoring_entity"), F.struct(where.alias("nation"), period.alias("time_periods"), F.lit("A survey").alias("abstract")).alias("study_info")).alias("study_description")))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("timeseries")).otherwise(F.lit("microdata")).alias("kind"), F.when(F.col("c_custkey") % 2 == 0, indicator).otherwise(study).alias("payload"))


def metadata_facets(spark, d):
    f = md.facets(_catalog(spark, d), "payload", "kind")
    return f.select("c_custkey", "idno", "idno_uuid", F.array_join("source", ";").alias("source"), F.array_join("geographies", ";").alias("geographies"), "year_start", "year_end", F.size("years").alias("n_years"), "abstract")


def text_units(spark, d):
    f = md.facets(_catalog(spark, d), "payload", "kind")
    return md.text_units(f.select("c_custkey", "idno", "abstract"), "c_custkey", ["idno", "abstract"])


def record_serialization(spark, d):
    p = table(spark, d, "part")
    parts = md.segments([("name", "p_name", 40), ("brand", "p_brand", 20), ("type", "p_type", 20), ("size", "p_size", 5)])
    return p.select("p_partkey", md.serialize(parts, 45).alias("text"), F.length(md.serialize(parts, None, F.col("p_partkey"))).alias("n_permuted"))


def elastic_serialization(spark, d):
    """Documents as labelled lines within budgets of 40 to 4,030 letters, shared by the first line and the whole text."""
    docs = table(spark, d, "documents")
    parts = md.elastic_segments([("source", F.col("source"), False), ("title", F.split_part("text", F.lit("\n"), F.lit(1)), True), ("lang", F.col("lang"), False), ("text", F.col("text"), True)])
    text = md.fit_budget(parts, 40 + F.col("doc_id") % 400 * 10)
    return docs.select("doc_id", text.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def facet_plan(spark, d):
    """Five query facets for each part and language."""
    p = table(spark, d, "part").withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("fr"))))
    some = F.col("p_size") % 2 == 1
    evidence = {"keyword": [F.when(some, F.col("p_name"))], "unit": [F.when(some, F.col("p_size"))], "geo_year": [F.when(some, F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))], "source": [F.lit("")]}
    picked = md.picked_facets(evidence, 5, F.col("p_partkey"), F.col("lang"))
    return p.select("p_partkey", "lang", F.array_join(picked, ",").alias("facets"))


def document_representatives(spark, d):
    """For each document (a stretch of 40 vectors) the chunks nearest to its five centres."""
    e = table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 40).cast("long"))
    return dr.document_representatives(e, "doc", "vec_id", "embedding", 5, 10)


def metadata_coverage(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), "o_orderpriority")
    return md.coverage(o, ["status", "price", "o_orderpriority"])


def dotted_path_json(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(md.path(F.col("props"), "k").cast("int").alias("k"), md.path(F.col("props"), "k.missing").alias("none")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def null_fill(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_custkey")).alias("c"), F.when(F.col("o_orderkey") % 5 > 0, F.array("o_orderpriority")).alias("p")).alias("r"))
    return o.withColumn("r", md.filled(F.col("r"), o.schema["r"].dataType)).select("o_orderkey", "r.s", "r.c", F.size("r.p").alias("p"))


def html_blocks(spark, d):
    pages = with_paragraphs(table(spark, d, "pages").select("page_id", "html"), "html", "b")
    return pages.select("page_id", F.size("b").cast("long").alias("n_blocks"), F.md5(F.array_join("b", "\n")).alias("blocks_md5"))


def _boxes(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity IS NOT NULL")
    x, y = (F.col("l_partkey") % 10) / 20.0, (F.col("l_suppkey") % 10) / 20.0
    made = l.select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("label"), (F.col("l_linenumber")).alias("id"), ev.box(x, y, x + 0.1 + F.col("l_quantity") / 100, y + 0.1 + F.col("l_quantity") / 100).alias("box"), (F.col("l_linestatus") == "F").alias("truth"))
    return made.where("truth"), made.where("NOT truth")


def iou_pairs(spark, d):
    truth, found = _boxes(spark, d)
    return ev.iou_pairs(truth, found, ["page"], 0.3).select("page", "g", "p", F.round("iou", 6).alias("iou"))


def detection_eval(spark, d):
    """Boxes against the same boxes a little off, some of them under another label."""
    truth, found = _boxes(spark, d)
    both = truth.unionByName(found)
    b = F.col("box")
    moved = both.withColumn("box", ev.box(b["x1"] + F.col("id") / 100, b["y1"], b["x2"] + F.col("id") / 100, b["y2"])).withColumn("label", F.when(F.col("page") % 17 == 0, "N").otherwise(F.col("label")))
    return ev.evaluate(both, moved, "page", "label")


QUERIES = {f.__name__: f for f in (
    l2_normalize, sq8_quantize, sq8_quality, vector_truncation, knn_exact, knn_recall, centroid_assign, bm25_topk, fielded_bm25, index_search, index_recall, hybrid_blend, ranking_metrics, hard_negatives, metadata_facets, text_units, record_serialization, metadata_coverage, elastic_serialization, facet_plan, document_representatives,
    dotted_path_json, null_fill, html_blocks, iou_pairs, detection_eval,
)}

_UNIT = "u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
_KNN = _UNIT + ", sims AS (SELECT q.vec_id AS query_id, i.vec_id AS id, round(list_dot_product(q.e, i.e) / (q.n * i.n), 9) AS sim FROM u q JOIN u i ON q.vec_id <> i.vec_id WHERE {where}), knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM sims QUALIFY rank <= {k})"
_BM25 = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents), size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM p JOIN df USING (term) JOIN asked USING (term), size GROUP BY 1, 2),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= {k})"""
_POS = "pos AS (SELECT q.vec_id AS query_id, min(e.vec_id) AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND e.vec_id > q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1)"
_CAT = "cat AS (SELECT c_custkey, c_name, c_mktsegment, n_name, r_name, a, b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"
_UUID = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"
_Q20 = "q.vec_id % 20 = 0"

ORACLE = {
    "l2_normalize": f"WITH {_UNIT} SELECT vec_id, round(n, 5) AS norm, round(list_sum(list_transform(e, lambda x: abs(x / n))), 5) AS l1 FROM u",
    "sq8_quantize": "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS s FROM embeddings) SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(e, lambda x: CAST(least(127, greatest(-127, round_even(x / s, 0))) AS INTEGER)), ',') AS qv FROM q",
    "sq8_quality": f"WITH {_UNIT}, v AS (SELECT list_transform(e, lambda x: x / n) AS v FROM u), q AS (SELECT v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM v), r AS (SELECT v, list_transform(v, lambda x: s * round_even(x / s, 0)) AS b FROM q), c AS (SELECT list_dot_product(v, b) / sqrt(list_dot_product(v, v) * list_dot_product(b, b)) AS c FROM r) SELECT round(min(c), 6) AS least, round(avg(c), 6) AS mean FROM c",
    "vector_truncation": f"WITH {_UNIT} SELECT vec_id, CAST(1.0 AS DOUBLE) AS cosine, round(list_dot_product(e[1:32], e[1:32]) / (n * n), 6) AS kept FROM u",
    "knn_exact": f"WITH {_KNN.format(where=_Q20, k=10)} SELECT query_id, rank, id, round(sim, 6) AS sim FROM knn",
    "centroid_assign": "WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label AS c, list(x ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1), r AS (SELECT vec_id, label, c, round(list_dot_product(CAST(embedding AS DOUBLE[]), e), 9) AS s FROM embeddings, c), b AS (SELECT label, c AS assigned FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) = 1) SELECT label, assigned, count(*) AS n FROM b GROUP BY 1, 2",
    "bm25_topk": f"WITH {_BM25.format(k=10)} SELECT query_id, rank, id, score FROM bm",
    "index_search": f"WITH {_KNN.format(where=_Q20, k=10)} SELECT query_id, rank, id, round(sim, 6) AS sim FROM knn",
    "fielded_bm25": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(split_part(text, chr(10), 1), '')), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS b FROM documents),
size AS (SELECT count(*) AS n, avg(len(a)) AS ma, avg(len(b)) AS mb FROM w), asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
t AS (SELECT id, unnest(a) AS term, 3.0::DOUBLE / (1 - 0.75 + 0.75 * len(a) / ma) AS one FROM w, size UNION ALL SELECT id, unnest(b), 1.0::DOUBLE / (1 - 0.75 + 0.75 * len(b) / mb) FROM w, size),
p AS (SELECT id, term, sum(one) AS tf FROM t WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) AS score FROM p JOIN f USING (term) JOIN asked USING (term), size GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= 10""",
    "hybrid_blend": f"""WITH {_KNN.format(where='q.vec_id IN (SELECT item_id FROM benchmark)', k=30)}, {_BM25.format(k=30)},
a AS (SELECT query_id, id, sim, min(sim) OVER w AS lo, CASE WHEN max(sim) OVER w = 0 THEN 1.0 ELSE max(sim) OVER w END AS hi FROM knn WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, id, score, min(score) OVER w AS lo, CASE WHEN max(score) OVER w = 0 THEN 1.0 ELSE max(score) OVER w END AS hi FROM bm WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(0.7 * coalesce((sim - a.lo) / CASE WHEN a.hi = a.lo THEN 1.0 ELSE a.hi - a.lo END, 0.0) + 0.3 * coalesce((score - b.lo) / CASE WHEN b.hi = b.lo THEN 1.0 ELSE b.hi - b.lo END, 0.0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM m QUALIFY rank <= 10""",
    "ranking_metrics": f"WITH {_KNN.format(where=_Q20, k=50)}, {_POS}, f AS (SELECT rank FROM pos LEFT JOIN knn USING (query_id, id)) SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_{k}" for k in (1, 5, 10, 50)) + " FROM f",
    "hard_negatives": f"WITH {_KNN.format(where=_Q20, k=31)}, {_POS}, r AS (SELECT k.query_id, p.id AS positive, k.id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) AS k FROM knn k JOIN pos p ON k.query_id = p.query_id AND k.id <> p.id), n AS (SELECT r.* FROM r JOIN u a ON a.vec_id = r.id JOIN u b ON b.vec_id = positive WHERE k > 3 AND k <= 30 AND round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) <= 0.95) SELECT query_id, positive, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || '-' || id), id) AS INTEGER) AS pick FROM n QUALIFY pick <= 3",
    "metadata_facets": f"WITH {_CAT}, c AS (SELECT *, md5(c_name) AS h FROM cat) SELECT c_custkey, c_name AS idno, {_UUID} AS idno_uuid, c_mktsegment AS source, least(n_name, r_name) || ';' || greatest(n_name, r_name) AS geographies, CAST(year(a) AS INTEGER) AS year_start, CAST(year(b) AS INTEGER) AS year_end, CASE WHEN year(a) = year(b) THEN 1 ELSE 2 END AS n_years, CASE WHEN c_custkey % 2 = 0 THEN 'By customer' ELSE 'A survey' END AS abstract FROM c",
    "text_units": f"WITH {_CAT}, t AS (SELECT c_custkey, 'idno' AS field, c_name AS text FROM cat UNION ALL SELECT c_custkey, 'abstract', CASE WHEN c_custkey % 2 = 0 THEN 'By customer' ELSE 'A survey' END FROM cat) SELECT *, md5(c_custkey || '__' || field || '__' || text) AS uuid FROM t",
    "record_serialization": r"WITH t AS (SELECT p_partkey, 'name: ' || left(p_name, 40) || chr(10) || 'brand: ' || p_brand || chr(10) || 'type: ' || p_type || chr(10) || 'size: ' || p_size AS t FROM part) SELECT p_partkey, CASE WHEN length(t) <= 45 THEN t ELSE regexp_replace(left(t, 45), '\s+\S*$', '') END AS text, CAST(length(t) AS INTEGER) AS n_permuted FROM t",
    "elastic_serialization": r"""WITH f AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, split_part(coalesce(text, ''), chr(10), 1) AS a, coalesce(text, '') AS b, 40 + doc_id % 400 * 10 AS total FROM documents),
n AS (SELECT *, greatest(0, total - greatest(0, CAST(s <> '' AS INTEGER) + CAST(l <> '' AS INTEGER) + CAST(a <> '' AS INTEGER) + CAST(b <> '' AS INTEGER) - 1) - CASE WHEN s <> '' THEN 8 + length(s) ELSE 0 END - CASE WHEN l <> '' THEN 6 + length(l) ELSE 0 END - CASE WHEN a <> '' THEN 7 ELSE 0 END - CASE WHEN b <> '' THEN 6 ELSE 0 END) AS room FROM f),
x AS (SELECT *, least(length(a), room // 2) AS ta FROM n), y AS (SELECT *, least(length(b), room - ta) AS tb FROM x),
c AS (SELECT *, CASE WHEN ta < length(a) THEN regexp_replace(regexp_replace(left(a, ta), ' [^ ]*\z', ''), '[ \t\r\n]+\z', '') ELSE a END AS ca, CASE WHEN tb < length(b) THEN regexp_replace(regexp_replace(left(b, tb), ' [^ ]*\z', ''), '[ \t\r\n]+\z', '') ELSE b END AS cb FROM y),
t AS (SELECT doc_id, concat_ws(chr(10), CASE WHEN s <> '' THEN 'source: ' || s END, CASE WHEN a <> '' THEN 'title: ' || ca END, CASE WHEN l <> '' THEN 'lang: ' || l END, CASE WHEN b <> '' THEN 'text: ' || cb END) AS t FROM c)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM t""",
    "facet_plan": "WITH k AS (SELECT p_partkey, unnest(['en', 'fr']) AS lang, CASE WHEN p_size % 2 = 0 THEN ['keyword', 'natural'] WHEN p_partkey % 3 = 0 THEN ['keyword', 'unit', 'geo_year'] ELSE ['keyword', 'unit'] END AS f FROM part), m AS (SELECT p_partkey, lang, list_transform(list_sort(list_transform(f, lambda x: md5(p_partkey || '|' || lang || '|' || x) || x)), lambda x: x[33:]) AS f FROM k) SELECT p_partkey, lang, array_to_string(list_transform(range(5), lambda i: f[i % len(f) + 1]), ',') AS facets FROM m",
    "metadata_coverage": "SELECT 'status' AS field, count(*) FILTER (o_orderstatus <> 'F') AS present, round(avg(CAST(o_orderstatus <> 'F' AS INTEGER)), 6) AS share FROM orders UNION ALL SELECT 'price', count(*) FILTER (o_totalprice > 100000), round(avg(CAST(o_totalprice > 100000 AS INTEGER)), 6) FROM orders UNION ALL SELECT 'o_orderpriority', count(*), 1.0 FROM orders",
    "dotted_path_json": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS none, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "null_fill": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END AS s, CASE WHEN o_orderkey % 2 > 0 THEN o_custkey ELSE 0 END AS c, CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 0 END AS p FROM orders",
    "html_blocks": r"WITH p AS (SELECT page_id, string_split(html, '<p>')[2:] AS p FROM pages), c AS (SELECT page_id, list_transform(p, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '(?s)(</?(p|div|ul|h1|article|footer|form|nav|aside)\b).*', ''), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS p FROM p), b AS (SELECT page_id, list_filter(list_transform(p, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM c) SELECT page_id, CAST(len(b) AS BIGINT) AS n_blocks, md5(array_to_string(b, chr(10))) AS blocks_md5 FROM b",
    "iou_pairs": "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_linestatus, (l_partkey % 10) / 20.0 AS x1, (l_suppkey % 10) / 20.0 AS y1, (l_partkey % 10) / 20.0 + 0.1 + l_quantity / 100 AS x2, (l_suppkey % 10) / 20.0 + 0.1 + l_quantity / 100 AS y2 FROM lineitem), j AS (SELECT g.page, g.id AS g, p.id AS p, greatest(0.0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0.0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS o, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa FROM b g JOIN b p ON g.page = p.page WHERE g.l_linestatus = 'F' AND p.l_linestatus <> 'F') SELECT page, g, p, round(o / (ga + pa - o), 6) AS iou FROM j WHERE o / (ga + pa - o) >= 0.3",
}
