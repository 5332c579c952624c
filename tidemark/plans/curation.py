"""Queries on chunks, budgets, dictionaries, judgements and composite pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import curation as cu
from tidemark.operators import search as se
from tidemark.operators import timeseries as ts
from tidemark.plans.anomaly import RANGES_SQL, event_series
from tidemark.plans.retrieval import _BM25, _UNIT
from tidemark.sources.tables import table


def joined_paragraphs(spark, d):
    done = cu.with_paragraphs(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.length("paragraphs").alias("n_chars"), F.size(F.split("paragraphs", "\n")).alias("n_lines"))


def bounded_chunks(spark, d):
    return cu.with_chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk", "offset", F.length("chunk_text").alias("n_chars"))


def merged_spans(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + 5).alias("e"), "l_discount", "l_linenumber")
    return cu.merge_spans(l, ["l_orderkey"], "l_returnflag", "s", "e", "l_discount", "l_linenumber")


def best_at_span(spark, d):
    l = table(spark, d, "lineitem")
    l = l.withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return cu.best_at_span(l, ["l_partkey", "l_returnflag"], "l_quantity", "l_discount", "o").groupBy("l_partkey", "l_returnflag").agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))


def fair_shares(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(cu.fair_shares(F.array(F.length("p_name"), F.length("p_type"), F.length("p_brand"), F.col("p_size")), 30), ",").alias("shares"))


def token_budget_parts(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (10 + F.col("l_quantity")).alias("t"))
    return cu.token_budget_parts(l, ["l_orderkey"], "l_linenumber", "t", 60).groupBy("l_orderkey", "part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def smart_batches(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    return cu.smart_batches(s, "l_returnflag", "l_partkey", "n", 30, 12).groupBy("l_returnflag", "batch").agg(F.sum("n").alias("n"), F.count("*").alias("clusters"))


def acronym_fields(spark, d):
    p = table(spark, d, "part")
    field = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), F.upper(F.substring("p_name", 1, 3)), F.lit('", "'), "p_type", F.lit('"]'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("['"), "p_type", F.lit("', 'ZZ']"))).otherwise(F.concat(F.upper(F.substring("p_name", 1, 2)), F.lit("; "), "p_type"))
    found = p.withColumn("a", cu.listed_acronyms(field))
    return found.select("p_partkey", F.array_join("a", "|").alias("listed"), cu.plausible_acronym(F.col("p_name"), F.col("a")).alias("chosen"), cu.is_subsequence_acronym(F.substring("p_name", 1, 2), F.col("p_name")).alias("valid"))


def title_names(spark, d):
    return table(spark, d, "part").select("p_partkey", cu.title_case(F.concat_ws(" of THE ", "p_name", F.lit("GGI"), F.lower("p_type"))).alias("title"))


def detected_forms(spark, d):
    forms = table(spark, d, "nation").select(F.regexp_replace("n_name", "_", " ").alias("form"), "n_name", "n_nationkey").toDF("form", "name", "ord")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Survey of "), F.regexp_replace("n_name", "_", " "), F.when(F.col("c_custkey") % 2 == 0, F.lit(", Nation 3!")).otherwise(F.lit(".")), F.when(F.col("c_custkey") % 5 == 0, F.lit("x")).otherwise(F.lit("")))
    return cu.detect_form(c.select("c_custkey", text.alias("text")), "text", forms).select("c_custkey", "detected")


def offline_queries(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.array_join(cu.heuristic_queries(F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 == 0, "Asia"), F.when(F.col("o_custkey") % 3 == 0, F.year("o_orderdate").cast("string"))), "|").alias("queries"))


def judged_rankings(spark, d):
    b = table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    docs = table(spark, d, "documents")
    ranked = se.bm25(docs, b)
    texts = ranked.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("record")), "id").join(b, "query_id")
    return cu.judged_at(ranked, texts.select("query_id", "id", cu.heuristic_judgement(F.col("text"), F.col("record")).alias("judgement")))


def sanitized_boxes(spark, d):
    l = table(spark, d, "lineitem")
    box = F.array(F.col("l_extendedprice") % 1200, F.col("l_partkey") % 1000.0, F.col("l_quantity") * 20, F.col("l_suppkey") * 9.0)
    return l.select("l_orderkey", "l_linenumber", cu.sanitized(box).alias("b")).select("l_orderkey", "l_linenumber", *[F.round(F.col("b")[k], 6).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def merged_pages(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_linenumber")).alias("objects"))
    side = lambda f: l.where(F.col("l_returnflag") == f).select("l_orderkey", "objects")
    return cu.merge_pages(side("A"), side("N"), "l_orderkey", "objects").select("l_orderkey", F.array_join("objects", ",").alias("objects"))


def batch_consistency(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.lit(1))
    return cu.consistent(o, ["year", "o_orderstatus", "o_orderpriority"])


def variable_groups(spark, d):
    return cu.group_variables(table(spark, d, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 40).cast("int")), "block", "vec_id", "embedding")


def cluster_representatives(spark, d):
    return cu.representatives(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def review_export(spark, d):
    series = event_series(spark, d)
    keys = ["indicator_id", "geography_id", "window_start", "window_end"]
    ranges = ts.anomaly_ranges(series)
    told = ranges.where("window_start % 2 = 0").select(*keys, F.lit("rule").alias("provider"), F.lit("data_error").alias("classification"), F.lit(None).cast("double").alias("confidence"))
    items = cu.review_items(ranges, ts.review_padding(series, ranges), told, keys)
    return items.select(*keys, F.size("timeseries").alias("n_points"), F.size("explainers").alias("n_explainers"), F.get("explainers", F.lit(0))["confidence"].alias("confidence"))


def mention_dedup(spark, d):
    """Mentions of names in orders: lines of an order are spans of a page."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.initcap("p_name"), F.initcap("p_type")).alias("text"), F.length("p_name").alias("length"))
    l = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    m = l.select("l_orderkey", "text", (F.col("l_linenumber") * 8).alias("start"), (F.col("l_linenumber") * 8 + F.col("length")).alias("end"), F.col("l_discount").alias("score"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("rank"))
    return cu.dedup_mentions(m, ["l_orderkey"]).select("canonical", "n", F.size("forms").alias("n_forms"))


def mapped_documents(spark, d):
    o = table(spark, d, "orders")
    payload = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("topics")).alias("doc"), F.col("o_orderstatus").alias("status"), F.lit("x").alias("extra")))
    done = cu.map_document(o.select("o_orderkey", payload.alias("p")), {"idno": "doc.id", "topics": "doc.topics", "none": "doc.absent"}, "p")
    return done.select("o_orderkey", "idno", "topics", "none", F.array_join(F.array_sort(F.map_keys("additional")), ",").alias("rest"))


QUERIES = {f.__name__: f for f in (
    joined_paragraphs, bounded_chunks, merged_spans, best_at_span, fair_shares, token_budget_parts, smart_batches, acronym_fields, title_names, detected_forms, offline_queries, judged_rankings, sanitized_boxes, merged_pages,
    batch_consistency, variable_groups, cluster_representatives, review_export, mention_dedup, mapped_documents,
)}

_WORDS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"

ORACLE = {
    "merged_spans": "SELECT l_orderkey, l_returnflag, min(l_linenumber) * 10 AS s, min(l_linenumber) * 10 + 5 AS e, max(l_discount) AS l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "best_at_span": "SELECT l_partkey, l_returnflag, l_quantity AS quantity, l_discount AS discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity DESC, l_discount DESC, l_orderkey * 10 + l_linenumber) = 1",
    "smart_batches": "WITH s AS (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag, n <= 12 ORDER BY n DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY l_returnflag, n <= 12 ORDER BY n DESC, l_partkey) AS k FROM s) SELECT l_returnflag, CASE WHEN n <= 12 THEN 's' || CAST(CAST(floor(before / 30) AS BIGINT) AS VARCHAR) ELSE 'l' || k END AS batch, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters FROM r GROUP BY 1, 2",
    "title_names": "WITH w AS (SELECT p_partkey, string_split(p_name || ' of THE GGI of THE ' || lower(p_type), ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN regexp_full_match(x, '[A-Z0-9]{2,6}') THEN x WHEN i > 1 AND lower(x) IN ('of', 'the', 'and', 'for', 'in', 'on', 'at', 'to', 'by', 'a', 'an') THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ') AS title FROM w",
    "detected_forms": r"WITH t AS (SELECT c_custkey, ' survey of ' || lower(replace(n_name, '_', ' ')) || CASE WHEN c_custkey % 2 = 0 THEN ' nation 3 ' ELSE ' ' END || CASE WHEN c_custkey % 5 = 0 THEN 'x ' ELSE '' END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT t.c_custkey, arg_min(n_name, n_nationkey) AS detected FROM t JOIN nation ON contains(t.t, ' ' || lower(replace(n_name, '_', ' ')) || ' ') GROUP BY 1) SELECT t.c_custkey, detected FROM t LEFT JOIN f USING (c_custkey)",
    "offline_queries": "SELECT o_orderkey, o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN '|' || o_orderpriority || ' in Asia' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '|' || o_orderpriority || ' ' || year(o_orderdate) ELSE '' END AS queries FROM orders",
    "judged_rankings": f"WITH {_BM25.format(k=10)}, j AS (SELECT query_id, least(3, round_even(4.0 * len(list_intersect({_WORDS.format(x='b.text')}, {_WORDS.format(x='d.text')})) / greatest(len({_WORDS.format(x='b.text')}), 1), 0)) AS j FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id), m AS (SELECT query_id, avg(j) AS m FROM j GROUP BY 1) SELECT count(*) AS n_queries, round(avg(m), 6) AS judged FROM m",
    "sanitized_boxes": "WITH b AS (SELECT l_orderkey, l_linenumber, [l_extendedprice % 1200, CAST(l_partkey % 1000 AS DOUBLE), l_quantity * 20, l_suppkey * 9.0] AS b FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, list_transform(b, lambda x: least(1.0, greatest(0.0, CASE WHEN list_max(b) > 1.5 THEN x / 1000 ELSE x END))) AS c FROM b), o AS (SELECT l_orderkey, l_linenumber, least(c[1], c[3]) AS x1, least(c[2], c[4]) AS y1, greatest(c[1], c[3]) AS x2, greatest(c[2], c[4]) AS y2 FROM c) SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN x1 < x2 AND y1 < y2 THEN round({n}, 6) END AS {n}" for n in ("x1", "y1", "x2", "y2")) + " FROM o",
    "merged_pages": "SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_returnflag, l_linenumber) AS objects FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1",
    "batch_consistency": "SELECT true AS year, count(DISTINCT o_orderstatus) <= 1 AS o_orderstatus, count(DISTINCT o_orderpriority) <= 1 AS o_orderpriority FROM orders",
    "cluster_representatives": f"WITH {_UNIT}, v AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v FROM u), m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM v) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT v.label, vec_id, round(list_cosine_similarity(v, m), 9) AS s FROM v JOIN m ON v.label = m.label) SELECT label, arg_min(vec_id, (-s, vec_id)) AS vec_id, count(*) AS n FROM s GROUP BY 1",
    "review_export": f"WITH {RANGES_SQL} SELECT w.indicator_id, w.geography_id, window_start, window_end, CAST(count(*) AS INTEGER) AS n_points, CASE WHEN window_start % 2 = 0 THEN 1 ELSE 0 END AS n_explainers, CASE WHEN window_start % 2 = 0 THEN CAST(0.0 AS DOUBLE) END AS confidence FROM windows w JOIN series s ON w.indicator_id = s.indicator_id AND w.geography_id = s.geography_id AND period BETWEEN window_start - 5 AND window_end + 5 GROUP BY 1, 2, 3, 4",
    "mapped_documents": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS idno, o_orderpriority || ', ' || o_orderstatus AS topics, CAST(NULL AS VARCHAR) AS none, 'extra,status' AS rest FROM orders",
    "token_budget_parts": "WITH RECURSIVE l AS (SELECT l_orderkey, CAST(10 + l_quantity AS INTEGER) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(10 + l_quantity AS INTEGER)) AS k FROM lineitem), r AS (SELECT l_orderkey, k, t, t AS s, 0 AS part FROM l WHERE k = 1 UNION ALL SELECT l.l_orderkey, l.k, l.t, CASE WHEN r.s + l.t > 60 THEN l.t ELSE r.s + l.t END, CASE WHEN r.s + l.t > 60 THEN r.part + 1 ELSE r.part END FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.k = r.k + 1) SELECT l_orderkey, part, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS n FROM r GROUP BY 1, 2",
}
