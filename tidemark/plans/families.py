"""Queries on merged clusters, name families, annotated pages, request rows, result lists and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import annotation as an
from tidemark.operators import explanations as ex
from tidemark.operators import families as fa
from tidemark.operators import gates as ga
from tidemark.operators import harmonize as hz
from tidemark.operators import search as se
from tidemark.plans.text import ORACLE as TEXT_SQL
from tidemark.sources.tables import table


def _clusters(spark, d):
    """Parts of a brand and type as clusters: their names' counts as forms."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type", "p_name").agg(F.count("*").alias("n"), F.max("p_size").alias("s"))
    return p.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("name"), F.min(F.col("s") % 3).alias("rank"), F.max(F.col("s") / 100).alias("confidence"), F.sum("n").alias("count"), F.map_from_entries(F.collect_list(F.struct("p_name", "n"))).alias("forms"), F.collect_set("s").alias("pages"))


def merged_clusters(spark, d):
    m = fa.merge_clusters(_clusters(spark, d), "p_brand", ["pages"])
    return m.select("p_brand", "name", "rank", "count", "n_merged", F.array_join(F.transform(F.map_entries("forms"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("forms"), F.array_join("pages", ",").alias("pages"))


def similar_clusters(spark, d):
    c = _clusters(spark, d).withColumn("name", F.concat_ws(" ", F.initcap("name"), F.initcap("p_type")))
    one = c.groupBy("name").agg(F.min("rank").alias("rank"), F.max("confidence").alias("confidence"), F.sum("count").alias("count"), F.first("forms").alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    return fa.merge_similar_clusters(one, ["pages"]).select("name", "count", "n_merged")


def acronym_sets(spark, d):
    p = table(spark, d, "part").select("p_name", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(F.lit(" ")).alias("a"))
    return fa.acronym_map(p, "p_name", "a").select("p_name", F.array_join("acronyms", ",").alias("acronyms"))


def boosted_names(spark, d):
    p = table(spark, d, "part").where("p_size % 4 = 0").select(F.concat_ws(" ", "p_name", "p_type").alias("n"), F.concat_ws("-", "p_brand", "p_size").alias("a"))
    pairs = hz.similar_names(p.select("n").distinct(), "n", "n", 0.6)
    return fa.boost_acronyms(pairs, fa.acronym_map(p, "n", "a"), "n").select("a", "b", F.round("similarity", 6).alias("similarity"))


def absorbed_families(spark, d):
    """Parts as families in the order of their keys: a type's beginning as acronym of some."""
    p = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("s"))
    f = p.select("k", F.concat_ws(" ", "p_name", "p_type").alias("name"), F.when(F.col("s") % 3 == 0, F.substring("p_type", 1, 3)).alias("acronym"))
    return fa.absorb_acronyms(f, "k", "name", "acronym")


def family_keys(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("ord"), F.min("p_name").alias("name"), F.collect_set(F.lower("p_name")).alias("variants"), F.min(F.when(F.col("p_size") % 2 == 0, F.substring("p_type", 1, 4))).alias("acronym"))
    return fa.family_keys(p.withColumn("base", F.lower("name")))


def consolidated_families(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("name"), F.collect_set("p_type").alias("aliases")).withColumn("base", F.lower("name"))
    keys = p.groupBy("base").agg(F.min("p_brand").alias("canonical")).where("substring(canonical, -1) < '3'").select(F.col("base").alias("key"), "canonical")
    return fa.consolidate(p, keys).select("target", F.array_join("aliases", ",").alias("aliases"), "n_families")


def country_prototypes(spark, d):
    """Names of parts by brand as names by country."""
    p = table(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_size").alias("n"), "p_partkey")
    return hz.prototypes(p, "p_brand", "name", "n", "p_partkey", 0.6).select("p_brand", "prototype", "n", F.array_join("aliases", ",").alias("aliases"))


def best_entities(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("confidence")))).alias("e"))
    none = F.slice("e", 1, 0)
    return l.select("l_orderkey", ga.best_entity(ga.entities(none, F.when(F.col("l_orderkey") % 2 == 0, F.col("e")), F.slice("e", 1, 1)))["k"].alias("line"))


def annotated_pages(spark, d):
    """Order lines as an annotation tool's tasks, the newest of a page kept."""
    l = table(spark, d, "lineitem").where("l_linenumber <= 3").dropDuplicates(["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"), F.max("l_linenumber").alias("m"))
    rect = F.transform("n", lambda k: F.struct(k.cast("string").alias("id"), F.lit("Table").alias("label"), (k * 10.0).alias("x"), (k * 20.0).alias("y"), F.lit(50.0).alias("width"), F.lit(60.0).alias("height")))
    task = lambda when, results: F.to_json(F.struct(F.concat(F.lit("d"), F.col("l_orderkey") % 50).alias("file"), F.col("l_orderkey").cast("int").alias("page"), F.lit(when).alias("updated"), results.alias("results")))
    tasks = l.select(task("2020", F.slice(rect, 1, 1)).alias("t")).union(l.where("m > 1").select(task("2021", rect).alias("t")))
    pages = an.pages_of_tasks(tasks, "t")
    return pages.select("doc_id", "page", F.size("objects").alias("n"), F.round(F.element_at("objects", -1)["box"][2], 6).alias("x2"), F.round(F.element_at("objects", -1)["box"][3], 6).alias("y2"))


def prediction_tasks(spark, d):
    l = table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    pages = l.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("id"), F.lit("Figure").alias("label"), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.6), F.lit(0.9)).alias("box")))).alias("objects")).withColumn("doc_id", F.lit("d"))
    t = an.tasks_of_pages(pages, "m")
    return t.select("page", F.get_json_object("task", "$.meta.page").cast("long").alias("of"), F.get_json_object("task", "$.predictions[0].result[0].id").alias("first"), F.round(F.get_json_object("task", "$.predictions[0].result[0].value.rect.height").cast("double"), 6).alias("height"), F.get_json_object("task", "$.predictions[0].result[0].value.rectanglelabels[0]").alias("label"))


def _pages(spark, d, flag):
    l = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return l.groupBy((F.col("l_orderkey") % 40).alias("doc_id"), F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "Table").otherwise("Figure").alias("label")))).alias("objects"))


def tables_by_document(spark, d):
    pages = _pages(spark, d, "A").withColumn("objects", an.with_label(F.col("objects"), "Table"))
    docs = spark.range(45).select(F.col("id").alias("doc_id"))
    both = an.annotations_by_document(docs, pages)
    return both.select("doc_id", F.size("pages").alias("n_pages"), F.aggregate("pages", F.lit(0), lambda s, p: s + F.size(p["objects"])).alias("n_tables"))


def last_pages(spark, d):
    pages = _pages(spark, d, "A").withColumn("page", F.col("page") % 3)
    return an.by_document(pages.withColumn("o", F.col("objects")[0]["id"]), "o").select("doc_id", F.array_join(F.transform(F.map_entries("pages"), lambda e: F.concat_ws(":", e["key"], e["value"][0]["id"])), ",").alias("pages"))


def document_mismatch(spark, d):
    return an.mismatches(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def kept_predictions(spark, d):
    out = spark.range(10).select(F.col("id").alias("doc_id"))
    return an.prediction_objects(_pages(spark, d, "R"), out).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def first_documents(spark, d):
    c = table(spark, d, "customer")
    return an.first_documents(c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("k"), F.lit("even").alias("src")).distinct(), c.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"), F.lit("third").alias("src")).distinct(), "k")


def coerced_labels(spark, d):
    p = table(spark, d, "part")
    label = F.when(F.col("p_size") % 4 == 0, " Figure").when(F.col("p_size") % 4 == 1, "CHART").when(F.col("p_size") % 4 == 2, "tab").otherwise("note")
    return p.select("p_partkey", an.table_or_figure(label, {"chart": "Figure", "tab": "Table"}).alias("label"))


def page_groups(spark, d):
    return an.page_groups(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


def request_rows(spark, d):
    """Requests in both layouts, read back field by field."""
    o = table(spark, d, "orders")
    i, p, schema = F.concat(F.lit("a1"), "o_orderkey"), F.concat(F.lit('Say "'), "o_orderpriority", F.lit('"')), '{"type":"array","minItems":2,"maxItems":3}'
    r = o.select("o_orderkey", ex.generate_content_request(i, p, "sys", schema).alias("g"), ex.message_request(i, "m", p, "sys", schema).alias("m"))
    at = lambda c, q, name: F.get_json_object(c, q).alias(name)
    return r.select("o_orderkey", at("g", "$.key", "g_id"), at("g", "$.request.contents[0].parts[0].text", "g_text"), at("g", "$.request.generation_config.responseJsonSchema.minItems", "g_least"), at("m", "$.custom_id", "m_id"), at("m", "$.params.messages[0].content", "m_text"), at("m", "$.params.output_config.format.schema.minItems", "m_least"), at("m", "$.params.output_config.format.schema.maxItems", "m_most"))


def answer_texts(spark, d):
    o = table(spark, d, "orders")
    part = F.struct(F.col("o_orderpriority").alias("text"))
    g = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    block = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("o_orderstatus").alias("text"))
    m = F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 == 0, "errored").otherwise("succeeded").alias("type"), F.struct(F.array(block("text"), block("tool"), block("text")).alias("content")).alias("message")).alias("result")))
    return o.select("o_orderkey", ex.candidate_text(g).alias("candidate"), ex.message_text(m).alias("message"))


def settled_explanations(spark, d):
    """Priorities and states of customers' orders as two explainers' answers of a year."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    one = lambda c, t: o.where(t).groupBy("o_custkey", "y").agg(F.min(c).alias("v"))
    grouped = ex.by_context({"a": one("o_orderpriority", "o_orderkey % 2 = 0"), "b": one("o_orderstatus", "true")}, ["o_custkey", "y"], "v", "v")
    done = ex.settled(grouped, F.when(F.col("o_custkey") % 2 == 0, F.lit("judged")))
    return done.select("o_custkey", "y", "value", "source", F.md5(ex.arbiter_prompt(F.lit("i"), F.lit("g"), F.col("y").cast("string"), F.transform("explanations", lambda e: e["value"]))).alias("prompt_md5"))


def feedback_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("q"), F.col("o_orderstatus"))).alias("facets"))
    done = ex.with_defaults(ex.feedback_row(o, ["o_custkey", "o_orderkey"], ["facets"]), {"verdict": F.lit("open"), "facets": F.lit("")})
    return done.select("o_orderkey", "item_key", "facets", "verdict", ex.window_text(F.array(F.col("o_custkey"), F.col("o_orderkey"))).alias("window"))


def set_operations(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, n: df.groupBy("k").agg(F.count("*").alias("n")).withColumn("operation", F.lit(n))
    return named(a.union(b).distinct(), "union").unionByName(named(a.unionAll(b), "union all")).unionByName(named(a.intersect(b), "intersect")).unionByName(named(a.exceptAll(b), "except all")).unionByName(named(a.subtract(b), "except"))


def word_recall(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(se.token_recall(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws("-", F.lower("p_type"), "p_name")), 6).alias("recall"))


def enriched_results(spark, d):
    """Part names as titles of a result list; a result's own size wins."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("score"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(-1)).cast("bigint").alias("p_size"))
    titles = table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_size").cast("bigint").alias("p_size"))
    return se.formatted(se.enriched(l, titles), 2, "flat", 0.03)


def reranked_results(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max(F.col("l_discount") * 10 - 0.5).alias("z"))
    return se.reranked(l, "z", 2).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def model_board(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("ndcg_10"), F.round(F.avg("l_tax"), 6).alias("mrr"))
    return se.leaderboard(m, "ndcg_10", ["ndcg_10", "mrr"]).drop("sort_key")


def valid_queries(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") * 2).alias("record_id"))
    return se.valid_queries(q, table(spark, d, "customer"), "record_id", "c_custkey")


def index_lists(spark, d):
    """An index written and its first three lists read back; no list holds an item that doesn't exist."""
    from tidemark.session import shared_dir

    e = table(spark, d, "embeddings")
    centroids = se.centroids_by_label(e, "label")
    path = f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}-{abs(hash(d)) % 10**6}"
    se.write_index(e.select("vec_id", "embedding"), se.assign(e.select("vec_id", "embedding"), centroids, "label"), centroids, path)
    some = se.read_index(spark, path, [0, 1, 2])
    lost = se.dangling(some, e, "vec_id", "vec_id").count()
    return some.groupBy("list").agg(F.count("*").alias("n"), F.lit(lost).alias("n_dangling"))


QUERIES = {f.__name__: f for f in (
    merged_clusters, similar_clusters, acronym_sets, boosted_names, absorbed_families, family_keys, consolidated_families, country_prototypes, best_entities, annotated_pages, prediction_tasks, tables_by_document, last_pages, document_mismatch, kept_predictions,
    first_documents, coerced_labels, page_groups, request_rows, answer_texts, settled_explanations, feedback_rows, set_operations, word_recall, enriched_results, reranked_results, model_board, valid_queries, index_lists,
)}

_PAGES = "SELECT l_orderkey % 40 AS doc_id, l_orderkey AS page, list(l_linenumber ORDER BY l_linenumber) AS o FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2"

_ALIKE = TEXT_SQL["name_similarity"].replace("FROM part)", "FROM part WHERE p_size % 4 = 0)")

ORACLE = {
    "merged_clusters": "WITH p AS (SELECT p_brand, p_type, p_name, count(*) AS n, max(p_size) AS s FROM part GROUP BY 1, 2, 3), c AS (SELECT p_brand, p_type, min(p_name) AS name, min(s % 3) AS rank, max(s / 100) AS conf, sum(n) AS c FROM p GROUP BY 1, 2), b AS (SELECT p_brand, name, rank FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rank, length(name) DESC, conf DESC, name DESC) = 1), m AS (SELECT p_brand, CAST(sum(c) AS BIGINT) AS count, count(*) AS n_merged FROM c GROUP BY 1), f AS (SELECT p_brand, string_agg(p_name || '=' || n, ',' ORDER BY p_name) AS forms FROM (SELECT p_brand, p_name, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2) GROUP BY 1), g AS (SELECT p_brand, string_agg(s, ',' ORDER BY s) AS pages FROM (SELECT DISTINCT p_brand, s FROM p) GROUP BY 1) SELECT b.p_brand, name, rank, count, n_merged, forms, pages FROM b JOIN m USING (p_brand) JOIN f USING (p_brand) JOIN g USING (p_brand)",
    "acronym_sets": "SELECT p_name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS acronyms FROM part WHERE p_size % 4 = 0 GROUP BY 1",
    "boosted_names": f"WITH p AS (SELECT DISTINCT p_name || ' ' || p_type AS n, p_brand || '-' || p_size AS a FROM part WHERE p_size % 4 = 0), alike AS ({_ALIKE}), x AS (SELECT a, b, similarity AS s FROM alike UNION ALL SELECT a.n, b.n, 0.95 FROM p a JOIN p b ON a.a = b.a AND a.n < b.n) SELECT a, b, CAST(max(s) AS DOUBLE) AS similarity FROM x GROUP BY 1, 2",
    "best_entities": "WITH e AS (SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_linenumber % 3 > 0 THEN l_discount ELSE 0 END AS c, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS o FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, o NULLS FIRST) AS p FROM e) SELECT l_orderkey, k AS line FROM r WHERE l_orderkey % 2 = 0 OR p = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, p) = 1",
    "annotated_pages": "WITH l AS (SELECT l_orderkey, max(l_linenumber) AS m, min(l_linenumber) AS f, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), k AS (SELECT l_orderkey, CASE WHEN m > 1 THEN n ELSE 1 END AS n, CASE WHEN m > 1 THEN m ELSE f END AS k FROM l) SELECT 'd' || (l_orderkey % 50) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, CAST(n AS INTEGER) AS n, round(least(1.0, k * 0.1 + 0.5), 6) AS x2, round(least(1.0, k * 0.2 + 0.6), 6) AS y2 FROM k",
    "prediction_tasks": "SELECT l_orderkey AS page, l_orderkey AS of, CAST(min(l_linenumber) AS VARCHAR) AS first, CAST(70.0 AS DOUBLE) AS height, 'Figure' AS label FROM lineitem GROUP BY 1",
    "tables_by_document": f"WITH p AS ({_PAGES.format(f='A')}), s AS (SELECT doc_id, count(*) AS n, sum(len(list_filter(o, lambda x: x % 2 = 0))) AS t FROM p GROUP BY 1) SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_pages, CAST(coalesce(t, 0) AS INTEGER) AS n_tables FROM range(45) d(doc_id) LEFT JOIN s USING (doc_id)",
    "last_pages": f"WITH p AS ({_PAGES.format(f='A')}), m AS (SELECT doc_id, page % 3 AS page, max(o[1]) AS o FROM p GROUP BY 1, 2) SELECT doc_id, string_agg(page || ':' || o, ',' ORDER BY page) AS pages FROM m GROUP BY 1",
    "document_mismatch": "SELECT DISTINCT c_custkey AS k, 'truth' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT DISTINCT o_custkey, 'found' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "kept_predictions": "SELECT l_orderkey % 40 AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Table' ELSE 'Figure' END AS label, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 40 >= 10 GROUP BY 1, 2",
    "first_documents": "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey % 3 = 0) SELECT k, 'even' AS src FROM a UNION ALL SELECT k, 'third' FROM b WHERE k NOT IN (SELECT k FROM a)",
    "coerced_labels": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Figure' WHEN 2 THEN 'Table' END AS label FROM part",
    "page_groups": "SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS BIGINT) AS \"group\" FROM orders",
    "request_rows": "SELECT o_orderkey, 'a1' || o_orderkey AS g_id, 'Say \"' || o_orderpriority || '\"' AS g_text, '2' AS g_least, 'a1' || o_orderkey AS m_id, 'Say \"' || o_orderpriority || '\"' AS m_text, '1' AS m_least, CAST(NULL AS VARCHAR) AS m_most FROM orders",
    "answer_texts": "SELECT o_orderkey, o_orderpriority AS candidate, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || o_orderstatus END AS message FROM orders",
    "settled_explanations": "WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderstatus) AS v FROM orders GROUP BY 1, 2), u AS (SELECT o_custkey, y, v, 'a' AS p FROM a UNION ALL SELECT o_custkey, y, v, 'b' FROM b), g AS (SELECT o_custkey, y, list(v ORDER BY v, p) AS v FROM u GROUP BY 1, 2) SELECT o_custkey, CAST(y AS INTEGER) AS y, CASE WHEN len(v) < 2 THEN v[1] WHEN o_custkey % 2 = 0 THEN 'judged' ELSE v[1] END AS value, CASE WHEN len(v) < 2 THEN 'single_explainer' WHEN o_custkey % 2 = 0 THEN 'arbiter' ELSE 'fallback' END AS source, md5('Indicator: i' || chr(10) || 'Geography: g' || chr(10) || 'Window: ' || y || chr(10) || 'Explanations:' || chr(10) || '[\"' || array_to_string(v, '\",\"') || '\"]') AS prompt_md5 FROM g",
    "feedback_rows": """SELECT o_orderkey, o_custkey || '|' || o_orderkey AS item_key, CASE WHEN o_orderkey % 2 = 0 THEN '{"q":"' || o_orderstatus || '"}' ELSE '{}' END AS facets, 'open' AS verdict, o_custkey || '-' || o_orderkey AS window FROM orders""",
    "set_operations": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT k, count(*) AS n, 'union' AS operation FROM (SELECT k FROM a UNION SELECT k FROM b) GROUP BY 1 UNION ALL SELECT k, count(*), 'union all' FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY 1 UNION ALL SELECT k, count(*), 'intersect' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) GROUP BY 1 UNION ALL SELECT k, count(*), 'except all' FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) GROUP BY 1 UNION ALL SELECT k, count(*), 'except' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) GROUP BY 1",
    "word_recall": r"WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\p{L}\p{N}]+')) AS q, regexp_extract_all(lower(lower(p_type) || '-' || p_name), '[\p{L}\p{N}]+') AS r FROM part) SELECT p_partkey, round(len(list_intersect(q, r)) / len(q), 6) AS recall FROM w",
    "enriched_results": "SELECT l_orderkey AS query_id, l_partkey AS id, l_linenumber AS rank, l_discount AS score, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE p_size END AS p_size, p_name, 'flat' AS source FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 > 0 WHERE l_discount >= 0.03 AND l_linenumber <= 2",
    "reranked_results": "WITH l AS (SELECT l_orderkey, l_partkey, max(l_discount * 10 - 0.5) AS z FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY z DESC, l_partkey) AS k FROM l) SELECT l_orderkey AS query_id, l_partkey AS id, CAST(k AS INTEGER) AS rank, round(1 / (1 + exp(-z)), 6) AS score FROM r WHERE k <= 2",
    "model_board": "WITH m AS (SELECT l_returnflag || l_linestatus AS model, round(avg(l_discount), 6) AS ndcg_10, round(avg(l_tax), 6) AS mrr FROM lineitem GROUP BY 1) SELECT *, ndcg_10 = max(ndcg_10) OVER () AS ndcg_10_best, mrr = max(mrr) OVER () AS mrr_best FROM m",
    "valid_queries": "SELECT o_orderkey AS query_id, o_custkey * 2 AS record_id FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)",
}
