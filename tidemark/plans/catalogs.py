"""Queries on gates, headers, studies, variables, places and JSON records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalogs as ca
from tidemark.operators import gates as ga
from tidemark.operators import mapping as mp
from tidemark.operators import templates as te
from tidemark.plans.text import ORACLE as TEXT_SQL
from tidemark.sources.tables import table


def dense_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("b"), F.when(F.col("o_custkey") % 2 > 0, F.col("o_orderstatus")).alias("c"))
    return ga.dense_rows(o, ["a", "b", "c"], 2)


def before_references(spark, d):
    """Lines of an order as pages of a document, some of which begin its references."""
    l = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("page"), F.when(F.col("l_partkey") % 4 == 0, "\n References\n1. A").otherwise("Body text").alias("text")).distinct()
    return ga.before_references(l, "l_orderkey", "page", "text").select("l_orderkey", "page")


def personal_names(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.initcap("c_mktsegment").alias("s"), (F.col("c_custkey") % 6).alias("k"))
    made = F.when(F.col("k") == 0, F.concat(F.lit("Maria "), "s")).when(F.col("k") == 1, F.concat(F.lit("Maria "), "s", F.lit(" (UN)"))).when(F.col("k") == 2, F.concat("s", F.lit(" World Bank"))).when(F.col("k") == 3, F.concat("s", F.lit(" Survey"))).when(F.col("k") == 4, F.lower("s")).otherwise(F.concat(F.lit("Juan de "), "s"))
    return c.select("c_custkey", ga.is_personal_name(made).alias("person"))


def mention_gates(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount") * 10).alias("conf"), F.when(F.col("l_returnflag") == "R", "non-dataset").otherwise("named").alias("tag"), F.when(F.col("l_partkey") % 5 == 0, "na").when(F.col("l_partkey") % 5 == 1, F.lit(None)).otherwise("yes").alias("use"))
    return l.where(ga.confident(F.col("conf"), 0.5) & ga.is_dataset(F.col("tag"), F.lit(None).cast("string")) & ga.is_used(F.col("use"))).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def skip_reasons(spark, d):
    verdict = F.when(F.col("doc_id") % 3 == 0, "NO_DATA")
    return table(spark, d, "documents").select("doc_id", ga.skip_reason(F.col("text"), verdict).alias("reason"))


def self_links(spark, d):
    p = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).when(F.col("p_partkey") % 4 == 2, F.substring("p_name", 1, 3)).otherwise(F.col("p_brand"))
    return p.select("p_partkey", ga.is_self_link(F.col("p_name"), tail).alias("itself"))


def best_relations(spark, d):
    """Spans of orders with suppliers as tails of their lines' relations."""
    l = table(spark, d, "lineitem")
    spans = l.select("l_orderkey", (F.col("l_linenumber") % 2).alias("start"), (F.col("l_linenumber") % 2 + 9).alias("end"), F.lit("Supplier 7 of all").alias("text"))
    told = l.select("l_orderkey", F.lit("has_producer").alias("kind"), (F.col("l_linenumber") % 2).alias("head_start"), (F.col("l_linenumber") % 2 + 9).alias("head_end"), F.when(F.col("l_suppkey") % 7 == 0, "supplier 7 of").otherwise(F.concat(F.lit("Supplier "), "l_suppkey")).alias("tail"), F.col("l_discount").alias("confidence"))
    return ga.best_relations(spans, told, ["l_orderkey"]).drop("text")


def candidate_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 5 == 1, F.upper(F.substring("p_name", 1, 4))).otherwise(F.col("p_name")).alias("name"))
    return ga.candidate_names(p, "name")


_HEADERS = ("Indicator.Code", "Country Code", "ISO-3", "Year", "absZscore_zscore", "Zscore", " Imputed ", "Notes", "VALUE", "outlier_indicator_total")


def header_mapping(spark, d):
    """Ten headers dealt to brands' tables, in the order of parts."""
    names = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return ca.suggest_mappings(table(spark, d, "part").select("p_brand", "p_partkey", names.alias("header")), "p_brand", "p_partkey", "header")


def dictionary_variables(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("n"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_type")).otherwise(F.lit(" ")).alias("l"), F.col("p_brand").alias("x"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"1":"'), "p_type", F.lit('","2":"no"}'))).otherwise(F.lit("broken")).alias("v"))
    return ca.variables(p, "n", "l", "x", "v").select("p_partkey", "variable_name", "label", F.element_at("value_labels", "1").alias("one"))


def listed_variables(spark, d):
    p = table(spark, d, "part")
    category = F.struct(F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise(F.lit("")).alias("catValu"), F.col("p_type").alias("labl"))
    raw = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("labl"), F.struct(F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("qstnlit")).alias("qstn"), F.array(category).alias("catgry")))
    v = p.select("p_partkey", ca.listed_variables(raw).alias("v"))
    return v.select("p_partkey", "v.variable_name", "v.label", "v.description", F.array_join(F.map_values("v.value_labels"), ",").alias("labels"))


def study_rows(spark, d):
    """Answers with one study, a list of two, or themselves."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "survey").otherwise(F.col("o_orderstatus"))
    study = F.struct(F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("S"), "o_custkey").alias("idno")).alias("core_fields"), F.struct(kind.alias("dataset_type")).alias("filters"))
    k = F.col("o_orderkey") % 3
    payload = F.when(k == 0, F.to_json(F.struct(F.lit("success").alias("status"), F.array(study, study).alias("studies")))).when(k == 1, F.to_json(F.struct(F.lit("success").alias("status"), study.alias("study")))).otherwise(F.to_json(study))
    each = o.select("o_orderkey", F.explode(ca.studies(payload)).alias("s")).select("o_orderkey", ca.study_row(F.col("s")).alias("r"))
    return each.groupBy("o_orderkey", "r.id", "r.idno", "r.type").agg(F.count("*").alias("n"))


def pdf_candidates(spark, d):
    p = table(spark, d, "part")
    one = F.struct(F.when(F.col("p_size") % 2 == 0, " Application/PDF").otherwise("text/html").alias("dcformat"), F.when(F.col("p_partkey") % 3 == 0, "0").otherwise("1").alias("is_url"), F.col("p_name").alias("url"))
    payload = F.to_json(F.struct(F.array(one).alias("external_resources"), F.struct(F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("url")).alias("document_description")))
    return p.select("p_partkey", F.array_join(ca.pdf_candidates(payload), ",").alias("urls"))


def json_projection(spark, d):
    o = table(spark, d, "orders")
    payload = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("y")).alias("a"), F.lit("out").alias("b")))
    return o.select("o_orderkey", ca.project_json(payload, ["a.x", "c"]).alias("kept"))


def rating_columns(spark, d):
    o = table(spark, d, "orders")
    answer = F.to_json(F.array(F.struct(F.lit("title").alias("id"), F.lit("ok").alias("analysis"), (F.col("o_custkey") % 5).cast("double").alias("rating")), F.struct(F.lit("abstract").alias("id"), F.lit("ok").alias("analysis"), F.when(F.col("o_orderkey") % 2 == 0, 1.5).alias("rating"))))
    return ca.ratings(o.select("o_orderkey", answer.alias("answer")), "o_orderkey", "answer", ["title", "abstract", "keywords"])


def topic_lists(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.collect_list("p_type").alias("t")).select("p_brand", ca.verticals(F.col("t"), ["PROMO", "ECONOMY", "none"]).alias("verticals"))


def record_numbers(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.concat(F.lit("https://x/curated/en/"), "o_custkey", F.lit("/some-title"))).when(k == 1, F.concat(F.lit(" "), "o_custkey")).when(k == 2, F.concat(F.lit("x?guid="), "o_custkey")).otherwise(F.lit("none"))
    return o.select("o_orderkey", ca.record_number(value).alias("number"))


def code_names(spark, d):
    """Customers' nations by code, with a special case and the code itself where a nation isn't known."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("code"))
    n = table(spark, d, "nation").where("n_nationkey % 5 > 0").select(F.concat(F.lit("N"), "n_nationkey").alias("c"), "n_name")
    return ca.looked_up(c, "code", n, "c", "n_name", "name", {"N3": "World"})


def stripped_places(spark, d):
    n = table(spark, d, "nation")
    forms = ca.place_forms(n.select(F.col("n_nationkey").alias("code"), F.regexp_replace("n_name", "_", " ").alias("name")), table(spark, d, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("population")), least=9_000)
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" ", F.lit("Survey"), F.regexp_replace("n_name", "_", " "), "c_mktsegment", F.lit("Nation 100")).alias("text"))
    return ca.strip_places(c, "text", forms, "base").select("c_custkey", "base")


def study_metadata(spark, d):
    """Documents as studies: with and without a type of their own, with downloads and other resources."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    link = lambda kind, at: F.struct(F.lit(kind).alias("type"), at.alias("download"))
    file = F.struct(F.col("doc_id").alias("resource_id"), F.lit("t").alias("title"), link("download", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("u/"), "doc_id")).otherwise("")).alias("_links"))
    other = F.struct(F.col("doc_id").alias("resource_id"), F.lit("t").alias("title"), link("view", F.lit("v")).alias("_links"))
    study = F.struct(
        F.struct(F.concat(F.lit(" D"), "doc_id").alias("idno")).alias("core_fields"), F.struct(F.lit("survey").alias("dataset_type"), F.col("source").alias("s")).alias("filters"),
        F.struct(F.lit("old").alias("idno"), F.when(F.col("doc_id") % 2 == 0, "TimeSeries").alias("type"), F.col("n_chars").alias("n")).alias("metadata"), F.array(file, other, file).alias("resources"),
    )
    m = t.select("doc_id", ca.study_metadata(F.to_json(study)).alias("m"))
    at = lambda p: F.get_json_object("m", "$." + p)
    return m.select("doc_id", at("idno").alias("idno"), at("type").alias("type"), at("n").cast("bigint").alias("n"), at("_extract_filters.s").alias("source"), at("external_resources[1].url").alias("url"), at("external_resources[0].is_url").alias("is_url"), at("external_resources[2].url").isNull().alias("two"))


def document_records(spark, d):
    """Documents as loosely built JSON: lists as texts, as lists and as numbered entries, mapped to one schema."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    entry = lambda v: F.struct(F.array(v).alias("author"))
    doc = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit(" T  "), "doc_id").alias("display"), F.struct(F.struct(F.lit("T 7").alias("x")).alias("0")).alias("other"), F.col("source").alias("guid"),
        F.struct(entry(F.lit(" B ")).alias("10"), entry(F.lit("A")).alias("2")).alias("authors"), F.concat(F.lit("x, y,x,"), F.coalesce("source", F.lit(""))).alias("theme"), F.array("source", F.lit("y"), F.lit("z")).alias("sector"),
        F.lit("2020-02-03T01:02:03Z").alias("stored"), F.when(F.col("doc_id") % 2 == 0, "English,french").otherwise(" English ").alias("lang"), F.array(F.lit("FRENCH"), F.col("lang")).alias("full"),
        F.when(F.col("doc_id") % 3 == 0, "Chad").when(F.col("doc_id") % 3 == 1, "Chad, Peru").alias("count"), F.lit("TD").alias("code"), F.col("n_chars").alias("a.b"), F.lit("").alias("void"),
    )
    layout = mp.Layout(
        idno="id", title="display", alternates=(mp.Terms("other", "x", ""),), identifiers={"id": "own", "guid": "guid"}, authors=mp.Terms("authors", "author", ""), dates={"modified": ("absent", "stored")},
        themes=(mp.Terms("theme"), mp.Terms("sector")), languages=(mp.Terms("lang"), mp.Terms("full")), country_names="count", country_code="code",
    )
    m = mp.mapped(t.select("doc_id", F.to_json(doc).alias("p")), "p", layout, {"TD": "TCD", "Chad": "TCD", "Peru": "PER"}, {"english": "en", "french": "fr"})
    both = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x[b])), ";")
    return m.select(
        "doc_id", "record.title", "record.alternate_title", both("record.identifiers", "type", "identifier").alias("ids"), F.array_join("record.authors", ";").alias("authors"), "record.modified",
        both("record.themes", "name", "vocabulary").alias("themes"), both("record.languages", "name", "code").alias("languages"), both("record.countries", "name", "code").alias("countries"),
        F.array_join(F.transform(F.map_entries("record.additional"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("additional"),
    )


def typed_records(spark, d):
    """Documents as JSON of three layouts that contradict each other, in one typed layout; the first layout decides where it says anything."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.struct(F.col("doc_id") % 3, "doc_id").alias("o"))
    info = lambda *c: F.struct(*c).alias("info")
    one = F.to_json(F.struct(F.col("doc_id").alias("id"), info("lang", F.col("n_chars").alias("n")), F.array(F.lit("a"), "source").alias("tags")))
    two = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), info("source"), F.lit("one").alias("tags")))
    three = F.to_json(F.struct(F.col("doc_id").alias("id"), F.array("lang").alias("info"), F.array(F.struct(F.col("doc_id").alias("to"))).alias("links")))
    r = t.select("doc_id", "o", F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, two).otherwise(three).alias("p"))
    c = te.conform(r, "p", te.typed_template(r, "p", "o"))
    lost = F.array_join(F.array_sort(F.transform("misfits", lambda m: F.concat_ws("=", m["path"], m["value"]))), ";")
    to = F.array_join(F.transform("record.links", lambda x: x["to"].cast("string")), "|")
    return c.select("doc_id", "record.id", "record.info.lang", F.col("record.info.n").alias("n"), "record.info.source", F.array_join("record.tags", "|").alias("tags"), to.alias("links"), lost.alias("misfits"))


def camel_names(spark, d):
    return table(spark, d, "part").select("p_partkey", ca.camel_name(F.concat_ws(" ", F.lit("of"), F.lower("p_type"), F.lit("OF the x GGI"), "p_name")).alias("name"))


def family_trees(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"), F.array_sort(F.collect_set(F.when(F.col("p_size") > 48, F.col("p_name")))).alias("n"))
    return p.select("p_brand", ca.hierarchy_text(F.col("p_brand"), F.col("t"), F.col("n")).alias("tree"))


def curated_groups(spark, d):
    p = table(spark, d, "part")
    answer = F.to_json(F.struct(F.col("p_type").alias("label"), F.array(F.concat(F.lit(" "), "p_name"), F.lit(""), F.col("p_brand")).alias("variables"), F.lit("d").alias("definition")))
    return p.select("p_partkey", ca.curated_group(answer, F.array("p_name", "p_brand", "p_type"), F.col("p_size")).alias("g")).select("p_partkey", "g.vgid", "g.variables")


def cluster_sizes(spark, d):
    return ca.cluster_map(table(spark, d, "part"), "p_brand", "p_partkey", "p_name").select("p_brand", "n", "tokens", F.element_at("items", 1).alias("first"), F.element_at("items", -1).alias("last"))


def leaf_paths(spark, d):
    o = table(spark, d, "orders").select(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s"), F.array(F.struct(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("k"))).alias("l")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).alias("b"))).alias("p"))
    return ca.leaf_paths(o, "p")


def missing_paths(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.col("props")).alias("p"))
    return ca.missing_paths(e, "p", ["k", "absent"])


QUERIES = {f.__name__: f for f in (
    dense_rows, before_references, personal_names, mention_gates, skip_reasons, self_links, best_relations, candidate_names, header_mapping, dictionary_variables, listed_variables, study_rows, pdf_candidates, json_projection,
    rating_columns, topic_lists, record_numbers, code_names, stripped_places, study_metadata, document_records, typed_records, camel_names, family_trees, curated_groups, cluster_sizes, leaf_paths, missing_paths,
)}

_MAPPED = ", ".join(f"('{h}', '{c}', {k})" for k, (h, c) in enumerate(zip(_HEADERS, ("indicator_id", "geography_id", "", "period", "anomaly_score", "anomaly_score", "is_imputed", "", "value", "outlier_count"), strict=True)))

ORACLE = {
    "document_records": """WITH t AS (SELECT *, coalesce(source, '') AS s FROM documents) SELECT doc_id, 'T ' || doc_id AS title, CASE WHEN doc_id = 7 THEN '' ELSE 'T 7' END AS alternate_title, 'own=' || doc_id || CASE WHEN s = '' THEN '' ELSE ';guid=' || s END AS ids, 'A;B' AS authors, '2020-02-03' AS modified,
'x=theme;y=theme;x=theme' || CASE WHEN s = '' THEN '' ELSE ';' || s || '=theme' END || CASE WHEN s = 'z' THEN '' ELSE ';z=sector' END AS themes,
CASE WHEN doc_id % 2 = 0 THEN 'English=en;french=fr' ELSE 'English=en;FRENCH=fr' END || CASE WHEN coalesce(lang, '') = '' THEN '' ELSE ';' || lang || '=' END AS languages,
CASE doc_id % 3 WHEN 0 THEN 'Chad=TCD' WHEN 1 THEN 'Chad=TCD;Peru=PER' ELSE 'TD=TCD' END AS countries, coalesce('a_b=' || n_chars, '') AS additional FROM t""",
    "study_metadata": "SELECT doc_id, 'D' || doc_id AS idno, CASE WHEN doc_id % 2 = 0 THEN 'indicator' ELSE 'microdata' END AS type, CAST(n_chars AS BIGINT) AS n, source, CASE WHEN doc_id % 5 > 0 THEN 'u/' || doc_id END AS url, CASE WHEN doc_id % 5 > 0 THEN '0' END AS is_url, true AS two FROM documents",
    "typed_records": """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE doc_id END AS id, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') ELSE '' END AS lang, CAST(CASE WHEN doc_id % 3 = 0 THEN coalesce(n_chars, 0) ELSE 0 END AS BIGINT) AS n,
CASE WHEN doc_id % 3 = 1 THEN coalesce(source, '') ELSE '' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'a|' || coalesce(source, '') ELSE '' END AS tags, CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS links,
CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'id="d' || doc_id || '";tags="one"' ELSE 'info=[' || coalesce('"' || lang || '"', 'null') || ']' END AS misfits FROM documents""",
    "dense_rows": "WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS b, CASE WHEN o_custkey % 2 > 0 THEN o_orderstatus END AS c FROM orders) SELECT * FROM o WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2",
    "before_references": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber * 1000000 + l_partkey AS page, l_partkey % 4 = 0 AS r FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) // 2 AS half FROM l), f AS (SELECT *, min(CASE WHEN r AND k >= half THEN k END) OVER (PARTITION BY l_orderkey) AS f FROM k) SELECT l_orderkey, page FROM f WHERE f IS NULL OR k < f",
    "personal_names": "SELECT c_custkey, c_custkey % 6 IN (0, 1) AS person FROM customer",
    "mention_gates": "SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE (l_linenumber % 3 = 0 OR l_discount * 10 >= 0.5) AND l_returnflag <> 'R' AND l_partkey % 5 > 1 GROUP BY 1",
    "skip_reasons": f"WITH g AS ({TEXT_SQL['language_gate']}) SELECT doc_id, CASE WHEN NOT english THEN 'non_english' WHEN doc_id % 3 = 0 THEN 'no_data' END AS reason FROM g",
    "self_links": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN length(substr(p_name, 1, 3)) / length(p_name) > 0.5 ELSE false END AS itself FROM part",
    "best_relations": "WITH r AS (SELECT l_orderkey, l_linenumber % 2 AS start, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'Supplier ' || l_suppkey END AS tail, l_discount AS c FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, start ORDER BY tail IS NULL, c DESC, tail DESC) AS k FROM r) SELECT l_orderkey, start, start + 9 AS \"end\", tail FROM k WHERE k = 1",
    "candidate_names": "WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN upper(substr(p_name, 1, 4)) ELSE p_name END AS name FROM part) SELECT *, length(name) <= 6 AND regexp_full_match(name, '[A-Z0-9-]+') AS is_acronym FROM p WHERE length(name) > 2 AND NOT regexp_full_match(name, '[0-9]+')",
    "header_mapping": f"WITH h(h, c, k) AS (VALUES {_MAPPED}) SELECT p_brand, c AS canonical, arg_min(h, p_partkey) AS source FROM part JOIN h ON p_partkey % 10 = k WHERE c <> '' GROUP BY 1, 2",
    "dictionary_variables": "SELECT p_partkey, trim(p_name) AS variable_name, p_type AS label, CASE WHEN p_size % 2 = 0 THEN p_type END AS one FROM part WHERE p_partkey % 7 > 0",
    "listed_variables": "SELECT p_partkey, p_name AS variable_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS label, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS description, CASE WHEN p_size % 3 > 0 THEN p_type END AS labels FROM part",
    "study_rows": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, 'S' || o_custkey AS idno, CASE WHEN o_orderstatus = 'F' THEN 'microdata' ELSE lower(o_orderstatus) END AS type, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM orders",
    "pdf_candidates": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 > 0 THEN p_brand ELSE '' END AS urls FROM part",
    "json_projection": """SELECT o_orderkey, '{"a":{"x":"' || o_orderpriority || '"}}' AS kept FROM orders""",
    "rating_columns": "SELECT o_orderkey, CAST(o_custkey % 5 AS DOUBLE) AS title_rating, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1.5 AS DOUBLE) END AS abstract_rating, CAST(NULL AS DOUBLE) AS keywords_rating FROM orders",
    "topic_lists": "SELECT p_brand, coalesce(string_agg(DISTINCT CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type END, ';' ORDER BY CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type END), 'N/A') AS verticals FROM part GROUP BY 1",
    "record_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS VARCHAR) END AS number FROM orders",
    "code_names": "SELECT c_custkey, 'N' || c_nationkey AS code, CASE WHEN c_nationkey = 3 THEN 'World' ELSE coalesce(n_name, 'N' || c_nationkey) END AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 > 0",
    "stripped_places": r"WITH f AS (SELECT DISTINCT lower(replace(n_name, '_', ' ')) AS f FROM nation UNION SELECT lower(c_mktsegment) FROM customer WHERE c_acctbal >= 9000), p AS (SELECT '\b(' || string_agg(f, '|' ORDER BY length(f) DESC, f) || ')\b' AS p FROM f) SELECT c_custkey, trim(regexp_replace(regexp_replace(lower('Survey ' || replace(n_name, '_', ' ') || ' ' || c_mktsegment || ' Nation 100'), p, ' ', 'g'), '\s+', ' ', 'g')) AS base FROM customer JOIN nation ON c_nationkey = n_nationkey, p",
    "camel_names": "WITH w AS (SELECT p_partkey, string_split('of ' || lower(p_type) || ' OF the x GGI ' || p_name, ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN upper(x) = x AND lower(x) <> x THEN x WHEN length(x) = 1 THEN upper(x) WHEN i > 1 AND lower(x) IN ('of', 'and', 'in', 'for', 'on', 'at', 'with', 'the') THEN lower(x) ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ') AS name FROM w",
    "family_trees": "WITH p AS (SELECT p_brand, '\"' || string_agg(DISTINCT p_type, '\", \"' ORDER BY p_type) || '\"' AS t, string_agg(DISTINCT CASE WHEN p_size > 48 THEN p_name END, chr(10) || '│   ├─ ' ORDER BY CASE WHEN p_size > 48 THEN p_name END) AS n FROM part GROUP BY 1) SELECT p_brand, p_brand || '  <-- Canonical' || chr(10) || '├─ Aliases: ' || t || CASE WHEN n IS NULL THEN '' ELSE chr(10) || '├─ Prototypes:' || chr(10) || '│   ├─ ' || n END AS tree FROM p",
    "curated_groups": "SELECT p_partkey, left(trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '_') || '_' || lpad(CAST(p_size AS VARCHAR), 4, '0'), 128) AS vgid, p_name || ' ' || p_brand AS variables FROM part",
    "cluster_sizes": "SELECT p_brand, count(*) AS n, CAST(sum(10 + len(string_split(p_name, ' '))) AS BIGINT) AS tokens, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1",
    "leaf_paths": "SELECT 'a.s' AS path, count(*) AS n FROM orders UNION ALL SELECT 'a.l.k', count(*) FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderkey % 3 = 0",
    "missing_paths": "SELECT 'absent' AS path, count(*) AS n_missing FROM events UNION ALL SELECT 'k', count(*) FROM events WHERE event_id % 4 = 0 OR json_extract(props, '$.k') IS NULL",
}
