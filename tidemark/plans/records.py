"""Queries on records' keys, values, dates, mentions and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import records as re_
from tidemark.sources.tables import table


def record_keys(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", re_.short_id(F.col("o_orderpriority")).alias("prompt"), re_.memo_key(F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit("m")).alias("memo"))


def indexed_values(spark, d):
    p = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("shelf")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("n"))))).alias("m"))
    return p.select("shelf", F.md5(F.array_join(re_.indexed(F.col("m"), "n"), ",")).alias("names_md5"))


def joined_fields(spark, d):
    p = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("shelf")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: x["p_type"]).alias("t"))
    return p.select("shelf", re_.joined_fields(F.concat(F.array(F.lit(" "), F.lit("B,")), "t"), 12).alias("types"))


def leaf_values(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.concat("o_orderstatus", F.lit(" , "), "o_custkey").alias("a"), F.array(F.struct(F.lit(True).alias("t")), F.struct(F.lit(None).cast("boolean").alias("t"))).alias("b"))).alias("p"))
    return re_.leaf_values(o, "o_orderkey", "p")


def dates_in_place(spark, d):
    o = table(spark, d, "orders")
    p = F.to_json(F.struct(F.struct(F.date_format("o_orderdate", "yyyy/MM/dd").alias("d")).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "soon").alias("b")))
    return o.select("o_orderkey", F.array_join(F.transform(F.map_entries(re_.iso_dates(p, ["a.d", "b", "c"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("dates"))


def provenance(spark, d):
    o = table(spark, d, "orders")
    one = F.struct(F.when(F.col("o_custkey") % 3 == 0, "").otherwise("2020").alias("harvest_date"), F.lit(False).alias("altered"), F.lit("own").alias("namespace"), F.col("o_orderstatus").alias("identifier"))
    p = F.when(F.col("o_orderkey") % 2 == 0, F.array(one, one)).otherwise(F.filter(F.array(one), lambda x: F.lit(False)))
    done = re_.with_provenance(p, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")), F.lit("2024"))
    return o.select("o_orderkey", F.array_join(F.transform(done, lambda x: F.concat_ws(":", x["harvest_date"], x["altered"].cast("string"), x["namespace"], x["identifier"])), ",").alias("provenance"))


def _records(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    new = F.to_json(F.array(F.struct(F.struct(F.concat("p_name", F.lit(" .")).alias("text"), F.col("l_linenumber").cast("int").alias("start"), F.col("l_discount").alias("confidence")).alias("mention_name"), F.lit("named").alias("specificity_tag"), F.upper(F.substring("p_type", 1, 2)).alias("acronym"))))
    old = F.to_json(F.struct(F.col("p_type").alias("dataset_name"), F.col("l_linenumber").cast("int").alias("start"), F.lit("vague").alias("label"), F.col("l_tax").alias("score")))
    empty = F.lit('[{"dataset_name": " "}]')
    return l.select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, new).when(F.col("l_linenumber") % 3 == 1, old).otherwise(empty).alias("datasets"))


def record_mentions(spark, d):
    m = re_.mentions(_records(spark, d), ["l_orderkey"], "datasets")
    return m.groupBy("l_orderkey", "text", "tag").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"), F.min("start").alias("start"))


def harmonization_input(spark, d):
    return re_.for_harmonization(re_.mentions(_records(spark, d), ["l_orderkey"], "datasets"))


def chunk_spans(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("text"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("end")))).alias("s"))
    return l.select("l_orderkey", F.array_join(F.transform(re_.shifted(F.col("s"), F.col("l_orderkey")), lambda s: F.concat_ws("-", s["text"], s["start"], s["end"])), ",").alias("spans"))


def merged_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("g"), "doc_id", "text", "lang")
    c = re_.merged_chunks(docs, "g", "doc_id", "text", "lang")
    return c.groupBy("g", "lang").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


def reduced_vectors(spark, d):
    e = table(spark, d, "embeddings")
    r = re_.reduced(e, "vec_id", "embedding", 16)
    return r.select("vec_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


def highlight_rows(spark, d):
    o = table(spark, d, "orders")
    one = F.to_json(F.struct(F.col("o_orderkey").alias("id")))
    payload = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), one, F.lit(", 7, "), one, F.lit("]"))).otherwise(F.concat(F.lit('{"a":'), one, F.lit("}")))
    return o.select("o_orderkey", F.explode(re_.highlights(payload)).alias("r")).groupBy("o_orderkey", F.get_json_object("r", "$.id").alias("id")).agg(F.count("*").alias("n"))


def recent_orders(spark, d):
    return re_.recent(table(spark, d, "orders").select((F.date_format("o_orderdate", "yyyyMMdd").cast("bigint") * 100_000_000 + F.col("o_orderkey")).alias("o"), "o_orderkey"), "o", 25)


QUERIES = {f.__name__: f for f in (
    record_keys, indexed_values, joined_fields, leaf_values, dates_in_place, provenance, record_mentions, harmonization_input, chunk_spans, merged_chunks, reduced_vectors, highlight_rows, recent_orders,
)}

_M = "m AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN p_name ELSE p_type END AS text, CASE l_linenumber % 3 WHEN 0 THEN 'named' ELSE 'vague' END AS tag, CASE l_linenumber % 3 WHEN 0 THEN l_discount ELSE l_tax END AS c, l_linenumber AS s, CASE l_linenumber % 3 WHEN 0 THEN upper(substr(p_type, 1, 2)) END AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 < 2)"

ORACLE = {
    "record_keys": "SELECT o_orderkey, left(md5(o_orderpriority), 8) AS prompt, sha1(o_orderpriority || chr(0) || o_custkey || chr(0) || 'm') AS memo FROM orders",
    "indexed_values": "SELECT p_partkey // 50 AS shelf, md5(string_agg(p_name, ',' ORDER BY p_partkey)) AS names_md5 FROM part GROUP BY 1",
    "joined_fields": "WITH f AS (SELECT p_partkey // 50 AS shelf, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2) SELECT shelf, left('B,, ' || string_agg(p_type, ', ' ORDER BY k), 12) AS types FROM f GROUP BY 1",
    "leaf_values": "SELECT o_orderkey, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR), 'true']) AS value FROM orders",
    "dates_in_place": "SELECT o_orderkey, 'a.d=' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ',b=soon' ELSE '' END AS dates FROM orders",
    "provenance": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN '2024' ELSE '2020' END || ':true:AI_EXTRACTED:' || o_orderstatus || ',' || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '2020' END || ':false:own:' || o_orderstatus ELSE '2024:true:AI_EXTRACTED:' || CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'unknown' END END AS provenance FROM orders",
    "record_mentions": f"WITH {_M} SELECT l_orderkey, text, tag, count(*) AS n, round(sum(c), 6) AS confidence, CAST(min(s) AS INTEGER) AS start FROM m GROUP BY 1, 2, 3",
    "harmonization_input": f"WITH {_M} SELECT text, tag AS label, count(*) AS count, min(a) AS acronym FROM m WHERE tag = 'named' GROUP BY 1, 2",
    "chunk_spans": "SELECT l_orderkey, string_agg(l_returnflag || '-' || (l_linenumber + l_orderkey) || '-' || (l_linenumber + l_orderkey + 3), ',' ORDER BY l_returnflag, l_linenumber) AS spans FROM lineitem GROUP BY 1",
    "reduced_vectors": "SELECT vec_id, 16 AS dims, CAST(1.0 AS DOUBLE) AS length FROM embeddings",
    "highlight_rows": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM orders",
    "recent_orders": "SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) * 100000000 + o_orderkey AS o, o_orderkey FROM orders ORDER BY o DESC LIMIT 25",
}
