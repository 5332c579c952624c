"""Queries on document text, names and mentions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import harmonize as hz
from tidemark.operators import mentions as mn
from tidemark.operators.search import centroids_by_label
from tidemark.sources.tables import table

CLASSES = [("precious", ["ring", "jewel"]), ("tool", ["widget", "gear", "bolt"]), ("plate", ["plate", "panel"])]


def language_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.english_share(F.col("text")).alias("share"))
    return docs.select("doc_id", F.coalesce(F.col("share") >= 0.05, F.lit(False)).alias("english"), F.round("share", 6).alias("share"))


def references_page(spark, d):
    text = F.concat_ws("\n", F.when(F.col("doc_id") % 7 == 3, F.lit(" References ")), F.when(F.col("doc_id") % 11 == 2, F.lit("Annex 4")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.is_references_page(text).alias("is_references"))


def text_clean(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(tx.squeeze(F.col("text"))).alias("squeezed"), F.md5(tx.clean_text(F.col("text"))).alias("clean_md5"), tx.approximate_tokens(F.col("text")).alias("tokens"))


def heuristic_filter(spark, d):
    """Name rules over lines of documents, some with a prefix or ending that a rule takes."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Table "), F.col("p_size"))).when(F.col("p_size") % 5 == 1, F.concat(F.initcap("p_name"), F.lit(" Progress Report"))).when(F.col("p_size") % 5 == 2, F.lit("Surveys")).when(F.col("p_size") % 5 == 3, F.lit("Smith et al. (2020)")).otherwise(F.col("p_name")).alias("name"))
    return p.select("p_partkey", "name", tx.keep_name(F.col("name")).alias("kept"))


def typology(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.cascade(F.col("p_name"), CLASSES, "other").alias("class"))


def footnote_refs(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.concat("text", F.lit(" see ["), F.col("doc_id") % 5, F.lit("] and ["), F.col("n_chars"), F.lit("]")))
    return docs.select("doc_id", F.array_join(F.transform(mn.footnote_refs(F.col("text")), lambda n: n.cast("string")), ",").alias("refs"))


def footnote_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" [1]\n\n[1] First source\n"), F.lit("[2 second")).alias("text"))
    return mn.footnotes(docs).select("doc_id", F.size("notes").alias("n_notes"), F.element_at("notes", F.lit(1).cast("bigint")).alias("first"), F.length("body").alias("body_chars"))


def table_runs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n\n"), F.col("text")).alias("text"))
    return mn.table_runs(docs, ["doc_id"])


def token_windows(spark, d):
    w = mn.token_windows(table(spark, d, "documents").select("doc_id", "text"))
    return w.select("doc_id", "chunk", "first_token", "n_tokens", F.md5("chunk_text").alias("chunk_md5"))


def sentence_context(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(mn.sentence_context(F.col("text"), F.lit(40))).alias("context_md5"))


def overlap_suppression(spark, d):
    """Spans over order lines: where a line begins, how long it is and how well it scores follow from its numbers."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("int") % 25 + 1).alias("end"), F.col("l_discount").alias("score"), (F.col("l_suppkey") % 3).alias("rank"))
    return mn.suppress_overlaps(l, ["l_orderkey"], rank="rank", order=["l_linenumber"])


def acronym_pairs(spark, d):
    p = table(spark, d, "part").select(tx.initials(F.concat_ws(" ", "p_type", "p_name")).alias("short"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("long"))
    return mn.acronym_pairs(p, "short", "long")


def edit_distance_rate(spark, d):
    p = table(spark, d, "part")
    before = F.lag("p_name").over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    return p.select("p_partkey", F.levenshtein("p_name", before).alias("distance"), F.round(tx.change_rate(F.col("p_name"), before), 6).alias("rate"))


def fuzzy_names(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return mn.fuzzy_pairs(p, "name")


def mention_clusters(spark, d):
    """Parts of a size and brand that carry the same name, joined over suppliers' order lines into clusters."""
    p = table(spark, d, "part")
    words = p.select(F.col("p_partkey").alias("k"), F.concat_ws("|", "p_name", "p_brand", "p_size").alias("w")).union(p.select("p_partkey", F.concat_ws("|", "p_name", "p_type", "p_retailprice")))
    first = words.groupBy("w").agg(F.min("k").alias("a"))
    edges = words.join(first, "w").where("k <> a").select("a", F.col("k").alias("b"))
    return mn.clusters(p.select(F.col("p_partkey").alias("name")), edges).withColumnsRenamed({"name": "p_partkey"})


def canonical_forms(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min(F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1)).alias("rank"))
    return mn.canonical(p, "p_brand", "p_name", "n", "rank").select("p_brand", "canonical", "n", F.array_join("forms", ",").alias("forms"))


def name_similarity(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    return hz.similar_names(p, "name", "name", 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


def combined_names(spark, d):
    """Part names alike by letters and by vectors: a name's vector is the mean of the embeddings with the label that its smallest size gives."""
    e = table(spark, d, "embeddings")
    parts = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg((F.min("p_size") % 10).cast("int").alias("label"))
    names = parts.join(centroids_by_label(e, "label"), "label")
    found = hz.combined_names(names, "name", "name", "centroid", 0.7)
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("similarity", "by_letters", "by_vector")])


def name_families(spark, d):
    names = table(spark, d, "part").groupBy("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.count("*").alias("n"))
    pairs = hz.similar_names(names.select("name").distinct(), "name", "name", 0.6)
    return hz.families(hz.leaders(names, pairs, "p_brand", "name", "n"), "p_brand", "name", "n").select("p_brand", "leader", "n", F.array_join("aliases", ",").alias("aliases"))


def family_waves(spark, d):
    """Customers' names by market segment as one wave, by nation as the next."""
    c = table(spark, d, "customer")
    wave = lambda even: c.where((F.col("c_nationkey") % 2 == 0) == even).groupBy(F.col("c_mktsegment").alias("key")).agg(F.array_sort(F.collect_set("c_name")).alias("names"))
    return hz.integrate(wave(True), wave(False), "key", "names").select("key", F.size("names").alias("n"), F.md5(F.array_join("names", ",")).alias("names_md5"))


def canonical_choice(spark, d):
    s = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"), (F.max("p_size") > 45).alias("country"), (F.min("p_size") < 3).alias("year"), F.max(F.when(F.col("p_size") == 7, "X")).alias("acronym"))
    return hz.pick_canonical(s, "p_type", "p_name", "n", "country", "year", "acronym")


def name_strip(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat_ws(" ", F.lit("Survey of"), "n_name", F.lit("1998 XII in"), "c_mktsegment", F.lit("of"))
    return n.select("c_custkey", tx.strip_numbers_years(tx.strip_forms(raw, ["building", "machinery", "household"])).alias("base"), tx.has_year(raw).alias("has_year"), tx.is_acronym(F.upper("n_name")).alias("is_acronym"))


def hash_split(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", tx.hash_thousandth(i).alias("thousandth"), tx.is_eval(i, 0.2).alias("is_eval"), tx.uuid_of(i).alias("uuid"))


def group_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.make_vgid(F.col("p_name"), F.col("p_partkey")).alias("vgid"))


def dates(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))).otherwise(F.lit("no date"))
    return o.select("o_orderkey", F.date_format(tx.flexible_date(text), "yyyy-MM-dd").alias("day"))


QUERIES = {f.__name__: f for f in (
    language_gate, references_page, text_clean, heuristic_filter, typology, footnote_refs, footnote_split, table_runs, token_windows, sentence_context, overlap_suppression, acronym_pairs, edit_distance_rate,
    fuzzy_names, mention_clusters, canonical_forms, name_similarity, combined_names, name_families, family_waves, canonical_choice, name_strip, hash_split, group_ids, dates,
)}

_ENGLISH = "(" + ", ".join(f"'{w}'" for w in tx.ENGLISH) + ")"
_TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"
_LONG = "p_brand || ' ' || p_type || ' ' || p_name"
_INITIALS = "array_to_string(list_transform(list_filter(string_split(upper({x}), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in tx.INITIAL_STOPS) + ")), lambda w: left(w, 1)), '')"

ORACLE = {
    "overlap_suppression": """WITH RECURSIVE s AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey % 60 AS a, l_partkey % 60 + CAST(floor(l_quantity) AS INTEGER) % 25 + 1 AS b, l_discount AS c, l_suppkey % 3 AS r FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY a, l, b, c, r) AS k FROM s),
g AS (SELECT o, k, k AS l, a, b, c, r, CAST(NULL AS BIGINT) AS closed FROM k WHERE k = 1 UNION ALL
SELECT n.o, n.k, CASE WHEN w THEN n.k ELSE n.pl END, CASE WHEN w THEN n.a ELSE n.pa END, CASE WHEN w THEN n.b ELSE n.pb END, CASE WHEN w THEN n.c ELSE n.pc END, CASE WHEN w THEN n.r ELSE n.pr END, CASE WHEN n.apart THEN n.pl END
FROM (SELECT *, apart OR c > pc + 0.05 OR abs(c - pc) <= 0.05 AND (b - a > pb - pa OR b - a = pb - pa AND r < pr) AS w FROM (SELECT k.*, g.l AS pl, g.a AS pa, g.b AS pb, g.c AS pc, g.r AS pr, k.b <= g.a OR g.b <= k.a AS apart FROM g JOIN k ON k.o = g.o AND k.k = g.k + 1)) n),
f AS (SELECT o, closed AS l FROM g WHERE closed IS NOT NULL UNION ALL (SELECT o, l FROM g QUALIFY row_number() OVER (PARTITION BY o ORDER BY k DESC) = 1))
SELECT f.o AS l_orderkey, k.l AS l_linenumber, a AS start, b AS "end", c AS score, r AS rank FROM f JOIN k ON k.o = f.o AND k.k = f.l""",
    "language_gate": rf"WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{2,}}')) AS w FROM documents), x AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda t: t IN {_ENGLISH})) AS k FROM w) SELECT doc_id, coalesce(k / nullif(n, 0) >= 0.05, false) AS english, round(k / nullif(n, 0), 6) AS share FROM x",
    "references_page": "SELECT doc_id, doc_id % 7 = 3 OR doc_id % 11 = 2 AS is_references FROM documents",
    "text_clean": rf"SELECT doc_id, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS INTEGER) AS squeezed, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.,:;()\[\]{{}} ]+$', '')) AS clean_md5, CAST(floor(len({_TOKENS}) * 1.3) AS INTEGER) + 1 AS tokens FROM documents",
    "heuristic_filter": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Table ' || p_size WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || ' Progress Report' WHEN 2 THEN 'Surveys' WHEN 3 THEN 'Smith et al. (2020)' ELSE p_name END AS name, p_size % 5 = 4 AS kept FROM part",
    "typology": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|jewel') THEN 'precious' WHEN regexp_matches(p_name, 'widget|gear|bolt') THEN 'tool' WHEN regexp_matches(p_name, 'plate|panel') THEN 'plate' ELSE 'other' END AS class FROM part",
    "footnote_refs": r"WITH t AS (SELECT doc_id, text || ' see [' || (doc_id % 5) || '] and [' || n_chars || ']' AS text FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda n: CAST(n AS INTEGER)))), ',') AS refs FROM t",
    "token_windows": rf"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), n AS (SELECT *, len(t) AS n FROM t WHERE len(t) > 0), c AS (SELECT *, unnest(range(0, 1 + CASE WHEN n <= 200 THEN 0 ELSE CAST(ceil((n - 200) / 150.0) AS INTEGER) END)) AS chunk FROM n) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 150 AS INTEGER) AS first_token, CAST(least(200, n - chunk * 150) AS INTEGER) AS n_tokens, md5(array_to_string(t[chunk * 150 + 1 : chunk * 150 + 200], ' ')) AS chunk_md5 FROM c",
    "table_runs": r"WITH l AS (SELECT doc_id, string_split('| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS content, CAST(unnest(range(len(l))) AS INTEGER) AS line FROM l), p AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM e WHERE contains(content, '|')) SELECT doc_id, min(line) AS first_line, max(line) AS last_line FROM p GROUP BY doc_id, run HAVING bool_or(regexp_matches(content, '^\s*\|[\-\s\|]+\|'))",
    "acronym_pairs": f"WITH s AS (SELECT DISTINCT {_INITIALS.format(x=chr(112) + '_type || chr(32) || p_name')} AS short FROM part), l AS (SELECT DISTINCT {_LONG} AS long FROM part), i AS (SELECT long, {_INITIALS.format(x='long')} AS i FROM l) SELECT short, long FROM s JOIN i ON contains(i.i, short) WHERE short <> '' AND length(short) <= length(long)",
    "edit_distance_rate": "WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS b FROM part) SELECT p_partkey, CAST(levenshtein(p_name, b) AS INTEGER) AS distance, round(levenshtein(p_name, b) / greatest(length(p_name), 1), 6) AS rate FROM p",
    "mention_clusters": "WITH RECURSIVE w AS (SELECT p_partkey AS k, p_name || '|' || p_brand || '|' || p_size AS w FROM part UNION ALL SELECT p_partkey, p_name || '|' || p_type || '|' || CAST(p_retailprice AS VARCHAR) FROM part), e AS (SELECT DISTINCT min(k) OVER (PARTITION BY w) AS a, k AS b FROM w), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT p_partkey AS n, p_partkey AS c FROM part UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.n) SELECT n AS p_partkey, min(c) AS cluster FROM r GROUP BY 1",
    "canonical_forms": "WITH p AS (SELECT p_brand, p_name, count(*) AS n, min(CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END) AS rank FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_name, (rank, -length(p_name), p_name)) AS canonical, CAST(sum(n) AS BIGINT) AS n, string_agg(p_name, ',' ORDER BY p_name) AS forms FROM p GROUP BY 1",
    "family_waves": "SELECT c_mktsegment AS key, CAST(count(DISTINCT c_name) AS INTEGER) AS n, md5(string_agg(DISTINCT c_name, ',' ORDER BY c_name)) AS names_md5 FROM customer GROUP BY 1",
    "canonical_choice": "WITH s AS (SELECT p_type, p_name, count(*) AS n, max(p_size) > 45 AS country, min(p_size) < 3 AS year, max(CASE WHEN p_size = 7 THEN 'X' END) AS acronym FROM part GROUP BY 1, 2) SELECT p_type, arg_min(p_name, (CASE WHEN NOT country AND NOT year THEN 0 WHEN NOT country THEN 1 ELSE 2 END, CAST(acronym IS NULL AS INTEGER), -n, p_name)) AS canonical FROM s GROUP BY 1",
    "name_strip": r"WITH r AS (SELECT c_custkey, n_name, 'Survey of ' || n_name || ' 1998 XII in ' || c_mktsegment || ' of' AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '\b(household|machinery|building)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM r), g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\b(19|20)\d{2}\b', '', 'g'), '\d+\b', '', 'g'), '\b[ivxlcdmIVXLCDM]{1,4}\b', '', 'g'), '\bof\b\s*$', '') AS b FROM f) SELECT c_custkey, trim(regexp_replace(b, '\s+', ' ', 'g')) AS base, true AS has_year, length(n_name) <= 6 AND regexp_full_match(upper(n_name), '[A-Z0-9-]+') AS is_acronym FROM g",
    "hash_split": "WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) SELECT doc_id, CAST(CAST('0x' || h AS UHUGEINT) % 1000 AS INTEGER) AS thousandth, CAST('0x' || h AS UHUGEINT) % 1000 < 200 AS is_eval, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid FROM h",
    "group_ids": "SELECT p_partkey, left(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', '_', 'g'), '_') || '_' || CASE WHEN p_partkey > 9999 THEN left(CAST(p_partkey AS VARCHAR), 4) ELSE lpad(CAST(p_partkey AS VARCHAR), 4, '0') END, 128) AS vgid FROM part",
    "dates": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "footnote_split": "SELECT doc_id, 1 AS n_notes, 'First source' AS first, CAST(length(text) + 5 AS INTEGER) AS body_chars FROM documents",
    "combined_names": """WITH e AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM e GROUP BY 1),
p AS (SELECT p_name || ' ' || p_type AS name, CAST(min(p_size) % 10 AS INTEGER) AS label FROM part GROUP BY 1), names AS (SELECT name, v FROM p JOIN c USING (label)), w AS (SELECT name, unnest(list_filter(string_split(lower(name), ' '), lambda x: x <> '')) AS w FROM names),
n AS (SELECT name, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM w), k AS (SELECT name, p, n, unnest(range(1, 1 + greatest(1, length(p) - n + 1))) AS k FROM n WHERE n = 3 OR length(p) >= n),
tf AS (SELECT name, substr(p, k, n) AS gram, count(*) AS tf FROM k GROUP BY 1, 2), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM names)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT name, gram, tf * idf AS x FROM tf JOIN idf USING (gram)), u AS (SELECT name, gram, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM raw),
s AS (SELECT a.name AS a, b.name AS b, sum(a.x * b.x) AS l FROM u a JOIN u b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2),
f AS (SELECT a, b, l, list_cosine_similarity(x.v, y.v) AS d FROM s JOIN names x ON a = x.name JOIN names y ON b = y.name)
SELECT a, b, round(0.5 * l + 0.5 * d, 6) AS similarity, round(l, 6) AS by_letters, round(d, 6) AS by_vector FROM f WHERE 0.5 * l + 0.5 * d >= 0.7""",
    "name_similarity": """WITH names AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part), w AS (SELECT name, unnest(list_filter(string_split(lower(name), ' '), lambda x: x <> '')) AS w FROM names),
n AS (SELECT name, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM w), k AS (SELECT name, p, n, unnest(range(1, 1 + greatest(1, length(p) - n + 1))) AS k FROM n WHERE n = 3 OR length(p) >= n),
tf AS (SELECT name, substr(p, k, n) AS gram, count(*) AS tf FROM k GROUP BY 1, 2), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM names)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT name, gram, tf * idf AS x FROM tf JOIN idf USING (gram)), u AS (SELECT name, gram, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM raw)
SELECT a.name AS a, b.name AS b, round(sum(a.x * b.x), 6) AS similarity FROM u a JOIN u b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.6""",
}
