"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audit, bpe, chatformat, ctw, decontam, htmltext, imatch, langid, linededup, merkle, near_dedup, suffix_dedup, toxicity
from tidemark.session import ship


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file: in TOKENIZERS_DIR where that is set, else where the package public_tokenizers says, else in /opt/tokenizers."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        return importlib.import_module("public_tokenizers").path(name)
    return os.path.join("/opt/tokenizers", name)



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op4_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), background=toxicity.words_of(vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chatformat.digests(rows.unionByName(probe))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digests(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_context_tree_weighting": op1_context_tree_weighting,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_bpe_backtracking": op4_bpe_backtracking,
        "op5_language_id": op5_language_id,
        "op6_prefix_filtered_decontamination": op6_prefix_filtered_decontamination,
        "op7_html_text": op7_html_text,
        "op8_toxicity_grammar": op8_toxicity_grammar,
        "op9_chat_format": op9_chat_format,
        "op10_imatch_fingerprints": op10_imatch_fingerprints,
        "op11_filter_audit": op11_filter_audit,
        "op12_line_dedup": op12_line_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


#: DuckDB SQL of repeated 100-byte strings, on the texts' bytes in hexadecimal.
REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS i, x FROM t WHERE length(x) >= 200),
h AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM p),
f AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
m AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR before < i THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
n AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM s),
k AS (SELECT t.doc_id, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed, any_value(x) AS x, coalesce(string_agg(substr(x, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a), '') || substr(any_value(x), 2 * coalesce(max(b), 0) + 1) AS kept FROM t LEFT JOIN n ON t.doc_id = n.doc_id GROUP BY t.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

#: DuckDB SQL of benchmark windows in documents.
CONTAMINATION = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item, w, unnest(range(1, 1 + greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS g FROM v),
p AS (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win)),
hit AS (SELECT id, i, p.size, item FROM p JOIN win ON p.size = win.size AND array_to_string(w[i : i + p.size - 1], ' ') = g),
words AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY 1),
items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY 1)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.id = words.id LEFT JOIN items ON d.id = items.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_array_dedup": REPEATS, "op6_prefix_filtered_decontamination": CONTAMINATION, "op9_chat_format": chatformat.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_line_dedup": linededup.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
