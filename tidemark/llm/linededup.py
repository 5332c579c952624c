"""Lines that many documents share stay in one document only, by Spark expressions only.

A text's lines stand between line ends; a line's key is the line without white space at both ends and with A-Z lower-cased. A key of at least MIN_CHARS
code points found in at least MIN_DOCS documents loses all its lines except in the document with the largest id that holds it.

Only hashes of the keys travel, with the document and the line's number; they are range-partitioned by hash, sorted within by document and number, and one
pass over the sorted rows tells the first document of a hash from the later ones. Hashes of more than 1/SHARES of all lines don't travel: a mergeable sketch
of frequent items finds them (its error is under 3.5/ITEMS of all lines), their documents are counted by a two-step aggregation, and as they are under
1,000 their verdicts are broadcast. What is returned for a document is no text but a run-length-coded keep bitmap: array<int> of lengths of runs of lines,
kept ones first, then alternately dropped and kept; applied() makes texts of it.

Keys are told apart by 128 bits of hash. Null or empty texts have one empty line. Documents are counted and told apart by their id, null being one id and
smaller than all others; rows of one id are one document for the count, but each has its own bitmap by its text. Repeated rows have equal bitmaps. An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

MIN_CHARS, MIN_DOCS = 40, 5
#: Shares of all lines beyond which a hash is broadcast, and items that the sketch of a task holds.
SHARES, ITEMS = 512, 4096
SPACE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and no other letter changed; whole ASCII texts by the faster function, with the same result."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, d, t, p): hashes of a line's key, the document's id, a hash of its text, the line's number from 0; lines of short keys are left out."""
    text = F.coalesce(text_col, F.lit(""))
    lines = df.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(lowered(text), "\n")).alias("p", "line"))
    keys = lines.where(F.length("line") >= min_chars).withColumn("k", F.btrim("line", F.lit(SPACE))).where(F.length("k") >= min_chars)
    return keys.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), "d", "t", "p")


def drops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shares: int = SHARES) -> DataFrame:
    """(d, t, runs array of (first, last)): runs of dropped lines of each document that has any."""
    lines = staged(occurrences(df, id_col, text_col, min_chars))
    frequent = lines.agg(F.expr(f"approx_top_k(h1, 1000, {ITEMS})").alias("tops"), F.count("*").alias("n"))
    hot = staged(frequent.select(F.explode("tops").alias("top"), "n").where(F.col("top.count") * shares > F.col("n")).select(F.col("top.item").alias("h")))
    # Hot hashes: their documents are counted where they stand.
    often = lines.join(F.broadcast(hot), F.col("h1") == F.col("h"), "left_semi")
    judged = often.groupBy("h1", "h2").agg(F.countDistinct(F.struct("d")).alias("docs"), F.max("d").alias("last")).where(F.col("docs") >= min_docs)
    judged = F.broadcast(judged.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "last"))
    hot_drops = often.join(judged, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~F.col("d").eqNullSafe(F.col("last"))).select("d", "t", "p")
    # The others come by ranges of their hash, the document with the largest id first.
    seldom = lines.join(F.broadcast(hot), F.col("h1") == F.col("h"), "left_anti")
    order = [F.col("d").desc_nulls_last(), F.col("p")]
    ranged = seldom.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    line = Window.partitionBy("h1", "h2")
    nth = ranged.withColumn("nth", F.dense_rank().over(line.orderBy(F.col("d").desc_nulls_last())))
    later = nth.withColumn("docs", F.max("nth").over(line)).where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("d", "t", "p")
    # Neighbouring lines have the same difference to their rank.
    text = Window.partitionBy("d", "t")
    apart = hot_drops.unionByName(later).groupBy("d", "t", "p").agg(F.lit(1).alias("one"))
    runs = apart.withColumn("island", F.col("p") - F.row_number().over(text.orderBy("p"))).groupBy("d", "t", "island").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    return runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _keep(runs: Column, n_lines: Column) -> Column:
    """Runs of dropped lines as lengths of kept and dropped runs in turn."""
    pieces = F.flatten(F.transform(runs, lambda r, k: F.array(r["first"] - F.when(k == 0, 0).otherwise(F.get(runs, k - 1)["last"] + 1), r["last"] - r["first"] + 1)))
    return F.coalesce(F.concat(pieces, F.array(n_lines - F.element_at(runs, -1)["last"] - 1)), F.array(n_lines))


def _with_runs(df: DataFrame, columns: list, id_col: str, text_col: str, **rule) -> DataFrame:
    """Every row with its number of lines and its keep bitmap."""
    text = F.coalesce(text_col, F.lit(""))
    docs = df.select(*columns, F.col(id_col).alias("_d"), F.xxhash64(text).alias("_t"), F.size(F.split(text, "\n")).alias("_n"))
    found = drops(df, id_col, text_col, **rule)
    return docs.join(found, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")), "left").withColumn("_keep", _keep(F.col("runs"), F.col("_n")))


def bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """Per row (id_col, n_lines, n_dropped, keep): lengths of runs of kept and dropped lines in turn, kept first."""
    done = _with_runs(df, [F.col(id_col).alias("_id")], id_col, text_col, **rule)
    return done.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_lines"), _dropped(F.col("_keep")).alias("n_dropped"), F.col("_keep").alias("keep"))


def _dropped(keep: Column) -> Column:
    return F.aggregate(F.transform(keep, lambda x, k: F.when(k % 2 == 1, x).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)


def applied(text: Column, keep: Column) -> Column:
    """The lines that a keep bitmap keeps, joined again."""
    flags = F.flatten(F.transform(keep, lambda x, k: F.array_repeat(k % 2 == 0, x)))
    kept = F.filter(F.arrays_zip(F.split(F.coalesce(text, F.lit("")), "\n").alias("line"), flags.alias("keep")), lambda z: z["keep"])
    return F.array_join(F.transform(kept, lambda z: z["line"]), "\n")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """Per row (id_col, n_lines, n_dropped, kept_sha256)."""
    done = _with_runs(df, [F.col(id_col).alias("_id"), F.col(text_col).alias("_x")], id_col, text_col, **rule)
    whole = F.coalesce("_x", F.lit(""))
    kept = F.when(F.col("runs").isNull(), whole).otherwise(applied(whole, F.col("_keep")))
    return done.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_lines"), _dropped(F.col("_keep")).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


#: DuckDB SQL of the digests.
ORACLE = r"""
WITH l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, i, line, g.k IS NOT NULL AND l.doc_id <> g.last AS dropped FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
