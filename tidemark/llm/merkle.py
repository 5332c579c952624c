"""A dataset manifest: one hash tree a source, one tree over the sources' roots, and a proof for every document.

A leaf is H (lower-case hex SHA-256) of a document's fields, each '-' if null, else its UTF-8 byte count, ':' and the value. Leaves of a source ascend by id; while
several nodes remain, every three neighbours (the last run may have fewer, even one) become H of their hex digests. The subroots, by source with null
first, become the root in the same way. A proof is the siblings on the way from a leaf over its subroot to the root.

Leaves are hashed where the texts are read; no text travels. A node's place is its rank, found without gathering a source: rows are range-partitioned, numbered
within a range, and ranges are counted. 3**LEVELS consecutive nodes of a tree form a superblock (small trees share one). Upwards, each superblock is reduced to
its top node, round by round until every tree has one. Downwards, the nodes of each superblock and what lies outside it (the siblings above its top
node, its subroot and the root) are cogrouped by superblock; one function finishes the local levels, joins them with the outer ones and folds. A task holds a superblock or two
and one outer path each, however large a source is; a round costs a shuffle of digests.

Rows of equal id in a source go by their leaf, so repeated rows stand side by side and ties between different rows have a fixed order. A null id comes first and is never
tampered with; a null source is a source of its own. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

WIDTH, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(df: DataFrame, fields: tuple[str, ...] = FIELDS, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tree, doc_id, leaf, seen): a row's source as a key that sorts null first, its leaf, and the leaf of what a check sees later (tampered or not)."""
    whole = lambda change: F.sha2(F.concat(*[field(change(F.col(c)) if c == text_col else F.col(c)) for c in fields]), 256)
    tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(tampered & F.contains(F.col(text_col), F.lit("\n")), whole(lambda t: F.replace(t, F.lit("\n"), F.lit(""))))
    done = df.select(F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("tree"), F.col(id_col).alias("doc_id"), whole(lambda t: t).alias("leaf"), seen.alias("seen"))
    return done.withColumn("seen", F.coalesce("seen", "leaf"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df (with a column tree) with i, a row's place in its tree by order, from 0, and n, the tree's rows."""
    # Written once, so that each row's range stays the same whenever it is read.
    ranges = staged(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy(F.col("tree").alias("t"), F.col("range").alias("r")).agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("t")
    before = counts.select("t", "r", F.coalesce(F.sum("rows").over(tree.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n"))
    within = ranges.withColumn("i", F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1)
    placed = within.join(before, (F.col("tree") == F.col("t")) & (F.col("range") == F.col("r")))
    return placed.withColumn("i", F.col("i") + F.col("before")).drop("t", "r", "before", "range")


def _rounds(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round upwards with block, their superblock, and the top node of every tree.

    A superblock is that of a large tree, or one of those that small trees share. A node's column below is the superblock of which it is the top.
    """
    size, rounds = WIDTH**levels, []
    while True:
        rows, most = nodes.agg(F.count("*"), F.max("n")).first()
        shared = F.pmod(F.xxhash64("tree"), F.lit(max(1, rows // size)))
        rounds.append(staged(nodes.withColumn("block", F.when(F.col("n") > size, F.xxhash64("tree", F.floor(F.col("i") / size))).otherwise(shared))))
        nodes = staged(rounds[-1].select("block", "tree", "i", "n", "digest").groupBy("block").applyInPandas(_reduced(levels), NODE))
        if (most or 0) <= size:
            return rounds, nodes


def _segments(rows: pd.DataFrame, levels: int) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    """The rows of each superblock of a tree with the digests of its levels, the nodes themselves first."""
    rows = rows.sort_values(["tree", "i"], kind="stable").reset_index(drop=True)
    for _, part in rows.groupby([rows["tree"], rows["i"] // WIDTH**levels], sort=False):
        level, here, left = [list(part["digest"])], levels, int(part["n"].iloc[0])
        while here and left > 1:
            last = level[-1]
            level.append([digest(*last[k : k + WIDTH]) for k in range(0, len(last), WIDTH)])
            here, left = here - 1, -(-left // WIDTH)
        yield part, level


def _reduced(levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        size = WIDTH**levels
        found = [(p["tree"].iloc[0], int(p["i"].iloc[0]) // size, -(-int(p["n"].iloc[0]) // size), level[-1][0], int(p["block"].iloc[0])) for p, level in _segments(rows, levels)]
        return pd.DataFrame(found, columns=["tree", "i", "n", "digest", "below"])

    return reduce


NODE = "tree string, i long, n long, digest string, below long"
PATH = "tree string, i long, over long, left array<string>, right array<string>, subroot string, root string"


def _paths(levels: int, ends: Callable[[pd.DataFrame, list[list[str]]], list[tuple]], columns: list[str]) -> Callable:
    """For the nodes of a superblock and its outer path: what ends() makes of rows and their whole paths."""

    def meet(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        known, found = {(t, i): (list(a), list(b), s, r) for t, i, a, b, s, r in zip(outer["tree"], outer["i"], outer["left"], outer["right"], outer["subroot"], outer["root"], strict=True)}, []
        for part, level in _segments(rows, levels):
            sides = [([("".join(d[k - k % WIDTH : k]), "".join(d[k + 1 : k - k % WIDTH + WIDTH])) for k in range(len(d))]) for d in level[:-1]]
            over = known[part["tree"].iloc[0], int(part["i"].iloc[0]) // WIDTH**levels]
            paths = []
            for k in range(len(part)):
                own = [side[k // WIDTH**at] for at, side in enumerate(sides)]
                paths.append(([a for a, _ in own] + over[0], [b for _, b in own] + over[1], over[2], over[3]))
            found += ends(part, paths)
        return pd.DataFrame(found, columns=columns)

    return meet


PLACE = ["tree", "i", "over", "left", "right", "subroot", "root"]


def _inner(part: pd.DataFrame, paths: list) -> list[tuple]:
    """The outer path of the superblock below each node."""
    return [(t, i, below, *path) for t, i, below, path in zip(part["tree"], part["i"], part["below"], paths, strict=True)]


def _sources(part: pd.DataFrame, paths: list) -> list[tuple]:
    """The outer path of the top superblock of each source's tree."""
    return [(name, 0, below, left, right, subroot, root) for name, below, subroot, (left, right, _, root) in zip(part["name"], part["below"], part["digest"], paths, strict=True)]


def _folded(part: pd.DataFrame, paths: list) -> list[tuple]:
    found = []
    for doc, leaf, seen, (left, right, subroot, root) in zip(part["doc_id"], part["digest"], part["seen"], paths, strict=True):
        at = seen
        for a, b in zip(left, right, strict=True):
            at = digest(a, at, b)
        found.append((doc, leaf, subroot, root, digest(*[x for pair in zip(left, right, strict=True) for x in pair]), at, at == root))
    return found


def _down(rounds: list[DataFrame], outer: DataFrame, levels: int, ends: Callable, result: str) -> DataFrame:
    """What ends() makes of the lowest round's nodes, from the outer paths of the trees' top nodes."""
    for nodes in reversed(rounds[1:]):
        outer = nodes.groupBy("block").cogroup(outer.groupBy("over")).applyInPandas(_paths(levels, _inner, PLACE), PATH)
    names = [c.split()[0] for c in result.split(", ")]
    return rounds[0].groupBy("block").cogroup(outer.groupBy("over")).applyInPandas(_paths(levels, ends, names), result)


def manifest(df: DataFrame, levels: int = LEVELS, **columns) -> DataFrame:
    """Per row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    low = ranked(staged(leaves(df, **columns)), "doc_id", "leaf")
    kind = low.schema["doc_id"].dataType
    documents, subroots = _rounds(low.select("tree", "i", "n", F.col("leaf").alias("digest"), F.col("doc_id").cast("string").alias("doc_id"), "seen"), levels)
    sources, root = _rounds(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "below"), "name"), levels)
    none = F.array().cast("array<string>")
    outer = root.select("tree", "i", F.col("below").alias("over"), none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    outer = staged(_down(sources, outer, levels, _sources, PATH))
    found = _down(documents, outer, levels, _folded, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_HEAD = " || ".join(map(_field, FIELDS[:-1]))
_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))"

#: DuckDB SQL of the manifest: levels upwards by recursion, then every leaf folded level by level, over the sources' trees and then over the tree of subroots.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
  CASE WHEN {_CRC} & 1 = 1 THEN sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_field("text")}) END AS seen FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS lev, i, leaf AS x, n FROM r UNION ALL SELECT source, lev + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lev, i // 3, n),
runs AS (SELECT source, lev, i // 3 AS k, list(x ORDER BY i) AS xs FROM up WHERE n > 1 GROUP BY 1, 2, 3),
fold AS (SELECT doc_id, source, leaf, 0 AS lev, i, n, seen AS x, '' AS proof FROM r UNION ALL
  SELECT doc_id, f.source, leaf, f.lev + 1, i // 3, (n + 2) // 3, sha256(array_to_string(xs[: i % 3], '') || x || array_to_string(xs[i % 3 + 2 :], '')), proof || array_to_string(xs[: i % 3], '') || array_to_string(xs[i % 3 + 2 :], '')
  FROM fold f JOIN runs ON f.source IS NOT DISTINCT FROM runs.source AND f.lev = runs.lev AND i // 3 = k WHERE n > 1),
tops AS (SELECT source, x AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (SELECT 0 AS lev, i, subroot AS x, n FROM tops UNION ALL SELECT lev + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM up2 WHERE n > 1 GROUP BY lev, i // 3, n),
runs2 AS (SELECT lev, i // 3 AS k, list(x ORDER BY i) AS xs FROM up2 WHERE n > 1 GROUP BY 1, 2),
fold2 AS (SELECT doc_id, leaf, subroot, 0 AS lev, t.i, t.n, x, proof FROM fold f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source WHERE f.n = 1 UNION ALL
  SELECT doc_id, leaf, subroot, f.lev + 1, i // 3, (n + 2) // 3, sha256(array_to_string(xs[: i % 3], '') || x || array_to_string(xs[i % 3 + 2 :], '')), proof || array_to_string(xs[: i % 3], '') || array_to_string(xs[i % 3 + 2 :], '')
  FROM fold2 f JOIN runs2 ON f.lev = runs2.lev AND i // 3 = k WHERE n > 1)
SELECT doc_id, leaf, subroot, (SELECT x FROM up2 WHERE n = 1) AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = (SELECT x FROM up2 WHERE n = 1) AS verified FROM fold2 WHERE n = 1
"""
