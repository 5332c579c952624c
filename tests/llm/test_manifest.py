"""Filter audit, line dedup and Merkle manifest against plain versions, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, catalog, linededup, merkle

WORDS = [f"word{k}" for k in range(60)]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (7, None, None), (9, 1, 1), (999, 1, 1)]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, h int, x string, mask int, t string, p int, d int, tree string, i int, n int, digest string, block long, runs string, part string, rows int"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "x", 2, "t", 3, 4, "tree", 5, 6, "g", 7, "r", "p", 8) for i, t, lang, s in rows], CLASH)


def rows_of(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    lines = [" ".join(rng.choices(WORDS, k=12)) for _ in range(6)]
    rows = [(1, None, None, None), (2, "", "en", ""), (2, "", "en", ""), (None, "no id\nat all", "en", "a"), (None, "no id\nat all", "en", "a"), (None, None, None, None), (3, "\n\n", "de", "é"), (4, " ".join(WORDS), "en", "a"), (4, "other text of id 4\n" + lines[0], "en", "a"), (5, ("LONG line %d\n" * 3) * 4000, "en", "b")]
    for k in range(6, n):
        kind, source = rng.randrange(6), rng.choice(["a", "a", "a", "b", "", None, "é", "z" * 40])
        own = "\n".join(rng.choice([*lines, "  " + lines[1].upper() + "\t", " ".join(rng.choices(WORDS, k=9)), "short", "", "É" + lines[2]]) for _ in range(rng.randrange(9)))
        rows.append((k, [None, "", own, own + "\n", "SHOUT & $5 " * 20, rows[-1][1]][kind], rng.choice([None, "en", "fr"]), source))
    rng.shuffle(rows)
    return rows


# 11


def brute_audit(rows: list[tuple], labels: list[tuple]) -> dict:
    seen, fails = defaultdict(list), []
    for i, t, *_ in rows:
        seen[t or ""].append(i)
    for i, t, _, s in rows:
        x = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), "D": bool(re.search("[#$%&*|]", x)),
            "E": i is not None and any(j is not None and j < i for j in seen[x]),
        }
        of = [r for r in labels if r[0] == i and i is not None]
        fails.append((s or "", {k for k, v in own.items() if v}, any(r[1] == 1 for r in of), any(r[2] == 1 for r in of)))
    shapley, out = Counter(), {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for order in orders:
        for part, own, *_ in fails:
            if own:
                shapley[part, min(own, key=order.index)] += 1
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in orders:
            for step in range(1, 6):
                letter, before = order[step - 1], set(order[: step - 1])
                gone = [f for f in mine if letter in f[1] and not f[1] & before]
                out[part, order, step] = (
                    sum(not f[1] & (before | {letter}) for f in mine), len(gone), sum(letter in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), shapley[part, letter],
                )
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("shares", [audit.SHARES, 1, 10_000])
def test_audit_equals_plain_counts(spark, shares):
    rows = rows_of(11)
    labels = spark.createDataFrame([(*r, "k") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in audit.audit(table(spark, rows), labels, shares=shares).collect()}
    assert got == brute_audit(rows, LABELS)


def test_audit_spreads_a_hot_text(spark):
    """Four of five rows have one text: all but the first fail E, and the pieces of its hash are many."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "copied").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    assert audit.failures(docs).where("mask & 16 > 0").agg(F.sum("rows")).first()[0] == 799


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(table(spark, []), labels).count() == 0
    assert audit.audit(table(spark, [(1, None, None, None)]), labels).where("part = ''").count() == 600


# 12

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows: list[tuple], min_chars: int, min_docs: int) -> list[tuple]:
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        flags = [key(x) not in last or last[key(x)] == i for x in lines]
        out.append((i, lines, flags))
    return out


@pytest.mark.parametrize("shares", [linededup.SHARES, 1, 20])
@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (1, 2), (0, 1)])
def test_lines_equal_plain_dedup(spark, min_chars, min_docs, shares):
    rows, rule = rows_of(12, 120), {"min_chars": min_chars, "min_docs": min_docs, "shares": shares}
    want = brute_lines(rows, min_chars, min_docs)
    assert any(not all(f) for *_, f in want)
    digests = linededup.digests(table(spark, rows), **rule).collect()
    text = ["\n".join(x for x, f in zip(lines, flags, strict=True) if f) for _, lines, flags in want]
    expected = [(i, len(lines), flags.count(False), hashlib.sha256(x.encode()).hexdigest()) for (i, lines, flags), x in zip(want, text, strict=True)]
    assert sorted(map(tuple, digests), key=str) == sorted(expected, key=str)
    maps = linededup.bitmaps(table(spark, rows), **rule).collect()
    runs = lambda flags: [0] * (not flags[0]) + [len(list(g)) for _, g in itertools.groupby(flags)]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, [b for k, n in enumerate(r.keep) for b in [k % 2 == 0] * n]) for r in maps), key=str)
    assert got == sorted(((i, len(x), f.count(False), f) for i, x, f in want), key=str)
    assert all(sum(r.keep) == r.n_lines for r in maps) and max(len(r.keep) for r in maps) <= max(len(runs(f)) + 2 for *_, f in want)


def test_lines_of_nothing_and_of_a_long_text(spark):
    assert linededup.digests(table(spark, [])).count() == 0
    line = "one long line that is not short at all, no"
    long = "\n".join([line] * 50_000)
    rows = [(k, line if k < 5 else long, None, None) for k in range(6)]
    got = {r.doc_id: r.n_dropped for r in linededup.digests(table(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    rows[0], rows[5] = (0, long, None, None), (5, line, None, None)
    assert {r.doc_id: r.n_dropped for r in linededup.digests(table(spark, rows)).collect()} == {0: 50_000, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_lines_run_without_python_workers(spark, data):
    plan = catalog.op12_line_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 13


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each node's siblings level by level."""
    at, paths, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            run = a - a % 3
            paths[k].append(("".join(level[run:a]), "".join(level[a + 1 : run + 3])))
        level, at = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)], [a // 3 for a in at]
    return level[0], paths


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha(*map(part, (i, s, lang, n, t)))
    trees = defaultdict(list)
    for i, t, lang, s in rows:
        n = None if t is None else len(t)
        cut = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        trees[s].append((i, leaf(i, t, lang, s, n), leaf(i, cut, lang, s, n)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    own = {s: tree_of([r[1] for r in trees[s]]) for s in names}
    root, upper = tree_of([own[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (i, first, seen), path in zip(trees[s], own[s][1], strict=True):
            whole, at = path + upper[k], seen
            for a, b in whole:
                at = sha(a, at, b)
            out.append((i, first, own[s][0], root, sha(*[x for p in whole for x in p]), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_equals_plain_trees(spark, levels):
    rows = rows_of(13, 90)
    got = sorted(map(tuple, merkle.manifest(table(spark, rows), levels=levels).collect()), key=str)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None)], [(1, "a\n", None, "s"), (2, None, None, "t")], [(k, "x", "en", "s") for k in range(3)], [(2**60 + k, "x\ny", "en", str(k)) for k in range(28)]])
def test_small_manifests(spark, rows):
    for levels in (1, merkle.LEVELS):
        assert sorted(map(tuple, merkle.manifest(table(spark, rows), levels=levels).collect()), key=str) == (brute_manifest(rows) if rows else [])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup", "op13_merkle_manifest"])
def test_sql_gives_the_same_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.queries()[name](spark, data)
    result = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)
