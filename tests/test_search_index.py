"""The written index against exact search, and leader clustering by either way."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as vx
from tidemark.operators import harmonize as hz
from tidemark.operators import search as se
from tidemark.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<double>, list int, q string"


def clustered(spark, n: int, centers: int = 40, dims: int = 24, seed: int = 1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, dims))
    v = c[r.integers(0, centers, n)] + 0.15 * r.normal(size=(n, dims))
    return spark.createDataFrame([(k, [float(y) for y in x], 0, "q") for k, x in enumerate(v)], SCHEMA)


def recall(found, exact) -> float:
    return se.recall(found, exact).first().recall


def test_few_lists_are_enough_for_clustered_vectors(spark, tmp_path):
    items = clustered(spark, 3000)
    asked = items.where("vec_id % 20 = 0")
    path = str(tmp_path / "i")
    vi.build_index(items, path)
    about = vi.about(spark, path).first()
    assert (about.rows, about.dims, about.lists) == (3000, 24, 54) and about.probes <= 16
    exact = se.knn(items, asked)
    found = vi.search_index(asked, path)
    assert recall(found, exact) >= 0.9
    assert {(r.query_id, r["rank"]) for r in found.collect()} == {(q, k) for q in range(0, 3000, 20) for k in range(1, 11)}
    # The same with queries cut into many groups; and all lists give the exact neighbours.
    assert sorted(map(tuple, vi.search_index(asked, path, queries_a_task=7).collect())) == sorted(map(tuple, found.collect()))
    everything = vi.search_index(asked, path, probes=54, shortlist=200).select("query_id", "rank", "id", "sim")
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.select("query_id", "rank", "id", "sim").collect()))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_vectors_without_clusters(spark, tmp_path, folder):
    items = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    asked = items.where("vec_id % 20 = 0")
    vi.build_index(items, str(tmp_path / "i"))
    about = vi.about(spark, str(tmp_path / "i")).first()
    assert recall(vi.search_index(asked, str(tmp_path / "i")), se.knn(items, asked)) >= 0.9
    assert about.probes <= 0.7 * about.lists


def test_vector_functions_compute_a_length_once(spark):
    v = spark.createDataFrame([(k, [3.0 * k, 0.0, -4.0 * k]) for k in range(3)], "k int, v array<double>")
    q = v.select("k", vx.quantize(vx.l2_normalize(F.col("v"))).alias("q"))
    assert q._jdf.queryExecution().analyzed().toString().count("zip_with") == 1
    assert [(round(r.q.scale * 127, 12), r.q.qv) for r in q.orderBy("k").collect()] == [(127.0, [0, 0, 0]), (0.8, [95, 0, -127]), (0.8, [95, 0, -127])]
    assert v.select(vx.l2_normalize(F.when(F.col("k") == 5, F.col("v"))).alias("u")).first().u is None


def test_exact_search_in_parts_and_tiles(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (300, 3)).astype(float)  # many equal similarities, some vectors of zeros
    v[:3] = 0
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = {(q, k + 1, i) for q in range(0, 300, 4) for k, i in enumerate(sorted(set(range(300)) - {q}, key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:7])}
    items = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    for block, part in ((20, 30), (1000, 1000)):
        assert {(x.query_id, x["rank"], x.id) for x in se.knn(items, items.where("vec_id % 4 = 0"), 7, block=block, part=part).collect()} == want
    monkeypatch.setattr(se, "TILE", 16)
    names, sims, found = np.arange(0, 300, 4), np.full((75, 7), -np.inf), np.zeros((75, 7), np.int64)
    se.top_k(np.arange(300), unit, names, unit[::4], sims, found)
    assert {(q, k + 1, int(i)) for q, row in zip(names, found, strict=True) for k, i in enumerate(row)} == want
    # With all lists searched, lists give the exact neighbours.
    got = se.ivf(items, items.where("vec_id % 4 = 0 AND vec_id > 2"), 7, lists=5, probes=5)
    assert {(x.query_id, x["rank"], x.id) for x in got.collect()} == {w for w in want if w[0] > 2}


def test_only_lists_that_are_asked_for_are_read(spark, tmp_path):
    items = clustered(spark, 1000)
    path = str(tmp_path / "i")
    vi.build_index(items, path)
    one = items.where("vec_id = 20")
    assert vi.search_index(one, path, probes=2).count() == 10
    codes = vi._codes(spark, path, [3, 5])
    assert {re.search(r"list=(\d+)/", f)[1] for f in codes.inputFiles()} >= {"3", "5"}
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list", plan)
    assert {r.list for r in codes.select("list").distinct().collect()} == {3, 5}


def test_odd_vectors(spark, tmp_path):
    same = [(k, [1.0, 0.0], 0, "q") for k in range(30)]
    rows = [*same, (30, [0.0, 0.0], 0, "q"), (31, None, 0, "q"), (None, [1.0, 1.0], 0, "q"), (32, [-1.0, 0.5], 0, "q"), (32, [-1.0, 0.5], 0, "q")]
    items = spark.createDataFrame(rows, SCHEMA)
    vi.build_index(items, str(tmp_path / "i"))
    got = vi.search_index(items.where("vec_id IN (3, 30, 31)"), str(tmp_path / "i"), k=4, probes=100, shortlist=50).collect()
    assert [(r.id, r.sim) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 3] == [(0, 1.0), (1, 1.0), (2, 1.0), (4, 1.0)]
    assert {r.sim for r in got if r.query_id == 30} == {0.0} and not [r for r in got if r.query_id == 31]
    none = items.limit(0)
    vi.build_index(none, str(tmp_path / "none"))
    assert vi.search_index(items, str(tmp_path / "none")).count() == 0
    assert vi.search_index(none, str(tmp_path / "i")).count() == 0


def test_leaders_by_passes_and_rounds(spark):
    r = random.Random(6)
    names = [(b, f"n{k}", r.choice([None, 1, 2, 3])) for b in (None, "a", "b") for k in range(40)]
    pairs = sorted({tuple(sorted(r.sample([f"n{k}" for k in range(40)], 2))) for _ in range(70)})
    df, links = spark.createDataFrame(names, "c string, name string, n int"), spark.createDataFrame(pairs, "a string, b string")
    near = {(x, y) for a, b in pairs for x, y in ((a, b), (b, a))}
    want = []
    for block in (None, "a", "b"):
        mine = sorted([(n is None, -(n or 0), name, n) for b, name, n in names if b == block])
        leads = []
        for _, _, name, n in mine:
            found = next((x for x in leads if (x, name) in near), None)
            leads += [] if found else [name]
            want.append((block, name, n, found or name))
    for limit in (0, 60, hz.LINKS):
        assert sorted(map(tuple, hz.leaders(df, links, "c", "name", "n", links=limit).collect()), key=str) == sorted(want, key=str)


def test_fielded_search(spark):
    docs = spark.createDataFrame([(1, "health survey", "about nothing", "t"), (2, "nothing", "a health survey of health", "t"), (3, None, None, "t"), (4, "other", "words", "t")], "doc_id long, title string, text string, term string")
    asked = spark.createDataFrame([(7, "Health survey"), (8, "unknown"), (9, None)], "query_id long, text string")
    got = se.fielded_bm25(docs, asked, {"title": 3.0, "text": 1.0}).collect()
    assert [(r.query_id, r["rank"], r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1, 1), (7, 2, 2)]
    flat = se.fielded_bm25(docs, asked, {"title": 0.1, "text": 1.0}).collect()
    assert [r.id for r in sorted(flat, key=lambda r: r["rank"])] == [2, 1]
    assert se.fielded_bm25(docs.limit(0), asked, {"title": 3.0}).count() == 0


def test_assign_in_blocks(spark):
    rng = np.random.default_rng(3)
    items = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)]
    names = [f"c{i:02}" for i in range(30)]
    centres = [(n, [float(x) for x in rng.integers(-2, 3, 4)]) for n in names]
    df = spark.createDataFrame(items, "vec_id int, embedding array<double>")
    c = spark.createDataFrame([*centres, (None, [9.0] * 4)], "label string, centroid array<double>")
    want = {i: min(centres, key=lambda x: (-float(np.dot(x[1], v)), x[0]))[0] for i, v in items}
    for most in (100, 7):
        assert {r.vec_id: r.assigned for r in se.assign(df, c, "label", most=most).collect()} == want
    assert se.assign(df, c.where("false"), "label").where("assigned IS NULL").count() == 200


def test_bm25_has_tasks_for_its_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "common " + "rare " * (k % 3)) for k in range(10)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common rare"), (2, "rare")], "query_id long, text string")
    whole = sorted(map(tuple, se.bm25(docs, asked, 3).collect()))
    monkeypatch.setattr(se, "PAIRS", 1)
    dealt = se.bm25(docs, asked, 3)
    assert re.search(r"RepartitionByExpression \[doc_id#\d+L?\], 20", dealt._jdf.queryExecution().analyzed().toString())
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 6
