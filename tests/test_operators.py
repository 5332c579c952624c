"""Operators on small rows whose results are worked out by hand or by brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import evaluation as ev
from tidemark.operators import explanations as ex
from tidemark.operators import graph
from tidemark.operators import harmonize as hz
from tidemark.operators import mentions as mn
from tidemark.operators import metadata as md
from tidemark.operators import quality as q
from tidemark.operators import search as se
from tidemark.operators import timeseries as ts
from tidemark.plans import retrieval
from tidemark.sources import sinks, tables
from tidemark.streaming import upsert as up


def one(spark, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row


def value(spark, column, **values):
    return one(spark, **values).select(column.alias("x")).first().x


def test_ranges_merge_only_where_they_share_a_period(spark):
    rows = [("i", "g", y, float(y), False, 0.0, 3 if y in (2003, 2009, 2017) else 0) for y in range(2000, 2021)]
    rows += [("i", "h", y, 1.0, False, 0.0, 3 if y in (2002, 2010) else 0) for y in range(2000, 2021)]
    df = spark.createDataFrame(rows, "indicator_id string, geography_id string, period int, value double, is_imputed boolean, anomaly_score double, outlier_count int")
    found = sorted((r.geography_id, r.window_start, r.window_end) for r in ts.anomaly_ranges(df).collect())
    assert found == [("g", 2000, 2012), ("g", 2014, 2020), ("h", 2000, 2005), ("h", 2007, 2013)]
    windows = {(r.geography_id, r.window_start): len(r.series) for r in ts.context_windows(df).collect()}
    assert windows["h", 2007] == 7


def test_imputed_points_are_no_anomalies(spark):
    df = spark.createDataFrame([("i", "g", 2000, 1.0, True, 9.0, 5), ("i", "g", 2001, 1.0, None, 2.0, 3)], "indicator_id string, geography_id string, period int, value double, is_imputed boolean, anomaly_score double, outlier_count int")
    df = df.withColumn("is_imputed", ts.imputed_flag("is_imputed"))
    assert [(r.n_points, r.score) for r in ts.shortlist(df).collect()] == [(1, 2.0)]


def test_wide_to_long_keeps_nulls_and_natural_join_matches_nulls(spark):
    wide = spark.createDataFrame([("a", 1.0, None), (None, 2.0, 3.0)], "k string, `2000` double, `2001` double")
    long = ts.wide_to_long(wide, ["k"])
    assert long.count() == 4
    extra = spark.createDataFrame([(None, "x")], "k string, name string")
    assert ts.natural_left_join(long, extra).where("name = 'x'").count() == 2


def test_canonical_names_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "yr int, val int")
    assert ts.rename_to_canonical(df, {"period": "yr", "value": "val", "other": "yr"}).columns == ["period", "value"]
    with pytest.raises(ValueError):
        ts.validate(df)


def test_answers_are_parsed_from_all_layouts(spark):
    a = '{"window": [2000, 2001], "is_anomaly": true, "classification": "data_error", "confidence": 0.9}'
    rows = [("a", f'{{"anomalies": [{a}]}}'), ("b", f"```json\n[{a}, {a}]\n```"), ("c", "no json"), ("d", None)]
    found = ex.parse_answers(spark.createDataFrame(rows, "custom_id string, response string"))
    assert sorted((r.custom_id, r.classification) for r in found.collect()) == [("a", "data_error"), ("b", "data_error"), ("b", "data_error")]


def test_ids_come_from_the_map_before_the_legacy_form(spark):
    h = "0" * 32
    df = spark.createDataFrame([(f"nosearch-ab-SP.POP-TOTL-KEN-{h}",), ("a1x",), ("bad",)], "custom_id string")
    ids = spark.createDataFrame([("a1x", "I", "G")], "custom_id string, indicator_id string, geography_id string")
    assert sorted((r.indicator_id, r.geography_id) for r in ex.resolve_ids(df, ids).collect()) == [("I", "G"), ("SP.POP-TOTL", "KEN")]


def test_agreement_of_explainers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "k int, v string")
    found = ex.agreement(ex.by_context({"a": a, "b": b, "c": a.drop("k")}, ["k"], "v", "v"))
    assert sorted((r.k, r.agreement, r.primary) for r in found.collect()) == [(1, "agree", "x"), (2, "disagree", "x"), (3, "single", "y")]


def test_windows_and_registries(spark):
    assert value(spark, ex.parse_window(F.lit("1999-2003"))).asDict() == {"start": 1999, "end": 2003}
    assert value(spark, ex.parse_window(F.lit("1999"))).asDict() == {"start": 1999, "end": 1999}
    ex.register_formatter("mine", lambda *a: F.lit("x"))
    assert value(spark, ex.FORMATTERS["mine"]()) == "x"
    assert '"custom_id":"c"' in value(spark, ex.FORMATTERS["openai"](F.lit("c"), "m", F.lit("p")))


@pytest.mark.parametrize(
    "name, keep",
    [("Table 1", False), ("Figure 2 and Table 3", False), ("Poverty Assessment Working Paper", False), ("Report No. 123", False), ("Smith et al. (2020)", False), ("Smith and Jones, 2019", False), ("surveys", False), ("Demographic and Health Survey", True), ("NATIONAL STRATEGY FOR STATISTICS DEVELOPMENT", False), ("DHS", True)],
)
def test_name_rules(spark, name, keep):
    assert value(spark, tx.keep_name(F.lit(name))) is keep


@pytest.mark.parametrize(
    "name, figure, title, citation",
    [("Tables 3.1", True, False, False), ("Fig 2a, Fig 2b or Table A-1", True, False, False), ("Table of contents and Map", False, False, False), ("Panel A. Households 2.1", True, False, False), ("Box", False, False, False), ("Table", False, False, False),
     ("Loan agreements", False, True, False), ("Sub-agreement", False, True, False), ("Policy Paper #12", False, True, False), ("paper no. 7", False, True, False), ("Paper 7", False, False, False), ("Progress reports", False, True, False), ("World Development Report", False, False, False),
     ("Smith", False, False, False), ("Smith, Jones and O'neil (1999)", False, False, True), ("Smith, Jones & Lee 1999", False, False, True), ("Smith et al", False, False, True), ("Smith et al., 2004", False, False, True), ("smith 1999", False, False, False), ("and 1999", False, False, False), ("DHS 2010", False, False, False), ("", False, False, False)],
)
def test_name_kinds(spark, name, figure, title, citation):
    x = F.lit(name)
    assert (value(spark, tx.is_figure_ref(x)), value(spark, tx.is_document_title(x)), value(spark, tx.is_citation(x))) == (figure, title, citation)


def better(m, last):
    near = abs(m["score"] - last["score"]) <= 0.05
    size = lambda x: x["end"] - x["start"]
    return m["score"] > last["score"] + 0.05 or near and (size(m) > size(last) or size(m) == size(last) and m["rank"] < last["rank"])


def test_overlaps_keep_the_longer_within_the_margin(spark):
    r = random.Random(2)
    rows = [{"page": r.randrange(30), "id": k, "start": r.randrange(60), "score": r.randrange(20) / 20, "rank": r.randrange(3)} for k in range(600)]
    rows = [x | {"end": x["start"] + r.randrange(1, 25)} for x in rows]
    rows += [{"page": 100, "id": 1000, "start": 0, "end": 50, "score": 0.82, "rank": 1}, {"page": 100, "id": 1001, "start": 3, "end": 8, "score": 0.83, "rank": 0}]
    rows += [{"page": 101, "id": 1002, "start": 0, "end": 3, "score": 0.9, "rank": 1}, {"page": 101, "id": 1003, "start": 0, "end": 28, "score": 0.91, "rank": 1}, {"page": 102, "id": 1004, "start": 0, "end": 3, "score": 0.9, "rank": 1}, {"page": 102, "id": 1005, "start": 0, "end": 3, "score": 0.9, "rank": 0}]
    want = []
    for page in {x["page"] for x in rows}:
        kept = []
        for m in sorted((x for x in rows if x["page"] == page), key=lambda x: (x["start"], x["id"])):
            clash = [k for k in kept if m["start"] < k["end"] and k["start"] < m["end"]]
            if not clash:
                kept.append(m)
            elif all(better(m, k) for k in clash):
                kept = [k for k in kept if k not in clash] + [m]
        want += [k["id"] for k in kept]
    df = spark.createDataFrame([tuple(x[c] for c in ("page", "id", "start", "score", "rank", "end")) for x in rows], "page int, id int, start int, score double, rank int, end int")
    assert sorted(x.id for x in mn.suppress_overlaps(df, ["page"], rank="rank", order=["id"]).collect()) == sorted(want)
    assert {1000, 1003, 1005} <= set(want)
    best = mn.non_overlapping(df, ["page"], "start", "end", [-F.col("score"), F.col("id")])
    assert {x.id for x in best.where("page >= 100").collect()} == {1001, 1003, 1004}


def test_overlaps_in_batches_of_any_size(spark):
    r = random.Random(7)
    rows = [(r.choice([None, 1, 2, 3]), r.randrange(400), r.choice([None, float("nan"), *(k / 20 for k in range(20))]), r.choice([None, 0, 1, 2]), k) for k in range(300)]
    rows = [(page, start, start + r.choice([0, 1, 5, 12]), *rest) for page, start, *rest in rows]
    above = lambda a, b: a > b or a != a and b == b
    want = []
    for page in (None, 1, 2, 3):
        kept = []
        for m in sorted((x for x in rows if x[0] == page), key=lambda x: (x[1], x[5])):
            last = kept[-1] if kept else None
            if last is None or m[2] <= last[1] or last[2] <= m[1]:
                kept.append(m)
                continue
            v, w, size, held = m[3] or 0.0, last[3] or 0.0, m[2] - m[1], last[2] - last[1]
            if above(v, w + 0.05) or abs(v - w) <= 0.05 and (size > held or size == held and None not in (m[4], last[4]) and m[4] < last[4]):
                kept[-1] = m
        want += [m[5] for m in kept]
    df = spark.createDataFrame([(*x, [x[5]]) for x in rows], "page int, start int, end int, score double, rank int, id int, list array<int>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = mn.suppress_overlaps(df, ["page"], rank="rank", order=["id"])
            assert found.schema == df.schema
            assert sorted(x.id for x in found.collect()) == sorted(want) and all(x.list == [x.id] for x in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_text_functions(spark):
    assert value(spark, tx.clean_text(F.lit(" Global Data (GD). "))) == "Global Data (GD"
    assert value(spark, tx.is_english(F.lit("This is an analysis of the data."))) is True
    assert value(spark, tx.is_english(F.lit("Esto es un análisis."))) is False
    assert value(spark, tx.is_english(F.lit(None).cast("string"))) is False
    assert value(spark, tx.is_references_page(F.lit("\n References \n1. A"))) is True
    assert value(spark, tx.is_references_page(F.lit("See references below"))) is False
    assert value(spark, tx.is_acronym_of(F.lit("GG"), F.lit("Global Growth Indicators"))) is True
    assert value(spark, tx.is_acronym_of(F.lit("ABC"), F.lit("Global Trade Data"))) is False
    assert value(spark, tx.strip_numbers_years(F.lit("Survey of 1999 III of"))) == "Survey of"
    assert value(spark, tx.hash_thousandth(F.lit("a"))) == 497
    assert [str(value(spark, tx.flexible_date(F.lit(t)))) for t in ("1948-Q2", "20 Aug 2019", "2001/02/03", "no")] == ["1948-04-01", "2019-08-20", "2001-02-03", "None"]


def test_footnotes_and_tables_and_windows(spark):
    text = "Body [1] and [2]\n| a |\n|---|\n| b |\n\n[1] One\n2 Two notes\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    found = {r.k: r for r in mn.footnotes(df).collect()}
    assert found[1].notes == {1: "One", 2: "Two notes"} and found[1].body == "Body [1] and [2]\n| a |\n|---|\n| b |\n"
    assert found[2].notes == {} and found[3].body == ""
    assert [(r.first_line, r.last_line) for r in mn.table_runs(df, ["k"]).collect()] == [(1, 3)]
    words = spark.createDataFrame([(1, " ".join(map(str, range(450))))], "k int, text string")
    chunks = mn.token_windows(words).orderBy("chunk").collect()
    assert [(c.first_token, c.n_tokens) for c in chunks] == [(0, 200), (150, 200), (300, 150)]
    assert value(spark, mn.sentence_context(F.lit("A b. C d! E f? G."), F.lit(6), 1)) == "A b. C d! E f?"


def test_overlaps_keep_the_best_span(spark):
    rows = [(1, 0, 10, 0.9), (1, 5, 12, 0.5), (1, 20, 25, 0.5), (1, 20, 30, 0.52), (2, 0, 10, None), (1, 40, 41, 0.1)]
    df = spark.createDataFrame(rows, "page int, start int, end int, score double")
    assert sorted((r.page, r.start, r.end) for r in mn.suppress_overlaps(df, ["page"]).collect()) == [(1, 0, 10), (1, 20, 30), (1, 40, 41), (2, 0, 10)]


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_fuzzy_ratios():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert mn.lcs(a, b) == brute_lcs(a, b)
    assert mn.are_fuzzy_duplicates("Demographic and Health Surveys", "Demographic Health Survey")
    assert not mn.are_fuzzy_duplicates("DHS", "NHS")
    assert mn.token_sort_ratio("a b", "b a") == 100.0


def test_fuzzy_pairs_lose_none(spark):
    r = random.Random(5)
    words = "demographic health survey census labour force living standards population household budget national".split()
    names = sorted({" ".join(r.sample(words, r.randint(2, 4))) + r.choice(["", "s", " 2"]) for _ in range(150)})
    want = {(a, b) for a, b in itertools.combinations(names, 2) if mn.are_fuzzy_duplicates(a, b)}
    got = {(x.a, x.b) for x in mn.fuzzy_pairs(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), "name").collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_fuzzy_pairs_are_all_pairs(spark):
    r = random.Random(8)
    words = "demographic health survey census labour force living standards population household budget national".split()
    names = {"Labour Survey", "Labour Survey Kyrgyzstan Uzbekistan Tajikistan"} | {f"Labour Survey {c}" for c in "Albania Benin Chad Denmark Egypt Fiji Ghana Haiti India Jordan Kenya Laos Malta Nepal Oman Peru Qatar Rwanda Spain Togo".split()}
    names |= {" ".join(r.sample(words, r.randint(1, 9))) for _ in range(90)}
    for n in sorted(names):
        w = n.split()
        names |= {" ".join(w[: r.randint(1, len(w))]), " ".join(r.sample(w, len(w))), n.upper() if r.random() < 0.2 else n}
        k = r.randrange(len(n))
        names.add(n[:k] + r.choice(["", "x", "zq"]) + n[k + r.randint(0, 2) :])
    names |= {"", " ", "  ", "a", "A", "ab", "b a", "a b", "aaaaaaaaaaaaaa", "aaaaaaaaaaaa", "Straße", "STRASSE"}
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if mn.are_fuzzy_duplicates(a, b)}
    got = [(x.a, x.b) for x in mn.fuzzy_pairs(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), "name").collect()]
    assert set(got) == want and len(got) == len(want)
    assert ("Labour Survey", "Labour Survey Kyrgyzstan Uzbekistan Tajikistan") in want


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: min(m for m in parent if find(m) == find(n)) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_name_families(spark):
    df = spark.createDataFrame([("K", "labour force survey", 5), ("K", "labour force surveys", 3), ("K", "health census", 2), ("L", "labour force survey", 1)], "c string, name string, n long")
    pairs = hz.similar_names(df.select("name").distinct(), "name", "name", 0.5)
    found = {(r.c, r.leader): (r.n, r.aliases) for r in hz.families(hz.leaders(df, pairs, "c", "name", "n"), "c", "name", "n").collect()}
    assert found == {("K", "labour force survey"): (8, ["labour force surveys"]), ("K", "health census"): (2, []), ("L", "labour force survey"): (1, [])}
    assert one(spark, t="Côte d’Ivoire: ÉTUDE").select(hz.ascii_name("t").alias("x")).first().x == "cote divoire etude"


def test_leaders_equal_the_plain_ones(spark):
    r = random.Random(3)
    rows = [(r.choice("KLM"), f"n{k}", r.randint(1, 4)) for k in range(60)] + [(None, "n1", 2), (None, "n2", 3)]
    pairs = sorted({tuple(sorted(r.sample([f"n{k}" for k in range(60)], 2))) for _ in range(300)} | {("n1", "n2")})
    near = {p for a, b in pairs for p in ((a, b), (b, a))}
    want = {}
    for block, name, _ in sorted(rows, key=lambda x: (-x[2], x[1])):
        want[block, name] = next((n for (b, n), l in want.items() if b == block and l == n and (name, n) in near), name)
    df = spark.createDataFrame(rows, "c string, name string, n long")
    got = hz.leaders(df, spark.createDataFrame(pairs, "a string, b string"), "c", "name", "n").collect()
    assert {(x.c, x.name): x.leader for x in got} == want and len(got) == len(rows)


def test_boxes_and_greedy_matching(spark):
    def boxes(rows):
        return spark.createDataFrame(rows, "page int, label string, id int, x1 double, y1 double, x2 double, y2 double").select("page", "label", "id", ev.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("box"))

    r = random.Random(4)
    rect = lambda: (lambda x, y: (x, y, x + 0.3, y + 0.3))(r.random() * 0.3, r.random() * 0.3)
    truth, found = ([(p, "F", k, *rect()) for p in range(6) for k in range(4)] for _ in range(2))
    got = {(m.page, m.p, m.g) for m in ev.greedy_match(ev.iou_pairs(boxes(truth), boxes(found), ["page", "label"], 0.3), ["page", "label"]).collect()}

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        o = max(0, w) * max(0, h)
        return o / (0.18 - o)

    want = set()
    for p in range(6):
        pairs = sorted(((-iou(f[3:], t[3:]), f[2], t[2]) for f in found for t in truth if f[0] == t[0] == p), key=lambda x: x)
        for s, f, t in pairs:
            if -s >= 0.3 and not any(w[0] == p and (w[1] == f or w[2] == t) for w in want):
                want.add((p, f, t))
    assert got == want
    total = {(x.threshold, x.label): x for x in ev.evaluate(boxes(truth), boxes(truth), "page", "label").collect()}
    assert total[0.5, "all"].precision == 1.0 and total[0.75, "F"].tp == 24


def test_metadata(spark):
    payload = '{"series_description": {"idno": " X1 ", "authoring_entity": [{"name": "B"}, {"name": "A"}, {"name": "B"}], "ref_country": [], "time_periods": [{"start": "1990", "end": "1992-05-01"}, {"start": "bad"}]}}'
    row = md.facets(one(spark, p=payload, k="TimeSeries"), "p", "k").first()
    assert (row.idno, row.source, row.geographies, row.years, row.year_end) == ("X1", ["A", "B"], None, [1990, 1992], 1992)
    with pytest.raises(Exception, match="unknown metadata type"):
        md.facets(one(spark, p=payload, k="other"), "p", "k").collect()
    labels = F.array(F.lit("[A] x"), F.lit("[B] y"), F.lit("[A] z"), F.lit("none"))
    assert value(spark, md.label_values(labels)) == {"A": ["x", "z"], "B": ["y"]}


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    assert value(spark, vx.l2_normalize(v)) == [0.6, 0.8]
    assert value(spark, vx.quantize(F.array(F.lit(0.0), F.lit(0.0))))["scale"] == 1.0
    assert value(spark, vx.quantize(v))["qv"] == [95, 127]


def test_hard_negatives_reach_rank_thirty(spark, data):
    ranks = spark.createDataFrame([(1, 0, 1)] + [(1, k, k + 1) for k in range(1, 35)], "query_id long, id long, rank int")
    positive = spark.createDataFrame([(1, 0)], "query_id long, id long")
    vectors = lambda copies: spark.createDataFrame([(k, [1.0, 0.0] if k <= copies else [0.0, 1.0]) for k in range(35)], "vec_id long, embedding array<double>")
    got = lambda copies, n: [x.id for x in se.hard_negatives(ranks, positive, vectors(copies), n=n).collect()]
    assert sorted(got(0, 99)) == list(range(4, 31))
    assert len(got(12, 3)) == 3 and set(got(12, 3)) <= set(range(13, 31))
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").toPandas().sort_values("vec_id")
    ids, labels, v = e["vec_id"].to_numpy(), e["label"].to_numpy(), np.array(e["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        after = np.flatnonzero((labels == labels[q]) & (ids > ids[q]))
        if len(after):
            order = [k for k in np.lexsort((ids, -np.round(v @ v[q], 9))) if k != q][:31]
            kept = [ids[k] for k in [k for k in order if k != after[0]][3:30] if round(float(v[k] @ v[after[0]]), 9) <= 0.95]
            kept.sort(key=lambda i: (hashlib.md5(f"{ids[q]}-{i}".encode()).hexdigest(), i))
            want |= {(ids[q], ids[after[0]], i, n + 1) for n, i in enumerate(kept[:3])}
    assert {(x.query_id, x.positive, x.id, x.pick) for x in retrieval.hard_negatives(spark, data).collect()} == want


def test_quality(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), (None, 1.0, 3)], "k string, v double, o int")
    assert [(r.k, r.o) for r in q.keep_most_complete(df, "k", ["v"], "o").orderBy("o").collect()] == [("a", 2), (None, 3)]
    assert q.profile(df, "k", "v").collect()[0].n == 1
    assert q.histogram(df.limit(0), F.col("v")).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ind,yr,val\nSI.POV,2000,1\nXSI.POV,2001,2\n")
    df = tables.mapped_csv(spark, str(tmp_path / "a.csv"), {"indicator_id": "ind", "period": "yr", "value": "val"}, pattern=r"SI\.", check=False)
    assert [r.indicator_id for r in df.collect()] == ["SI.POV"]
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "m.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert tables.json_records(spark, str(tmp_path / "l.json")).count() == tables.json_records(spark, str(tmp_path / "m.json")).count() == 2
    sinks.write_json(df, str(tmp_path / "out"), gzip=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    sinks.write_csv(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().m == '{"a":1}'
    assert tables.pages(5, 2) == [(0, 2), (2, 2), (4, 2)]
    got = tables.fetch(spark, tables.pages(5, 2), lambda offset, limit: [{"id": k} for k in range(offset, min(5, offset + limit))], "id bigint")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_upserts_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k int, t int, v string"
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d"), (2, 0, "late")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        up.upsert(stream, str(tmp_path / "state"), str(tmp_path / "progress"), ["k"], ["t"]).awaitTermination()
    state = up.Snapshots(spark, str(tmp_path / "state"))
    assert sorted((r.k, r.v) for r in state.latest().collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_memoised_verdicts(spark):
    rows, cache = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "old")], "k int, v string")
    got, fresh = up.memoised(rows, cache, "k", lambda df: df.withColumn("v", F.lit("new")))
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "old"), (2, "new")] and fresh.count() == 1


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["indicator_id", "geography_id", "window_start", "window_end", "series"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
