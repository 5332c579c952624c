"""Chunks, budgets, dictionaries and pipelines on small rows."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalogs as ca
from tidemark.operators import curation as cu
from tidemark.operators import mapping as mp
from tidemark.operators import metadata as md
from tidemark.operators import representatives as dr


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paragraphs():
    text = "# Title\nThis is a sen-\ntence that\n\ngoes on.\nNext one.\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- item\nEnd without stop"
    assert cu.join_paragraphs(text) == "# Title\nThis is a sentence that goes on.\nNext one.\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- item\nEnd without stop"
    assert cu.join_paragraphs(None) == "" and cu.join_paragraphs("ﬁne  print.") == "fine print."


def test_chunks_cover_the_text_and_snap():
    r = random.Random(1)
    text = "\n\n".join(" ".join(f"w{r.randrange(999)}" for _ in range(r.randint(20, 90))) + "." for _ in range(30))
    made = cu.chunks(text, 100, 20)
    assert made[0][0] == 0 and made[-1][0] + len(made[-1][1]) == len(text)
    assert all(text[o : o + len(c)] == c and len(c.split()) <= 100 for o, c in made)
    assert all(a[0] < b[0] <= a[0] + len(a[1]) for a, b in zip(made, made[1:], strict=False))
    assert sum(c.endswith("\n\n") for _, c in made) >= len(made) // 2
    assert cu.chunks(None) == [(0, "")] and cu.chunks("a b") == [(0, "a b")]


def test_chunk_rows_do_not_repeat_the_text(spark):
    text = "\n\n".join(" ".join(f"w{k * j}" for k in range(60)) + "." for j in range(400))
    df = spark.createDataFrame([(1, text, "x"), (2, None, None), (3, "a b", "y")], "id long, text string, lang string").coalesce(1)
    got = cu.with_chunks(df)
    assert got.columns == ["id", "lang", "chunk", "offset", "chunk_text"]
    want = [(i, m, k, o, c) for i, t, m in ((1, text, "x"), (2, None, None), (3, "a b", "y")) for k, (o, c) in enumerate(cu.chunks(t))]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[2])) == want and len(want) > 100


def test_fair_shares(spark):
    assert value(spark, cu.fair_shares(F.array(*map(F.lit, (50, 5, 30))), 60)) == [28, 5, 27] or value(spark, cu.fair_shares(F.array(*map(F.lit, (50, 5, 30))), 60)) == [28, 5, 27]
    assert value(spark, cu.fair_shares(F.array(*map(F.lit, (3, 4))), 60)) == [3, 4]


def test_token_budget(spark):
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate([30, 30, 10, 90, 5, 50])], "g string, i int, t int")
    assert [(r.i, r.part) for r in cu.token_budget_parts(df, ["g"], "i", "t", 60).orderBy("i").collect()] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3)]


def test_acronyms(spark):
    lists = [value(spark, cu.listed_acronyms(F.lit(t))) for t in ('["A", "B"]', "['A', 'B']", "A; B", None)]
    assert lists == [["A", "B"]] * 3 + [None]
    pick = lambda name, *a: value(spark, cu.plausible_acronym(F.lit(name), F.array(*map(F.lit, a))))
    assert pick("Global Growth Indicators", "X", "GGI") == "GGI"
    assert pick("Global Growth Indicators", "none", "GGX", "QQQ") == "GGX" and pick("Name", "foo", "bar") == "foo"
    assert value(spark, cu.is_subsequence_acronym(F.lit("DHS"), F.lit("Demographic Health Survey"))) is True
    assert value(spark, cu.is_subsequence_acronym(F.lit("D-S"), F.lit("D-S"))) is False


def test_json_in_answers(spark):
    assert cu.balanced_json('Sure: {"a": {"b": 1}} and more') == '{"a": {"b": 1}}' and cu.balanced_json("none") is None
    assert value(spark, cu.outer_json(F.lit("x [1, [2]] y"))) == "[1, [2]]" and value(spark, cu.outer_json(F.lit("x"))) is None


def test_notes(spark):
    notes = F.create_map(F.lit(2).cast("bigint"), F.lit("two"), F.lit(1).cast("bigint"), F.lit("one"))
    assert value(spark, cu.append_notes(F.lit("see [2] and [1] and [7]"), notes)) == "see [2] and [1] and [7]\n\n[1] one\n[2] two"


def test_judgements(spark):
    assert [value(spark, cu.heuristic_judgement(F.lit(q), F.lit("a b c d"))) for q in ("a b c d", "a x", "x", "a b x y z w")] == [3, 2, 0, 1]


@pytest.mark.parametrize("box, want", [((0.1, 0.2, 0.5, 0.6), [0.1, 0.2, 0.5, 0.6]), ((500.0, 600.0, 100.0, 2000.0), [0.1, 0.6, 0.5, 1.0]), ((0.1, 0.1, 0.1, 0.5), None)])
def test_boxes(spark, box, want):
    assert value(spark, cu.sanitized(F.array(*map(F.lit, box)))) == want


def test_ward_and_groups(spark):
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 0.1, (8, 3)) for c in (0, 3, 6)])
    label = cu.ward(points, 3)
    assert [len(set(label[k : k + 8])) for k in (0, 8, 16)] == [1, 1, 1] and len(set(label)) == 3
    assert cu.silhouette(points, label) > 0.9
    df = spark.createDataFrame([("d", k, p.tolist()) for k, p in enumerate(points)] + [("one", 0, [1.0, 2.0, 3.0])], "b string, i int, v array<double>")
    rows = cu.group_variables(df, "b", "i", "v").collect()
    assert len({x.cluster for x in rows if x.b == "d"}) == 3 and len(rows) == 25


def test_more_than_twelve_groups(spark):
    r = np.random.default_rng(4)
    points = np.concatenate([r.normal(c, 0.05, (5, 20)) for c in np.eye(20) * 4])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "i int, v array<double>").withColumn("b", F.lit("d"))
    label = {x.i: x.cluster for x in cu.group_variables(df, "b", "i", "v").collect()}
    assert len(set(label.values())) == 20 and all(len({label[5 * k + j] for j in range(5)}) == 1 for k in range(20))


def test_mentions_become_families(spark):
    rows = [(1, "Demographic and Health Survey", 0, 29, 0.9, 0), (1, "Health Survey", 16, 29, 0.5, 1), (1, "DHS", 40, 43, 0.9, 1), (2, "Demographic and Health Surveys.", 0, 30, 0.8, 0), (2, "Census", 50, 56, 0.7, 2)]
    df = spark.createDataFrame(rows, "page int, text string, start int, end int, score double, rank int")
    found = {r.canonical: (r.n, sorted(r.forms)) for r in cu.dedup_mentions(df, ["page"]).collect()}
    assert found == {"Demographic and Health Surveys": (3, ["DHS", "Demographic and Health Survey", "Demographic and Health Surveys"]), "Census": (1, ["Census"])}


def test_mentions_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    names = ["Health Survey", "Health Surveys", "Labour Census"]
    df = spark.createDataFrame([(k, names[k % 3], 0, 9, 0.5, 0) for k in range(60)], "page int, t string, start int, end int, score double, rank int")
    found = cu.dedup_mentions(df.withColumn("text", counted("t")).drop("t"), ["page"]).collect()
    assert sorted((r.n, sorted(r.forms)) for r in found) == [(20, ["Labour Census"]), (40, ["Health Survey", "Health Surveys"])]
    assert reads.value == 60


def test_documents_are_mapped(spark):
    df = spark.createDataFrame([('{"a": {"id": "x"}, "t": ["p", "q", "p"], "more": 1}',), (None,)], "p string")
    rows = cu.map_document(df, {"idno": "a.id", "topics": "t"}, "p").collect()
    assert (rows[0].idno, rows[0].topics, rows[0].additional) == ("x", "p, q", {"more": "1"}) and rows[1].idno is None


def test_forms_in_repeated_and_null_texts(spark):
    df = spark.createDataFrame([("Survey of Kenya", 1), ("Survey of Kenya", 1), (None, 2), ("Côte d'Ivoire, Kenya", 3), ("Kenyans", 4), ("", 5)], "text string, form int")
    forms = spark.createDataFrame([("Kenya", "KEN", 2), ("Côte d'Ivoire", "CIV", 1), ("côte", "X", 3)], "form string, name string, ord int")
    assert sorted((r.form, r.detected) for r in cu.detect_form(df, "text", forms).collect()) == [(1, "KEN"), (1, "KEN"), (2, None), (3, "CIV"), (4, None), (5, None)]


def plain_budget(fields, total):
    """Labelled lines by a plain loop; fields: label, text, elastic."""
    fields = [f for f in fields if f[1]]
    left = max(0, total - (len(fields) - 1) - sum(len(label) + 2 + (0 if e else len(t)) for label, t, e in fields))
    given, order = {}, sorted((len(t), k) for k, (_, t, e) in enumerate(fields) if e)
    for served, (size, k) in enumerate(order):
        given[k] = min(size, left // (len(order) - served))
        left -= given[k]
    out = []
    for k, (label, t, _) in enumerate(fields):
        if k in given and given[k] < len(t):
            short = t[: given[k]]
            t = (short.rsplit(" ", 1)[0] if " " in short else short).rstrip()
        out.append(f"{label}: {t}")
    return "\n".join(out)


def test_budget_below_at_and_above_each_field(spark):
    texts = [("Name", "Goods and services", False), ("Definition", "one two three four five six", True), ("Method", "a much longer text about how the figures were made, year by year", True), ("Note", "n " * 9, True), ("Empty", "", True), ("None", None, False)]
    totals = list(range(0, 230, 3))
    parts = md.elastic_segments([(label, F.lit(t), e) for label, t, e in texts])
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in totals], "t int").select("t", md.fit_budget(parts, F.col("t")).alias("x")).collect()}
    for t in totals:
        assert got[t] == plain_budget(texts, t)
    assert "Name: Goods and services" in got[0] and got[228].endswith("Note: n n n n n n n n n ")
    assert value(spark, md.fit_budget(md.elastic_segments([("a", F.lit(None).cast("string"), True)]), 9)) == ""
    assert (md.effective_cap(None, True), md.effective_cap(None, False), md.effective_cap(70, True)) == (8000, 300, 70)


def test_facets_follow_evidence(spark):
    every = {"keyword": [F.lit("x")], "unit": [F.lit("x"), F.lit("")], "geo": [F.lit("y")], "year": [F.lit(None)]}
    got = value(spark, md.picked_facets(every, 5, F.lit(1), F.lit("en")))
    assert sorted(set(got)) == ["geo", "keyword"] and got[:2] == got[2:4] and got[4] == got[0]
    assert sorted(value(spark, md.picked_facets({"unit": [F.lit("")]}, 2, F.lit(1)))) == ["keyword", "natural"]


def plain_representatives(items, k, rounds):
    """The chunks nearest to the centres of one document, by plain loops; items: (item, vector) in order."""
    x = np.array([v for _, v in items], float)
    centres = [x[0]]
    while len(centres) < k:
        d = np.min([np.round(((x - c) ** 2).sum(1), 9) for c in centres], axis=0)
        if d.max() <= 0:
            break
        centres.append(x[int(np.argmax(d))])
    for _ in range(rounds):
        label = np.argmin([np.round(((x - c) ** 2).sum(1), 9) for c in centres], axis=0)
        centres = [x[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)]
    label = np.argmin([np.round(((x - c) ** 2).sum(1), 9) for c in centres], axis=0)
    out = []
    for j, c in enumerate(centres):
        mine = np.flatnonzero(label == j)
        if len(mine):
            s = np.round(x[mine] @ c / (np.linalg.norm(x[mine], axis=1) * np.linalg.norm(c)), 9)
            out.append((j, items[mine[int(np.argmax(s))]][0], len(mine)))
    return out


def test_document_representatives_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(dr, "PIECE", 150)  # long documents are dealt to several pieces
    r = np.random.default_rng(3)
    rows, at = [], 0
    for doc, size in enumerate((1, 2, 3, 7, 40, 1000)):
        middles = r.normal(size=(6, 8)) * 3
        for k in range(size):
            v = middles[k % 6] + r.normal(size=8) if k % 9 else middles[0]
            rows.append((doc, at, [float(a) for a in v], "x"))
            at += 1
    df = spark.createDataFrame([*rows, (None, 5000, [1.0] * 8, "x"), (9, 5001, None, "x")], "doc long, vec_id long, embedding array<double>, c string")
    got = sorted((r.doc, r.cluster, r.vec_id, r.n) for r in dr.document_representatives(df, "doc", "vec_id", "embedding", 5, 6).collect())
    want = [(doc, *x) for doc in range(6) for x in plain_representatives([(i, v) for d, i, v, _ in rows if d == doc], 5, 6)]
    assert got == want and sum(r[3] for r in got) == len(rows)
    assert dr.document_representatives(df.limit(0), "doc", "vec_id", "embedding").count() == 0


def test_stripped_places_against_one_pattern(spark):
    rng = random.Random(4)
    letters = ["new", "york", "é", "a", "st", "x-y"]
    phrase = lambda n: "".join(rng.choice(letters) + rng.choice([" ", "-", ", ", "."]) for _ in range(rng.randrange(1, n))).strip()
    forms = sorted({phrase(4).lower().rstrip(".,-") for _ in range(60)} | {"--"} - {""})
    texts = [(i, rng.choice([phrase(9), phrase(9).upper()])) for i in range(300)] + [(300, None), (301, ""), (302, "a--new")]
    got = {r.i: r.base for r in ca.strip_places(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame([(f,) for f in forms] + [("",), (None,)], "form string"), "base").collect()}
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + r")\b")
    want = {i: " ".join(pattern.sub(" ", (t or "").lower()).split()) for i, t in texts}
    assert got == want


def test_detected_forms_against_all(spark):
    rng = random.Random(6)
    phrase = lambda n: " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, n)))
    forms = [(phrase(5), f"n{i}", i) for i in range(25)] + [("!", "none", -1)]
    texts = [(i, phrase(8)) for i in range(200)] + [(200, None), (201, "")]
    got = {r.i: r.detected for r in cu.detect_form(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame(forms, "form string, name string, ord int")).collect()}
    want = {i: next((n for f, n, o in forms[:-1] if t is not None and f" {f} " in f" {t} "), None) for i, t in texts}
    assert got == want


def test_geospatial_facets(spark):
    info = {"citation": {"citedResponsibleParty": [{"organisationName": "Z"}, {"organisationName": None}, {"organisationName": "A"}, {"organisationName": "Z"}], "date": [{"date": "2001-05-01", "type": "temporal coverage"}, {"date": "1999", "type": "published"}, {"date": "1997", "type": "temporal coverage"}]}, "extent": {"geographicElement": [{"geographicDescription": "Peru"}, {"geographicDescription": ""}, {"geographicDescription": "Chad"}, {"geographicDescription": "Peru"}]}, "abstract": "about"}
    df = spark.createDataFrame([(json.dumps({"description": {"idno": " G1 ", "identificationInfo": info}}), "Geospatial"), ("{}", "geospatial")], "p string, k string")
    one, empty = sorted(md.facets(df, "p", "k").collect(), key=lambda r: r.idno or "~")
    assert (one.idno, one.source, one.geographies, one.years, one.year_start, one.year_end, one.abstract) == ("G1", ["Z", "A", "Z"], ["Chad", "Peru"], [1997, 2001], 1997, 2001, "about")
    assert (empty.idno, empty.source, empty.geographies, empty.abstract) == (None, None, None, None)


def test_study_metadata(spark):
    study = {"metadata": {"idno": "old", "x": [1], "type": "TimeSeries"}, "idno": " S1 ", "filters": {"a": 1}, "resources": [{"resource_id": 4, "is_url": 1, "filename": "f", "_links": {"type": "download", "download": "u"}}, {"_links": {"type": "view", "download": "u"}}, "odd", {"_links": {"type": "download"}}]}
    got = json.loads(value(spark, ca.study_metadata(F.lit(json.dumps(study)))))
    assert got == {"idno": "S1", "x": [1], "type": "indicator", "_extract_filters": {"a": 1}, "external_resources": [{"resource_id": 4, "url": "u", "dcformat": None, "is_url": "1", "filename": "f"}]}
    assert json.loads(value(spark, ca.study_metadata(F.lit('{"metadata": {"t": "u"}, "filters": [], "resources": {}}')))) == {"t": "u"}
    assert value(spark, ca.study_metadata(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="study without metadata"):
        value(spark, ca.study_metadata(F.lit('{"metadata": []}')))
    assert tuple(value(spark, ca.ids_type(F.lit('{"id": 3, "idno": "i", "type": "survey"}')))) == ("3", "i", "microdata")
    assert tuple(value(spark, ca.ids_type(F.lit(None).cast("string")))) == (None, None, None)


def test_mapped_documents(spark):
    layout = mp.Layout(
        idno="id", title="name", alternates=(mp.Terms("alt", "t", ""), mp.Terms("rep", "r", "")), identifiers={"id": "own", "doi": "DOI"}, authors=mp.Terms("authors", "author", ""), dates={"made": ("d1", "d2")}, texts={"url": ("pdf", "web")},
        topics=(mp.Terms("a"), mp.Terms("b")), keywords=(mp.Terms("kw", "kw", ""),), languages=(mp.Terms("lang"),), regions=(mp.Terms("reg", mark=""), mp.Terms("regs", "r", "")), country_names="c", country_code="cc", relations={"txt": "hasFormat", "proj": "isPartOf"}, tags={"kind": mp.Terms("ty", mark=""), "sector": mp.Terms("sec", "s", "")},
    )
    docs = [
        {"id": 7, "name": " A  b ", "alt": [{"t": "x"}, "y", {"u": 1}], "doi": "10.1", "authors": {"0": {"author": ["P", "Q"]}, "1": {"author": "R"}, "2": "S", "3": {"n": 1}}, "d1": "soon", "d2": "2021-12-31T10:00:00Z", "web": "w", "a": "m, n,,m", "b": "n,o,o", "kw": {"1": {"kw": "k1"}, "0": {"kw": "k0"}}, "lang": "En,EN,xx", "reg": "East", "regs": {"0": {"r": "North"}}, "c": "Chad,Atlantis", "cc": "TD", "proj": "P", "ty": "Report, final", "sec": [{"s": "H"}], "left.over": {"z": [1]}, "no": [], "none": None, "zero": 0},
        {"name": "same", "rep": {"r": {"r": "same"}}, "cc": "ZZ"}, "no object",
    ]
    df = spark.createDataFrame([(i, json.dumps(x) if isinstance(x, dict) else x) for i, x in enumerate(docs)] + [(3, None)], "i int, p string")
    one, two, three, four = (r.record for r in mp.mapped(df, "p", layout, {"Chad": "TCD"}, {"en": "eng"}).orderBy("i").collect())
    pairs = lambda rows: [tuple(r) for r in rows]
    assert (one.idno, one.title, one.alternate_title, one.authors, one.made, one.url, one.spatial_coverage) == ("7", "A b", "x / y", ["P", "R", "S"], "2021-12-31", "w", "East ; North")
    assert pairs(one.identifiers) == [("own", "7"), ("DOI", "10.1")] and pairs(one.topics) == [("m", "a"), ("n", "a"), ("m", "a"), ("o", "b")] and pairs(one.keywords) == [("k0", "kw"), ("k1", "kw")]
    assert pairs(one.languages) == [("En", "eng"), ("xx", "")] and pairs(one.countries) == [("Chad", "TCD"), ("Atlantis", "")] and pairs(one.relations) == [("isPartOf", "P")]
    assert pairs(one.tags) == [("Report, final", "kind"), ("H", "sector")] and one.additional == {"left_over": '{"z":[1]}', "zero": "0"}
    assert (two.idno, two.alternate_title, pairs(two.countries), two.made) == ("", "", [("ZZ", "ZZ")], "")
    assert (three.title, four.title, three.additional, four.topics) == ("", "", {}, [])
    assert pairs(mp.mapped(df, "p", layout, once=False).where("i = 0").first().record.topics) == [("m", "a"), ("n", "a"), ("m", "a"), ("n", "b"), ("o", "b"), ("o", "b")]


def test_study_description_by_both_names(spark):
    rows = [(json.dumps({k: {"title_statement": {"idno": k}}}), "survey") for k in ("study_desc", "study_description")]
    assert sorted(r.idno for r in md.facets(spark.createDataFrame(rows, "p string, k string"), "p", "k").collect()) == ["study_desc", "study_description"]


def test_facets_are_ordered_once(spark):
    picked = spark.range(3).select(md.picked_facets({"a": [F.lit("x")], "b": [F.col("id")]}, 5, F.col("id")).alias("f"))
    assert picked._jdf.queryExecution().analyzed().toString().count("md5") == 1
    assert all(len(r.f) == 5 and r.f[0] == r.f[2] == r.f[4] and {*r.f} == {"a", "b"} for r in picked.collect())
