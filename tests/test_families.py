"""Merged clusters, families, gates and catalogue rows against hand-worked results and plain versions."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import annotation as an
from tidemark.operators import catalogs as ca
from tidemark.operators import explanations as ex
from tidemark.operators import families as fa
from tidemark.operators import gates as ga
from tidemark.operators import mentions as mn
from tidemark.operators import search as se
from tidemark.operators.mentions import ratio


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_similar_clusters_are_merged(spark):
    rows = [("World Development Indicators", 0, 0.9, 3, {"World Development Indicators": 3}, ["1"]), ("WDI", 0, 0.8, 2, {"WDI": 2}, ["2", "1"]), ("World Development Indicator", 1, 0.99, 1, {"World Development Indicator": 1}, []), ("Labour Force Survey", 0, 0.5, 4, {"Labour Force Survey": 4}, ["9"])]
    df = spark.createDataFrame(rows, "name string, rank int, confidence double, count int, forms map<string,int>, pages array<string>")
    found = {r.name: r for r in fa.merge_similar_clusters(df, ["pages"]).collect()}
    assert set(found) == {"World Development Indicators", "Labour Force Survey"}
    one = found["World Development Indicators"]
    assert (one["count"], one.n_merged, one.pages, one.confidence) == (6, 3, ["1", "2"], 0.9)
    assert one.forms == {"World Development Indicators": 3, "WDI": 2, "World Development Indicator": 1}
    assert fa.merge_similar_clusters(df.limit(0), ["pages"]).count() == 0


def test_absorbed_families_equal_the_loop(spark):
    names = ["Demographic Survey", "DHS Kenya", "Mini DHS", "Living Standards LSMS", "LSMS", "Kenya", "kdhs old", "None"]
    acronyms = ["DHS", "ken", None, "LSMS", "dhs", " ", "x", "KEN"]
    want, used = {}, set()
    for i, a in enumerate(acronyms):
        if i in used:
            continue
        want[i] = i
        for j in range(i + 1, len(names)) if a and a.strip() else ():
            if j not in used and a.strip().lower() in names[j].lower():
                want[j] = i
                used.add(j)
    df = spark.createDataFrame(list(zip(range(len(names)), names, acronyms, strict=True)), "k int, name string, acronym string")
    assert {r.k: r.into for r in fa.absorb_acronyms(df, "k", "name", "acronym").collect()} == want
    assert fa.absorb_acronyms(df.where("k < 0"), "k", "name", "acronym").count() == 0


def test_keys_and_consolidation_equal_the_loop(spark):
    families = [(1, "Demographic and Health Survey", "demographic and health survey", "DHS", ["dhs", "mini-dhs", "demographic health survey", "other"]), (2, "Census", "census", None, ["censuses", "cense"]), (3, "Mini", "mini-dhs", " ", [])]
    keys = fa.family_keys(spark.createDataFrame(families, "ord int, name string, base string, acronym string, variants array<string>"))
    want = {}
    for _, name, base, acronym, variants in families:
        a = (acronym or "").strip()
        shown = f"{name} ({a})" if a else name
        want[base] = shown
        for v in variants:
            if a and (v.startswith(a.lower()) or v.endswith("-" + a.lower())) or ratio(v, base) >= 85:
                want[v] = shown
        if a:
            want[a.lower()] = shown
    assert {r.key: r.canonical for r in keys.collect()} == want
    parts = [("A", "census", ["x"]), ("B", "censuss", ["y", "x"]), ("C", "households of the world", ["z"]), ("D", "dhs", [])]
    done = fa.consolidate(spark.createDataFrame(parts, "name string, base string, aliases array<string>"), keys)
    assert {r.target: r.aliases for r in done.collect()} == {"Census": ["x", "y"], "C": ["z"], "Demographic and Health Survey (DHS)": []}


def test_ratio_pairs_lose_none(spark):
    import random

    r = random.Random(5)
    names = sorted({"".join(r.choice("abc d") for _ in range(r.randint(1, 9))) for _ in range(80)} | {"labour survey", "labor survey", "labour surveys 2", "ab", "ba", ""})
    want = {(a, b) for a, b in itertools.combinations(names, 2) if ratio(a, b) >= 85}
    assert {(x.a, x.b) for x in mn.ratio_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()} == want and len(want) >= 4


def test_boosted_pairs(spark):
    df = spark.createDataFrame([("a", " X "), ("b", "X"), ("c", "Y"), ("d", ""), ("e", None)], "n string, acronym string")
    sets = fa.acronym_map(df, "n", "acronym")
    assert {r.n: r.acronyms for r in sets.collect()} == {"a": ["X"], "b": ["X"], "c": ["Y"]}
    pairs = spark.createDataFrame([("a", "b", 0.3), ("b", "c", 0.4)], "a string, b string, similarity double")
    assert sorted(map(tuple, fa.boost_acronyms(pairs, sets, "n").collect())) == [("a", "b", 0.95), ("b", "c", 0.4)]


@pytest.mark.parametrize("name, person", [("Maria Lopez", True), ("Maria Lopez (UNHCR)", True), ("Ana Maria Lopez", True), ("World Bank", False), ("OECD", False), ("maria lopez", False), ("Kenya Health Survey", False), ("Smith", False), ("A B C D", False), ("", False), ("Databank Smith", False)])
def test_personal_names(spark, name, person):
    assert value(spark, ga.is_personal_name(F.lit(name))) is person


def test_reference_pages_end_a_document(spark):
    rows = [("a", k, t) for k, t in enumerate(["Annex 1", "x", "References\nA", "y"])] + [("b", k, t) for k, t in enumerate(["x", "References here", "y"])] + [("c", 0, "References")]
    kept = ga.before_references(spark.createDataFrame(rows, "doc string, page int, text string"), "doc", "page", "text")
    assert sorted((r.doc, r.page) for r in kept.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]


def test_review_checks(spark):
    facets = F.create_map(F.lit("clarity"), F.create_map(F.lit(" one "), F.lit(" good "), F.lit(" "), F.lit("bad")), F.lit("unknown"), F.create_map(F.lit("x"), F.lit("good")))
    assert value(spark, ga.valid_facets(facets, ["clarity"], ["good", "bad"])) == {"clarity": {"one": "good"}}
    with pytest.raises(PySparkException):
        value(spark, ga.valid_facets(F.create_map(F.lit("clarity"), F.create_map(F.lit("one"), F.lit("odd"))), ["clarity"], ["good"]))
    assert value(spark, ga.valid_basis(F.lit(None).cast("string"), ["model"])) == "explicit" and value(spark, ga.valid_basis(F.lit(" model "), ["model"])) == "model"
    with pytest.raises(PySparkException):
        value(spark, ga.valid_basis(F.lit("odd"), ["model"]))
    for mode, (t, p) in itertools.product(("gt", "pred", "union", "all"), itertools.product((True, False), repeat=2)):
        assert value(spark, ga.renders(F.lit(t), F.lit(p), mode)) is {"gt": t, "pred": p, "union": t or p, "all": True}[mode]
    with pytest.raises(ValueError):
        ga.renders(F.lit(True), F.lit(True), "none")


def test_headers(spark):
    headers = ["Country.Code", "Indicator.Code", "Year", "absZscore_zscore", "Zscore", "Imputed", "outlier_indicator_total", "year"]
    want = {"geography_id": "Country.Code", "indicator_id": "Indicator.Code", "period": "Year", "anomaly_score": "absZscore_zscore", "is_imputed": "Imputed", "outlier_count": "outlier_indicator_total"}
    assert ca.suggest_mapping(headers) == want
    df = spark.createDataFrame([("t", k, h) for k, h in enumerate(headers)], "t string, k int, h string")
    assert {r.canonical: r.source for r in ca.suggest_mappings(df, "t", "k", "h").collect()} == want
    assert ca.valid_targets({"period": "Year", "odd": "Year", "value": "none"}, headers) == {"period": "Year"}
    assert ca.page_to_offset({"page": 3, "ps": 20, "type": "survey", "sk": ""}) == {"limit": 20, "offset": 40, "type": "survey"}


def test_studies_and_variables(spark):
    assert value(spark, F.size(ca.studies(F.lit('{"status":"success","studies":[{"id":1},{"id":2}]}')))) == 2
    assert value(spark, F.size(ca.studies(F.lit('{"status":"success"}')))) == 0
    with pytest.raises(PySparkException):
        value(spark, ca.studies(F.lit('{"status":"error","message":"no"}')))
    v = value(spark, ca.listed_variables(F.lit('{"nvar":"q1","catgry":[{"catValu":"1","labl":"yes"},{"code":"2","label":"no"},{"labl":"none"}]}')))
    assert (v.variable_name, v.label, v.description, v.value_labels) == ("q1", "q1", None, {"1": "yes", "2": "no"})
    with pytest.raises(PySparkException):
        value(spark, ca.pdf_candidates(F.lit('{"external_resources":[{"dcformat":"pdf","is_url":"7","url":"u"}]}')))
    assert value(spark, ca.doi(F.array(F.struct(F.lit("isbn").alias("type"), F.lit("1").alias("identifier")), F.struct(F.lit(" DOI").alias("type"), F.lit("10.1/x").alias("identifier"))))) == "10.1/x"
    dims = F.array(F.struct(F.lit("sex").alias("name"), F.array(F.lit("m"), F.lit("f")).alias("codes")), F.struct(F.lit("age").alias("name"), F.array_repeat(F.lit("a"), 11).alias("codes")))
    assert value(spark, ca.dimensions_text(dims)) == "- sex: m, f"
    group = '{"label":"Age","variables":["a","a"],"definition":"d"}'
    for answer in (group, group.replace('["a","a"]', "[]"), group.replace('["a","a"]', '["b"]')):
        with pytest.raises(PySparkException):
            value(spark, ca.curated_group(F.lit(answer), F.array(F.lit("a")), F.lit(1)))


def test_boxes_and_tasks(spark):
    assert value(spark, an.rect_to_box(F.lit(90.0), F.lit(10.0), F.lit(20.0), F.lit(0.0))) == [0.9, 0.1, 1.0, pytest.approx(0.1, abs=1e-6)]
    box = [0.1, 0.2, 0.5, 0.9]
    r = value(spark, an.box_to_rect(F.array(*map(F.lit, box))))
    assert value(spark, an.rect_to_box(*map(F.lit, r))) == pytest.approx(box)
    assert an.pages_of_tasks(spark.createDataFrame([('{"file":"a","page":1,"results":[]}',)], "t string"), "t").count() == 0


def test_request_schemas():
    schema = {"type": "array", "minItems": 2, "maxItems": 4, "items": {"type": "array", "minItems": 1, "maxItems": 2, "items": [{"type": "array", "maxItems": 1}]}}
    assert ex.loosened(schema) == {"type": "array", "minItems": 1, "items": {"type": "array", "minItems": 1, "items": [{"type": "array"}]}}
    assert ex.loosened({"maxItems": 3, "properties": {"maxItems": {"type": "string"}}}) == {"maxItems": 3, "properties": {"maxItems": {"type": "string"}}}
    assert {"gemini", "anthropic", "openai"} <= set(ex.FORMATTERS)


def test_search_modes(spark):
    assert [se.search_mode(*x) for x in ((10, False), (2000, True), (2001, True))] == ["lexical", "flat", "lists"]
    assert value(spark, se.token_recall(F.lit("a b a"), F.lit("B c"))) == 0.5 and value(spark, se.token_recall(F.lit(""), F.lit("x"))) == 0.0


def test_reduced_vectors_keep_the_strongest_directions(spark):
    import numpy as np

    from tidemark.operators import records as rc

    x = np.random.default_rng(3).normal(size=(200, 12)) * np.arange(12, 0, -1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    got = np.array([r.v for r in rc.reduced(df, "k", "v", 4).orderBy("k").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit @ np.linalg.svd(unit, full_matrices=False)[2][:4].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert got @ got.T == pytest.approx(want @ want.T, abs=1e-8)
    assert len(rc.reduced(df.limit(100), "k", "v", 4).first().v) == 12 and rc.reduced(df.limit(0), "k", "v").count() == 0


def test_mentions_of_odd_records(spark):
    from tidemark.operators import records as rc

    rows = [(1, '[{"mention_name":{"text":"WDI.","start":3},"label":"x"},{"dataset_name":""}]'), (2, '{"dataset_name":"DHS","score":0.5,"dataset_tag":"named"}'), (3, None), (4, "broken"), (5, "[]")]
    got = rc.mentions(spark.createDataFrame(rows, "k int, d string"), ["k"], "d").collect()
    assert sorted((r.k, r.text, r.tag, r.confidence) for r in got) == [(1, "WDI", "x", 0.0), (2, "DHS", "named", 0.5)]


def test_index_round_trip_and_followers(spark, tmp_path):
    items = spark.createDataFrame([(k, [float(k % 3), 1.0], k % 2) for k in range(40)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.next for r in se.following(items, "label", "vec_id", 7).collect()} == {k: k + 2 if k < 38 else None for k in range(40)}
    assigned = items.select("vec_id", "label").withColumnRenamed("label", "assigned")
    se.write_index(items, assigned, se.centroids_by_label(items, "label"), str(tmp_path))
    one = se.read_index(spark, str(tmp_path), [1])
    assert one.count() == 20 and se.dangling(one, items, "vec_id", "vec_id").count() == 0
    assert spark.read.json(f"{tmp_path}/manifest").first().n_items == 40


def test_paragraphs():
    from tidemark.functions.markup import paragraphs

    assert paragraphs("<div>x<p>a <b>bold</b>&amp;c<br>d<p>next<ul><li>no</ul></div><p></p>z<p>open &lt;") == ["a bold&c d", "next", "open <"]
    assert paragraphs(None) == [] == paragraphs("")


def test_prototypes_of_countries(spark):
    from tidemark.operators import harmonize as hz

    rows = [("KEN", "household survey", 3, 0), ("KEN", "household surveys", 5, 1), ("KEN", "population census", 1, 2), ("UGA", "household survey", 2, 3), (None, "household survey", 9, 4), ("KEN", "household survey", 1, 5)]
    got = hz.prototypes(spark.createDataFrame(rows, "country string, name string, n int, place int"), "country", "name", "n", "place", 0.6)
    assert sorted((r.country, r.prototype, r.n, r.aliases) for r in got.collect()) == [("KEN", "household surveys", 8, ["household survey"]), ("KEN", "population census", 1, []), ("UGA", "household survey", 2, [])]


def test_complete_rows(spark):
    df = spark.createDataFrame([("a", 1), (" ", 2)], "x string, y int")
    assert ga.complete(df.where("y = 1"), ["x", "y"]).count() == 1
    with pytest.raises(PySparkException):
        ga.complete(df, ["y", "x"]).count()


def test_paragraphs_come_back_in_pieces(spark):
    from tidemark.functions import markup

    pages = [(k, "".join(f"<p>{k} &amp; {j} {'x' * 400}</p>" for j in range(k)) if k else None) for k in range(120)]
    got = markup.with_paragraphs(spark.createDataFrame(pages, "page_id long, html string").coalesce(1), "html", "b")
    assert got.columns == ["page_id", "b"]
    assert {r.page_id: r.b for r in got.collect()} == {k: markup.paragraphs(h) for k, h in pages}


def test_best_relations_have_tasks_for_their_rows(spark, monkeypatch):
    spans = spark.createDataFrame([(k, 0, 5, "Health Survey") for k in range(40)] + [(40, 0, 5, "Census"), (40, 0, 5, "Labour Force"), (41, 0, 5, None), (None, 0, 5, "Census"), (None, 0, 5, "Census")], "page int, start int, end int, text string")
    told = [(k, "has_producer", 0, 5, t, c) for k in range(40) for t, c in (("health survey", 0.9), (f"Office {k}", 0.5), ("Bank", None), (" ", 1.0))]
    told += [(40, "has_producer", 0, 5, "census", 0.9), (40, "has_producer", 0, 5, "Office A", 0.5), (40, "has_producer", 0, 5, "Office B", 0.5), (40, "other", 0, 5, "Office C", 0.9), (41, "has_producer", 0, 5, "Office", 0.9), (None, "has_producer", 0, 5, "Office", 0.9)]
    relations = spark.createDataFrame(told, "page int, kind string, head_start int, head_end int, tail string, confidence double")
    want = {(k, "Health Survey", f"Office {k}") for k in range(40)} | {(40, "Census", "Office B"), (40, "Labour Force", "census"), (41, None, None), (None, "Census", None)}
    monkeypatch.setattr(ga, "ROWS", 9)
    found = ga.best_relations(spans, relations, ["page"])
    assert len(re.findall(r"RepartitionByExpression \[\w+#\d+, \w+#\d+, \w+#\d+\], 24", found._jdf.queryExecution().analyzed().toString())) == 2
    assert {(r.page, r.text, r.tail) for r in found.collect()} == want
