"""Typed templates over mixed JSON, against hand-worked results and a plain loop."""

from __future__ import annotations

import json
import random

import pytest

from tidemark.operators import templates as te

DOCS = [
    (3, '{"id": "x3", "tags": "one", "info": [1], "links": []}'),
    (1, '{"id": 1, "tags": ["a", "b"], "info": {"n": 2, "w": 0.5}, "links": [{"to": 7}, {"to": "seven", "by": {"k": null}}], "OBJECT": true, "none": null}'),
    (2, '{"id": 2, "tags": [], "info": {"n": "many"}, "a b": [[1], []]}'),
    (4, "[1, 2]"), (5, "no json"), (6, None), (7, ""),
]


def test_first_value_decides(spark):
    df = spark.createDataFrame(DOCS, "k int, p string")
    template = te.typed_template(df, "p", "k")
    assert template[0].simpleString() == "struct<OBJECT:boolean,a b:array<array<bigint>>,id:bigint,info:struct<n:bigint,w:double>,links:array<struct<by:struct<k:variant>,to:bigint>>,none:variant,tags:array<string>>"
    assert template[1] == {("id",): "NUMBER", ("info",): "OBJECT", ("info", "n"): "NUMBER", ("links", "[]", "to"): "NUMBER", ("tags",): "ARRAY"}
    rows = {r.k: r for r in te.conform(df, "p", template).collect()}
    assert len(rows) == 7
    misfits = {k: sorted(map(tuple, r.misfits)) for k, r in rows.items()}
    assert misfits == {1: [("links.[].to", '"seven"')], 2: [("info.n", '"many"')], 3: [("id", '"x3"'), ("info", "[1]"), ("tags", '"one"')], 4: [("", "[1, 2]")], 5: [("", "no json")], 6: [], 7: [("", "")]}
    one = rows[1].record
    assert (one.OBJECT, one.id, one.info.n, one.info.w, one.tags, [x.to for x in one.links]) == (True, 1, 2, 0.5, ["a", "b"], [7, 0])
    assert (rows[2].record.tags, rows[2].record["a b"], rows[2].record.info.n, rows[3].record.id) == ([], [[1], []], 0, 0)
    assert (rows[6].record.id, rows[6].record.info.w, rows[6].record.links) == (0, 0.0, [])
    placed = {r.k: r.record for r in te.conform(df, "p", template, placeholders=True).collect()}
    assert (placed[2].tags, placed[6].links[0].to, placed[2]["a b"]) == ([""], 0, [[1], [0]])


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "k int, p string")
    assert te.typed_template(none, "p", "k")[0].fields == []
    assert te.conform(none, "p", te.typed_template(none, "p", "k")).count() == 0
    wide = spark.createDataFrame([(1, json.dumps({f"k{i}": i for i in range(20)}))], "k int, p string")
    with pytest.raises(ValueError):
        te.typed_template(wide, "p", "k", most=10)
    with pytest.raises(ValueError):
        te.unify_folders(spark, ["/a/x", "/b/x"], "/nowhere")


def plain_kinds(records):
    """By path the kind of its first value, lists and objects walked; a path whose parent's kind doesn't hold it isn't there."""
    kinds = {}
    name = lambda v: "OBJECT" if isinstance(v, dict) else "ARRAY" if isinstance(v, list) else "BOOLEAN" if isinstance(v, bool) else "STRING" if isinstance(v, str) else "NUMBER"
    level = [((), r) for r in records]
    while level:
        for at, v in level:
            if v is not None:
                kinds.setdefault(at, name(v))
        level = [x for at, v in level if v is not None and name(v) == kinds[at] for x in ([((*at, k), w) for k, w in v.items()] if isinstance(v, dict) else [((*at, "[]"), w) for w in v] if isinstance(v, list) else [])]
    return kinds


def kinds_of(kind, at=()):
    name = kind.typeName()
    if name == "struct":
        yield at, "OBJECT"
        for f in kind:
            yield from kinds_of(f.dataType, (*at, f.name))
    elif name == "array":
        yield at, "ARRAY"
        yield from kinds_of(kind.elementType, (*at, "[]"))
    elif name != "variant":
        yield at, {"string": "STRING", "boolean": "BOOLEAN"}.get(name, "NUMBER")


def test_against_a_plain_loop(spark):
    rng = random.Random(5)

    def value(depth):
        pick = rng.randrange(7 if depth else 4)
        if pick == 4:
            return {k: value(depth - 1) for k in rng.sample(["x", "y", "it's"], rng.randrange(1, 3))}
        if pick == 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return [None, rng.randrange(9), rng.choice("ab"), rng.random() < 0.5, None, None, [{"z": rng.randrange(3)}]][pick]

    for n in (2, 12):
        records = [{k: value(2) for k in rng.sample("abc", rng.randrange(1, 4))} for _ in range(n)]
        df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k int, p string").repartition(3)
        want = {at: kind for at, kind in plain_kinds(records).items()}
        assert dict(kinds_of(te.typed_template(df, "p", "k")[0])) == want


def test_folders(spark, tmp_path):
    for folder, name, text in [("a", "1.json", '{"x": 1, "l": [{"q": "u"}]}'), ("a", "2.json", '{"x": "n", "l": []}'), ("b", "1.json", '{"y": "z"}')]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = te.unify_folders(spark, [f"{tmp_path}/a", f"{tmp_path}/b/"], f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1), ("b", 1, 0)]
    lines = {(r["file"], r["folder"]): r["record"].asDict(True) for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert lines["2.json", "a"] == {"l": [{"q": ""}], "x": 0, "y": ""}
    assert lines["1.json", "b"] == {"l": [{"q": ""}], "x": 0, "y": "z"}
