"""Paged sources, tables in runs and fuzzy waves: each record once over triggers and failures, writes that follow the batch, families as a plain loop gives them."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import mentions as mn
from tidemark.operators.mentions import ratio
from tidemark.sources.paging import JsonPages, Page, PagedSource, write_pages
from tidemark.streaming import upsert as up


class Catalogue(PagedSource):
    """Records 0 to n - 1, where n stands in a file; each request is noted, and every page fails at first as often as the option says."""

    filters = {"kind": "type"}

    @classmethod
    def name(cls) -> str:
        return "test_catalogue"

    def schema(self) -> str:
        return "id long, kind string, missing string"

    def page(self, params: dict, offset: int, limit: int) -> Page:
        folder = self.options["folder"]
        with open(f"{folder}/asked", "a") as file:
            file.write(json.dumps([params, offset, limit]) + "\n")
        mark = f"{folder}/failed-{offset}"
        before = int(open(mark).read()) if os.path.exists(mark) else 0
        if before < self.number("failures", 0):
            with open(mark, "w") as file:
                file.write(str(before + 1))
            raise OSError("not now")
        n = int(open(f"{folder}/n").read())
        found = [k for k in range(n) if params.get("type") in (None, f"k{k % 3}")]
        return Page([{"id": k, "kind": f"k{k % 3}"} for k in found[offset : offset + limit]], offset + limit < len(found))


@pytest.fixture
def catalogue(spark, tmp_path):
    spark.dataSource.register(Catalogue)
    (tmp_path / "n").write_text("1003")

    def read(stream: bool = False, **options):
        reader = (spark.readStream if stream else spark.read).format("test_catalogue").option("folder", str(tmp_path)).option("pause", 0.001)
        for name, value in options.items():
            reader = reader.option(name, value)
        return reader.load()

    return read, tmp_path


def asked(folder) -> list:
    return [json.loads(x) for x in (folder / "asked").read_text().splitlines()]


@pytest.mark.parametrize("options", [{}, {"page_size": 1, "tasks": 3}, {"page_size": 17, "tasks": 1}, {"page_size": 1003}, {"page_size": 5000, "tasks": 2}, {"failures": 2}])
def test_pages_give_each_record_once(catalogue, options):
    read, folder = catalogue
    assert sorted(r.id for r in read(**options).collect()) == list(range(1003))
    size, tasks = options.get("page_size", 100), options.get("tasks", 16)
    assert len(asked(folder)) <= (-(-1003 // size) + tasks) * (1 + options.get("failures", 0))
    (folder / "n").write_text("0")
    assert read(**options).count() == 0


def test_pages_end_at_the_limit_and_fail_for_good(catalogue):
    read, folder = catalogue
    assert sorted(r.id for r in read(max_items=250, page_size=100).collect()) == list(range(250))
    assert sorted(x[1:] for x in asked(folder)) == [[0, 100], [100, 100], [200, 50]]
    assert read(max_items=0).count() == 0
    with pytest.raises(PySparkException):
        read(failures=50).count()


def test_pages_are_filtered_by_the_source(spark, catalogue):
    read, folder = catalogue
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r.id for r in read(push_filters="true").where("kind = 'k1' AND id > 10").collect()) == [k for k in range(11, 1003) if k % 3 == 1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {json.dumps(x[0]) for x in asked(folder)} == {'{"type": "k1"}'}


def test_stream_of_pages_goes_on_after_growth_and_failure(spark, catalogue):
    read, folder = catalogue

    def run(each=None):
        df = read(stream=True, page_size=100)
        writer = df.writeStream.foreachBatch(each) if each else df.writeStream.format("parquet").option("path", str(folder / "out"))
        query = writer.option("checkpointLocation", str(folder / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()

    def ids():
        return sorted(r.id for r in spark.read.schema("id long").parquet(str(folder / "out")).collect())

    for n in (0, 420, 420, 1000):
        (folder / "n").write_text(str(n))
        run()
        assert ids() == list(range(n))
    (folder / "n").write_text("1003")
    marks = len(asked(folder))

    def dies(batch, number):
        assert batch.count() == 3
        raise RuntimeError("killed")

    with pytest.raises(PySparkException):
        run(dies)
    (folder / "n").write_text("1100")  # what came meanwhile waits for the batch after the one that failed
    run()
    assert ids() == list(range(1003))
    run()
    assert ids() == list(range(1100))
    assert min(x[1] for x in asked(folder)[marks:]) >= 0 and len(asked(folder)) - marks < 40


def test_written_pages(spark, tmp_path):
    spark.dataSource.register(JsonPages)
    rows = [(k, f"name {k}", [k, None]) for k in range(0, 700, 7)]
    df = spark.createDataFrame([*rows, (None, "no key", [])], "k long, name string, list array<long>")
    write_pages(df, str(tmp_path / "pages"), "k", 50)
    for size in (1000, 50, 33):
        got = spark.read.format("json_pages").option("path", str(tmp_path / "pages")).option("fields", "k long, name string, list array<long>").option("page_size", size).load()
        assert sorted(map(tuple, got.collect())) == rows
    write_pages(df.limit(0), str(tmp_path / "none"), "k")
    assert spark.read.format("json_pages").option("path", str(tmp_path / "none")).option("fields", "k long").load().count() == 0


# Runs


def test_runs_write_what_a_batch_brings(spark, tmp_path):
    state, want = up.Runs(spark, str(tmp_path / "t"), up.newest(["k"], ["t"])), {}
    schema = "k int, t int, v string"
    big = spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    state.write(big, 0)
    want = {r.k: r.v for r in big.collect()}
    base, sizes, r = state.size((0, 0)), [], random.Random(3)
    for number in range(1, 20):
        rows = [(r.randrange(20_500), number, f"{number}") for _ in range(30)] + [(5, -1, "late")]
        state.write(spark.createDataFrame(rows, schema), number)
        sizes.append(state.size((number, number)))
        want |= {k: v for k, t, v in rows if t > 0}
    assert max(sizes) < base / 50
    assert state.found()[0] == (0, 0) and len(state.found()) <= 6  # the first run was never written again
    assert {x.k: x.v for x in state.latest().collect()} == want
    before = state.found()
    state.vacuum()
    assert state.found() == before and {x.k: x.v for x in state.latest().collect()} == want
    names = [n for n in os.listdir(tmp_path / "t") if n.startswith("run=")]
    assert len(names) == len(before)


def test_runs_after_a_failure(spark, tmp_path):
    """A run that wasn't finished doesn't count; a batch that is run again changes nothing."""
    state = up.Runs(spark, str(tmp_path / "t"), up.newest(["k"], ["t"]))
    rows = lambda n: spark.createDataFrame([(k, n, f"{n}") for k in range(n, n + 3)], "k int, t int, v string")
    for n in range(5):
        state.write(rows(n), n)
    want = sorted(map(tuple, state.latest().collect()))
    broken = tmp_path / "t" / "run=0-4"
    had = broken.exists()
    broken.mkdir(exist_ok=True)
    if not had:
        (broken / "part-0.parquet").write_bytes(b"half")
    state.write(rows(4), 4)
    state.write(rows(4), 4)
    assert sorted(map(tuple, state.latest().collect())) == want == [(0, 0, "0"), (1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 4, "4"), (6, 4, "4")]


# Waves


def names_of(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = "demographic health survey census labour force living standards population household budget national".split()
    names = {"", "a", "ab", "abc", "abcd", "Straße", "x" * 90}
    while len(names) < n:
        name = " ".join(r.sample(words, r.randint(1, 5))) + r.choice(["", " 2011", "s"])
        k = r.randrange(len(name))
        names |= {name, name[:k] + r.choice(["", "z"]) + name[k + 1 :]}
    return r.sample(sorted(names), n)


@pytest.mark.parametrize("least", [85.0, 92.0, 60.0])
def test_waves_are_those_of_a_plain_loop(spark, tmp_path, least):
    names = names_of(4, 90)
    waves = [names[:50], [*names[50:60], names[0]], names[60:70], names[70:]]
    known, families = {}, {}
    state = up.FamilyWaves(spark, str(tmp_path / "w"), least=least)
    for number, wave in enumerate(waves):
        found = {}
        for name in wave:
            ranked = sorted((-ratio(name, k), k) for k in known if ratio(name, k) >= least)
            found[name] = known[ranked[0][1]] if ranked else name
        for name, target in found.items():
            families.setdefault(target, set()).add(f"alias of {name}")
        known |= found
        df = spark.createDataFrame([(n, [f"alias of {n}"]) for n in wave] + [(None, ["lost"])], "key string, names array<string>")
        state.integrate(df, number)
        if number == 2:  # run again
            state.integrate(df, number)
        got = {r.key: set(r.names) for r in state.families.latest().collect()}
        assert got == families
    assert len(families) < len(names)


def test_tokens_lose_no_pair(spark):
    names = names_of(7, 160)
    df = spark.createDataFrame([(n,) for n in names], "a string")
    for least in (85.0, 70.0, 50.0):
        tokens = mn.near_tokens(df, least)
        got = {(r.a, r.b) for r in mn.ratios_between(tokens, tokens.withColumn("target", F.col("a")), least).collect()}
        assert got == {(a, b) for a in names for b in names if ratio(a, b) >= least and (a or b)}
