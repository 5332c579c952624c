"""The operators against plain versions, on small tables and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import bpe, catalog, chatformat, ctw, decontam, htmltext, imatch, langid, near_dedup, suffix_dedup, toxicity

VOCABULARY, PIECES = catalog.vocabulary("byte_bpe_50k.json"), catalog.vocabulary("piece_bpe_32k.model")
CLASH = "doc_id long, text string, lang string, t string, d int, v int, m string, h int, n int, score double, row string, id int, spans string, items string, key int, node int, sig int"


def docs_of(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    filler = ("x", 1, 2, "m", 3, 4, 0.5, "r", 5, "s", "i", 6, 7, 8)
    return spark.createDataFrame([(i, t, lang, *filler) for i, t, lang in rows], CLASH)


LONG = " ".join(f"word{k % 977} item{k % 31}" for k in range(30_000))
ODD = [(1, None, "en"), (2, "", None), (None, "no id here at all", "en"), (3, "  \n\t ", "en"), (4, "Same text for two rows, é ü 中 😀", "de"), (4, "Same text for two rows, é ü 中 😀", "de"), (5, LONG, "en"), (6, "short", None), (None, None, None), (7, "x" * 500 + " <|endoftext|> " + "y" * 300, "fr")]


def small(spark, data, name="documents"):
    return spark.read.parquet(f"{data}/{name}.parquet")


# 1


@pytest.mark.parametrize("depth", [3, 5, 7])
def test_ctw_equals_the_plain_trees(spark, depth, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat", "", None, "a cat! é", "the cat sat on the mat", "on on on", "zebra the", "a12345x", "b12345y", "a12345x b12345y", "\0" * 20, "zebra zebu zzz"]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    learn = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    tree = brute.Ctw(depth, learn, [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2])
    counts = Counter(w for t in learn for w in brute.tokens(t))
    total, types = sum(counts.values()), len(counts)
    for limit in (ctw.HEAD, 12):
        for r in ctw.scores(docs_of(spark, rows), limit=limit, depth=depth).collect():
            w = brute.tokens(texts[r.doc_id])
            assert r.score == pytest.approx(tree.score(texts[r.doc_id]), rel=1e-9)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), rel=1e-12)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_ctw_counts_equal_sql(spark, data):
    """All columns but the model's own score."""
    con = duckdb.connect()
    con.create_function("crc", lambda x: zlib.crc32(x.encode()), ["VARCHAR"], "BIGINT")
    want = con.execute(f"""
        WITH d AS (SELECT doc_id, crc(CAST(doc_id AS VARCHAR)) % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS w FROM '{data}/documents.parquet'),
        c AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM d WHERE NOT held_out) GROUP BY t),
        s AS (SELECT sum(c) AS n, count(*) AS v FROM c),
        e AS (SELECT doc_id, held_out, unnest(w) AS t FROM d)
        SELECT doc_id, any_value(held_out), count(*), count(c.c), any_value(n), sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))) FROM e LEFT JOIN c ON e.t = c.t, s GROUP BY doc_id""").fetchall()
    for limit in (ctw.HEAD, 500):
        got = {r.doc_id: r for r in ctw.scores(small(spark, data), limit=limit, depth=4).collect()}
        assert len(got) == len(want)
        for i, held, n, known, total, base in want:
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)


def test_ctw_on_odd_rows_and_nothing(spark):
    got = ctw.scores(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert ctw.scores(docs_of(spark, [])).count() == 0


# 2


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_classes_equal_the_plain_ones(spark, data):
    r = random.Random(7)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(40)) for _ in range(120)) for _ in range(4)]
    texts = [edited(r, b, n) for b in base for n in (0, 0, 1, 2, 3, 4, 5, 6, 8)] + [None, "", "one two", "one two", "One, two!", "x", LONG, LONG + " tail"]
    texts += [edited(r, base[0], 6) for _ in range(40)]
    want = brute.near_classes(texts)
    got = {row.doc_id: row.class_id for row in near_dedup.classes(docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("paired", [4, 1024])
def test_one_large_bucket_of_many_components(spark, monkeypatch, paired):
    """Texts too unlike for a link share bands; what is apart meets in blocks."""
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    r = random.Random(17)
    base = " ".join(f"word{r.randrange(300)}" for _ in range(150))
    texts = []
    for _ in range(25):
        middle = edited(r, base, 5)
        texts += [edited(r, middle, n) for n in (0, 1, 2, 3)]
    want = brute.near_classes(texts)
    assert 3 < len(set(want)) < 90
    got = {row.doc_id: row.class_id for row in near_dedup.classes(docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_recall_of_exact_pairs(spark):
    """Of all pairs of unlike texts at 0.8 or more by exact sums over the whole table, those in one class."""
    rows = [(r.doc_id, r.text) for r in small(spark, "/root/testdata/sf0.01").collect()]
    pairs = brute.near_pairs([t for _, t in rows])
    assert len(pairs) >= 10
    of = {r.doc_id: r.class_id for r in near_dedup.classes(small(spark, "/root/testdata/sf0.01")).collect()}
    assert all(of[rows[a][0]] == of[rows[b][0]] for a, b in pairs)


def test_near_classes_on_odd_rows_and_nothing(spark):
    got = near_dedup.classes(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[4].class_size == 2
    assert near_dedup.classes(docs_of(spark, [])).count() == 0


def test_two_classes_under_one_id(spark, data):
    rows = [(1, "one text of a few words about rivers and lakes", "en", "s", 1), (1, "another that tells of trains in the far north", "en", "s", 1), (2, "another that tells of trains in the far north", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()) == sorted({(1, t) for _, t, *_ in rows})
    assert len({r.class_key for r in near_dedup.classes(docs).collect()}) == 2


def test_sample_filter_loses_one_pair_in_ten_thousand_at_most():
    n, p = near_dedup.HASHES, near_dedup.SIMILARITY
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.AGREE)) < 1e-4


def test_samples_agree_as_often_as_texts_are_alike():
    import numpy as np

    token = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weight = np.random.default_rng(1).uniform(1, 9, 400).astype(np.float32)
    other = weight.copy()
    other[:60] /= 3
    want = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    agree = np.mean([(a == b).mean() for a, b in (near_dedup.sample(np.concatenate([near_dedup.mix(token + np.uint64(s))] * 2), np.concatenate([weight, other]), np.array([0, 400])) for s in range(60))])
    assert agree == pytest.approx(want, abs=0.03)


# 3


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"broadcast": 0}, {"broadcast": 0, "hot": 4}])
def test_repeats_equal_the_plain_ones(spark, data, options):
    rows = [(r.doc_id, (r.text or "").encode()) for r in small(spark, data).collect()]
    want = {k: (a, b, c, hashlib.sha256(kept).hexdigest()) for k, (a, b, c, kept) in brute.repeats(sorted(rows)).items()}
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(small(spark, data), **options).collect()} == want


def test_repeats_within_a_text_and_on_odd_rows(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdef ") for _ in range(150))
    rows = [*ODD, (10, "a" * 250, None), (11, passage + "--" + passage, None), (12, "é" + passage[:120], None), (13, passage[:99], None)]
    got = suffix_dedup.digests(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    known = sorted({(i, (t or "").encode()) for i, t, _ in rows if i is not None})
    want = brute.repeats(known)
    for g in got:
        if g.doc_id is not None:
            assert tuple(g)[1:4] == want[g.doc_id][:3]
    kept = {x.doc_id: x for x in suffix_dedup.dedup(docs_of(spark, rows)).collect()}
    assert kept[11].text == passage + "--" and kept[11].removed_spans == [[152, 302]] and kept[10].row == "r"
    assert kept[10].text == "a" and kept[1].text is None
    assert suffix_dedup.digests(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 50}, {"broadcast": 0, "hot": 50}])
def test_texts_that_repeat_themselves_travel_once(spark, options):
    rows = [(1, b"a" * 60_000), (2, b"abc" * 15_000), (3, b"x" + b"a" * 30_000 + b"y"), (4, (b"line of forty bytes that comes and goes\n" * 300)), (5, b"a" * 100), (6, b"bca" * 60)]
    want = {k: (a, b, c, hashlib.sha256(kept).hexdigest()) for k, (a, b, c, kept) in brute.repeats(rows).items()}
    docs = spark.createDataFrame([(k, raw.decode()) for k, raw in rows], "doc_id long, text string")
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(docs, **options).collect()} == want
    data, starts = suffix_dedup.np.frombuffer(b"a" * 60_000, suffix_dedup.np.uint8), suffix_dedup.np.array([0, 60_000])
    assert len(suffix_dedup.Windows(data, starts, joined=True).at) == 4 and len(suffix_dedup.Windows(data, starts).at) == 59_901


def test_suffix_ranks_are_in_byte_order():
    import numpy as np

    r = random.Random(9)
    text = ("".join(r.choice("ab") for _ in range(1500)) + "a" * 400 + "xyz" * 120).encode()
    at = np.arange(len(text) - 100)
    rank = suffix_dedup.sort_suffixes(np.frombuffer(text, np.uint8), at)
    strings = [text[p : p + 100] for p in at]
    first = {}
    for place, s in enumerate(sorted(strings)):
        first.setdefault(s, place)
    assert rank.tolist() == [first[s] for s in strings]


# 4


def test_ids_equal_the_library(spark):
    library, mine = Tokenizer.from_file(VOCABULARY), bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    r = random.Random(1)
    texts = ["", "a" * 700, "the" * 300, "<|endoftext|>x <|endoftext|>", " " * 90, "\n\n  x", "don't WE'LL 123,456 ½ ²", LONG[:3000]]
    texts += ["".join(r.choice("ab thein\n'sé中😀<|endoftext|>0 .  \tre") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want and mine.decode(want) == library.decode(want, skip_special_tokens=False)
    rows = docs_of(spark, ODD)
    for g in bpe.round_trip(rows, VOCABULARY).collect():
        text = next((t for i, t, _ in ODD if i == g.doc_id and g.doc_id is not None), None)
        if g.doc_id is not None:
            want = library.encode(text or "", add_special_tokens=False).ids
            assert g.n_tokens == len(want) and g.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert g.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(rows, VOCABULARY, check=True).where("lossless"), VOCABULARY)
    assert sorted(((x.doc_id or 0), x.text) for x in back.collect()) == sorted(((i or 0), t or "") for i, t, _ in ODD)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(open(catalog.vocabulary("word_bpe_49k.json"), encoding="utf-8").read())


def test_round_trip_of_nothing(spark):
    assert bpe.round_trip(docs_of(spark, []), VOCABULARY).count() == 0 and bpe.decode(bpe.encode(docs_of(spark, []), VOCABULARY), VOCABULARY).count() == 0


# 5


def test_forward_sums_all_segmentations(monkeypatch):
    import numpy as np

    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    p = np.random.default_rng(2).dirichlet(np.ones(len(names) + 1), 2).T
    found = langid.Pieces(names)
    word = "▁ababa"

    def total(rest, lang):
        if not rest:
            return 1.0
        out = sum(p[k, lang] * total(rest[len(x) :], lang) for k, x in enumerate(names) if rest.startswith(x))
        return out + (0 if rest[0] in names else p[-1, lang] * total(rest[1:], lang))

    for short in (langid.SHORT, 2):  # sums, then their logarithms
        monkeypatch.setattr(langid, "SHORT", short)
        _, points = next(found.words([word]))
        got = found.forward(points, np.vstack([p, np.zeros(2)]))[-1, 0]
        assert np.exp(got) == pytest.approx([total(word, 0), total(word, 1)])
        counts = found.expected(points, np.ones(1), np.append(p[:, 0], 0))
        assert sum(counts[k] * len(x) for k, x in enumerate(names)) == pytest.approx(len(word))


def test_whole_texts_equal_the_plain_sums(spark, data):
    docs = small(spark, data)
    model = langid.train(docs, PIECES, F.lit(True))
    names = langid.pieces_of(open(PIECES, "rb").read())
    assert max(map(len, names)) == model.pieces.longest > 10
    texts = [r.text for r in docs.collect()][:60] + ["internationalization " * 3, "ab" * 200, "中文没有空格" * 30 + " x", "a" * 3000, "É", "12", None, "donaudampfschifffahrtsgesellschaft", "x"]
    got = model.predict(texts)
    for text, lang, score in zip(texts, *got, strict=True):
        sums = brute.language_sums(text, {n: k for k, n in enumerate(names)}, model.p, langid.MARK, max(map(len, names)))
        if sums is None:
            assert (lang, score) == ("und", 0.0)
            continue
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        assert lang == model.languages[best] and score == pytest.approx(1 / sum(math.exp(x - sums[best]) for x in sums), rel=1e-6)


def test_languages_of_held_out_documents(spark):
    docs = small(spark, "/root/testdata/sf0.01")
    found = langid.predictions(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98 and all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    got = langid.predictions(docs_of(spark, [*ODD, (8, "123 !?", "en"), (9, "a" * 5000, "en")]), PIECES).collect()
    assert len(got) == len(ODD) + 2 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert {r.lang_pred for r in langid.predictions(docs_of(spark, [(1, "text", None)]), PIECES).collect()} == {"und"}
    assert langid.predictions(docs_of(spark, []), PIECES).count() == 0


# 6


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_contamination_equals_the_plain_search(spark, data, block):
    docs = small(spark, data)
    items = small(spark, data, "benchmark").union(spark.createDataFrame([(900, "the of"), (901, "The"), (902, ""), (903, None), (None, "erth edly"), (900, "word1 item1 word2")], "item_id long, text string"))
    extra = docs_of(spark, ODD).select("doc_id", "text")
    both = docs.select("doc_id", "text").union(extra)
    want = brute.contamination([(r.doc_id, r.text) for r in both.collect()], [(r.item_id, r.text) for r in items.collect()])
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    got = [tuple(r) for r in decontam.report(both, items, block_windows=block).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[-1] for w in want) > 0


def test_a_window_of_very_many_items(spark, monkeypatch):
    """It is split over blocks by the items, searched in steps, and written down between blocks."""
    monkeypatch.setattr(decontam, "WRITTEN", 2)
    monkeypatch.setattr(decontam, "AT_ONCE", 50)
    passage = " ".join(f"common{k}" for k in range(12))
    items = [(k, passage if k % 2 else f"{passage} own{k}") for k in range(300)] + [(1000, "common1 common2 common3"), (1001, "common1")]
    docs = [(1, f"before {passage} own7 and {passage}"), (2, "common1 " * 500), (3, "nothing"), (4, passage.upper()), (5, None)]
    want = brute.contamination(docs, items)
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 1, "w") for x in items], "item_id long, text string, item int, window string"), block_windows=200)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_hashes_are_not_enough():
    import numpy as np

    block = decontam.Block(["a"], ["one two"])
    block.order({})
    data = np.frombuffer(b"one two one tvo", np.uint8)
    word, first, text, begin, end = decontam.spelled(data, np.array([0, len(data)]))
    word[3] = word[1]  # a clash
    assert block.hits(word, first, text, begin, end)[1].tolist() == [0]


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.report(docs_of(spark, ODD), none).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
    assert decontam.report(docs_of(spark, []), none).count() == 0


# 7


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head &amp; more</h1><p><b>First&nbsp;para<br>
goes   on.<br><p>Short.</p><p class="ad">buy<p>Second paragraph with quite some words in it, and more.</p><form><input>Search</form></article>
<aside>Aside</aside><div id="comments"><p>First!</p></div><footer>End</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & more\n\nFirst para goes on.\n\nShort.\n\nSecond paragraph with quite some words in it, and more."
    assert [htmltext.main_text(x) for x in (None, "", "<p></p>", "plain &lt; text", "<p>a<p>b")] == ["", "", "", "plain < text", "a\n\nb"]
    menu = "".join(f"<a href='/{k}'>m{k}</a>" for k in range(30))
    page = f"<body><div>{menu}</div><div><p>{'A long sentence of the page. ' * 20}</p><p>Tiny.</p></div></body>"
    assert htmltext.main_text(page).endswith("\n\nTiny.") and "m3" not in htmltext.main_text(page)


TEXT = "A long sentence of the page that tells something. " * 3


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><article><p>{}</p></article></div>", "<main class='with-comments'><p>{}</p></main>", "<article class='related-to-x social'><p>{}</p></article>",
    "<div class='right-sidebar'><main><p>{}</p></main></div>", "<div class='search-results'><p>{}</p></div>", "<div id='discussion'><main><article><p>{}</p></article></main></div>",
])
def test_marks_leave_content_wrappers(page):
    assert htmltext.main_text(f"<body>{page.format(TEXT)}</body>") == TEXT.strip()


def test_marks_leave_headlines_and_take_the_rest():
    assert htmltext.main_text(f"<article><div class='entry-header'><h1>Head</h1></div><p>{TEXT}</p><div class='search-results'><p>Found</p></div></article>") == f"Head\n\n{TEXT.strip()}\n\nFound"
    out = "".join(f"<div class='{c}'><p>{TEXT}</p></div>" for c in ("site-footer", "sidebar", "sidebar--left", "ad-container", "related-posts", "page__sidebar", "widget-2", "cookie-notice", "nav-links"))
    said = f"<div id='comments'><article><p>{TEXT}</p></article></div><article class='comment'><p>{TEXT}</p></article>"
    assert htmltext.main_text(f"<body>{out}<article><p>Body. {TEXT}</p></article>{said}</body>") == f"Body. {TEXT}".strip()


MORE = "Another long sentence of the page, which goes on for a while and then ends. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        ("<form id=aspnetForm><input type=hidden><div class=c><p>{0}</p><p>{1}</p></div><select><option>No</select></form>", "{0}\n\n{1}"),
        ("<form id=aspnetForm><div>Search</div><article><p>{0}</p></article><p>short</p></form>", "{0}"),
        ("<article><p>{0}</p><p>{1}</p></article><form><p>{1}</p><p>{0} {1} {0} {1} {0} {1}</p></form>", "{0}\n\n{1}"),
        ("<div class=c><p>{0}</p><form><label>Your name</label><p>{1}</p></form></div>", "{0}"),
        ("<form><label>Name</label> <label>Town</label><button>Go</button></form>", ""),
        ("<div class=c><header><h1>Big Title</h1></header><p>{0}</p><h2>Part</h2><p>{1}</p></div>", "Big Title\n\n{0}\n\nPart\n\n{1}"),
        ("<div class=c><header><h1>Site</h1></header><h1>Big Title</h1><p>{0}</p><p>{1}</p></div>", "Big Title\n\n{0}\n\n{1}"),
        ("<header><h1>Site</h1></header><div class=c><p>{0}</p><p>{1}</p></div>", "{0}\n\n{1}"),
        ("<header><h1>Site</h1></header><p>{0}</p><p>{1}</p>", "{0}\n\n{1}"),
        ("<article><span class=ad>buy now<p>{0}</p><p>{1}</p></article>", "{0}\n\n{1}"),
        ("<article><p><span class=ad>buy now</p><p>{0}</p><p>{1}</p></article>", "{0}\n\n{1}"),
        ("<article><a class=promo><div>buy now</div><p>{1}</p></a><p>{0}</p></article>", "{0}"),
        ("<article><p>{0} <span hidden>no</span>and <b class=ad>buy</b>on.</p></article>", "{0}\n\nand\n\non."),
        ("<div class=ad>Buy<div class=c><p>{0}</p><p>{1}</p></div>", "{0}\n\n{1}"),
        ("<div class='cookie-notice'><p>{0}</p></div>", ""),
        ("<div class=c><p>{0}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{1}</p></div>", "{0}\n\nOne\n\nTwo\n\nThree\n\n{1}"),
    ],
)
def test_vetoes_yield_to_content(page, want):
    got = htmltext.main_text(f"<html><body>{page.format(TEXT.strip(), MORE.strip())}</body></html>")
    assert got == want.format(TEXT.strip(), MORE.strip())


def test_regions_equal_the_plain_ones():
    r = random.Random(11)

    def block(depth):
        """A random container: (children, or lines of text and link text)."""
        if depth == 0 or r.random() < 0.3:
            link = r.random() < 0.4
            return [("a" if link else "p", " ".join("word" * r.randint(1, 3) for _ in range(r.randint(1, 3) if link else r.choice([1, 3, 40, 90])))) for _ in range(r.randint(1, 8))]
        return [block(depth - 1) for _ in range(r.randint(1, 4))]

    def markup(b):
        if isinstance(b, tuple):
            return f"<p><a href='/'>{b[1]}</a></p>" if b[0] == "a" else f"<p>{b[1]}</p>"
        return "<div>" + "".join(map(markup, b)) + "</div>"

    both = 0
    for _ in range(300):
        page = [block(3) for _ in range(2)]
        want = brute.main_lines(page, htmltext.SIGMA, htmltext.HELD, htmltext.MENU)
        assert htmltext.main_text("<body>" + "".join(map(markup, page)) + "</body>") == "\n\n".join(want)
        both += 0 < len(want) < sum(1 for _ in brute.leaves(page))
    assert both > 100


def test_density_chooses_without_names():
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(12)) + "</ul>"
    assert htmltext.main_text(f"<body><div id=wrap>{menu}<h1>Head</h1><p>{TEXT}</p><ul><li>one</li><li>two</li></ul></div></body>") == f"Head\n\n{TEXT.strip()}\n\none\n\ntwo"
    items = "<article><ul>" + "".join(f"<li><a href='/{k}'>it {k}</a></li>" for k in range(3)) + "</ul></article>"
    assert htmltext.main_text(f"<main><article><p>{TEXT}</p></article>{items}</main>").endswith("it 0\n\nit 1\n\nit 2")
    assert htmltext.main_text(f"<body><div>{menu}</div><article><h1 class='post-header'>Head</h1><p id='social-history'>{TEXT}</p></article></body>") == f"Head\n\n{TEXT.strip()}"
    # Two regions of the same text: both stay.
    assert htmltext.main_text(f"<body><div><p>{TEXT}</p></div><div><p>{TEXT}</p></div></body>") == f"{TEXT.strip()}\n\n{TEXT.strip()}"


def test_pages_inside_a_form(spark):
    """A form around everything in the body changes no page."""
    for r in small(spark, "/root/testdata/sf0.01", "pages").collect():
        assert htmltext.main_text(r.html.replace("<body>", "<body><form id='aspnetForm'>").replace("</body>", "</form></body>")) == htmltext.main_text(r.html)


def test_pages_without_article_tags(spark):
    import re

    kept = extra = total = 0
    for r in small(spark, "/root/testdata/sf0.01", "pages").collect():
        want = htmltext.main_text(re.search("<article>.*</article>", r.html, re.S).group()).split("\n\n")
        got = htmltext.main_text(r.html.replace("article>", "div>")).split("\n\n")
        total += sum(map(len, want))
        kept += sum(len(x) for x in want if x in got)
        extra += sum(len(x) for x in got if x not in want)
    assert kept >= 0.95 * total and extra <= 0.05 * total


def test_pages(spark, data):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + LONG)]
    clash = spark.createDataFrame([(*x, 7, "t", 5) for x in rows], "page_id long, url string, html string, n_chars long, text string, k int")
    assert sorted(map(str, htmltext.extract(clash).collect())) == sorted(map(str, htmltext.extract(clash.select("page_id", "url", "html")).collect()))
    assert htmltext.extract(clash.limit(0)).count() == 0
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id == 3} == {len(LONG)}
    assert all(r.n_chars > 0 for r in htmltext.extract(small(spark, data, "pages")).collect())


# 8


def run_grammar(labels):
    rules, out = toxicity.grammar(), []
    state = rules.start
    for label in (*labels.split(), "end"):
        state, said = rules.step(state, label)
        out.append(said)
    assert state == rules.start
    return [x for x in out if x in toxicity.KINDS]


@pytest.mark.parametrize(
    "labels, kinds",
    [("other insult", "loose"), ("insult", "targeted"), ("insult insult", "targeted"), ("target other insult", "targeted"), ("insult other target", "targeted"), ("insult other", "loose"), ("negation other insult", "negated"), ("negation other other other insult", "loose"), ("report other insult", "reported"),
     ("quote insult quote insult", "reported loose"), ("agent threat target", "threat"), ("threat other target", "threat"), ("agent target threat", "threat"), ("target threat", ""), ("threat", ""), ("negation threat target", "softened"), ("report threat target", "softened"), ("target report insult", "reported"), ("target insult other insult", "targeted targeted"), ("other insult other insult", "piled"), ("insult negation insult other insult", "negated negated loose"), ("insult other insult target other insult", "targeted targeted")],
)
def test_clause_grammar(labels, kinds):
    assert run_grammar(labels) == kinds.split()


def test_matches_equal_a_plain_state_machine():
    r = random.Random(4)
    lexicon = toxicity.Lexicon({"^moro": 3.0, "=zzz": 1.5})
    words = "idiot Moronic zzz you ICH kill not said the of tree idiot's don't idiotas töten dich é中 “ \" , . ! 。 ; \n".split(" ")
    texts = [r.choice(["", " "]).join(r.choice(words) + r.choice([" ", " ", ""]) for _ in range(r.randint(0, 25))) for _ in range(600)] + ["", "Idiot.", "x" * 2000 + " you idiot"]
    import numpy as np
    import pyarrow as pa

    got = lexicon.features(pa.array([*texts, None]))
    for text, row in zip([*texts, ""], got, strict=True):
        want = brute.toxic_matches(text, lexicon.arcs, lexicon.fixed, toxicity.KINDS, toxicity.FIXED_WEIGHT, toxicity.NEGATED_WORDS)
        assert row == pytest.approx(np.log1p(want)), text


def test_clauses_not_words():
    lexicon = toxicity.Lexicon({})

    def score(text):
        import pyarrow as pa

        return 1 / (1 + math.exp(-(toxicity.PRIOR[0] + lexicon.features(pa.array([text]))[0] @ toxicity.PRIOR[1:])))

    for text in ("Idiot.", "You idiot", "idiots like you: idiot you", "du bist ein idiot。ja", "you are such an idiot's idiot", "I will kill you.", "ich werde dich töten", "he is an idiot"):
        assert score(text) >= 0.7, text
    for text in ("The word idiot has Greek roots.", "kill the process", "you are not an idiot", "she said “you idiot”", "we shoot photos", ""):
        assert score(text) < 0.1, text


def catalog_fold(i):
    from tidemark.llm.common import fold

    return fold(i, 3)


def test_held_out_toxicity(spark):
    """Of the toxic rows that use any insult or threat (the rest are labelled at random); of all held-out clean ones."""
    d = "/root/testdata/sf0.1"
    labels = small(spark, d, "labels")
    usual = toxicity.words_of(catalog.vocabulary("piece_bpe_32k.model"), catalog.vocabulary("word_bpe_49k.json"))
    rows = toxicity.scores(small(spark, d), labels, background=usual).join(labels, "doc_id").where("held_out").join(small(spark, d).select("doc_id", "text"), "doc_id").collect()
    said = [r for r in rows if any(w in (r.text or "").lower() for w in toxicity.INSULTS + toxicity.THREATS)]
    clean, toxic, every = [r for r in rows if not r.toxic], [r for r in said if r.toxic], [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in every) >= 0.75 * len(every)


def test_trained_grammar_matches_clauses_not_words(spark):
    """The model of sf0.1's labels: a word by itself, ordinary words with the beginnings of insults, and threats, of which the labels say nothing."""
    import pyarrow as pa

    d = "/root/testdata/sf0.1"
    usual = toxicity.words_of(catalog.vocabulary("piece_bpe_32k.model"), catalog.vocabulary("word_bpe_49k.json"))
    lexicon, beta = toxicity.train(small(spark, d), small(spark, d, "labels"), catalog_fold(F.col("i")) != 1, background=usual)
    assert beta[1 + toxicity.KINDS.index("loose")] == 0
    assert all(len(a) > 5 and not any(w.startswith(a[1:]) for w in usual) for a in lexicon.arcs if a[0] == "^")

    def score(text):
        return 1 / (1 + math.exp(-(beta[0] + lexicon.features(pa.array([text]))[0] @ beta[1:])))

    for text in ("The word idiot has Greek roots.", "The word idiot is old. The word moron is young.", "We discuss the morning traffic report.", "More training on the distant path.", "Worthington and Patterson travel to Morocco.", "She said “you idiot”.", "You are not an idiot.", "It was an idiot mistake to make on a Monday.", ""):
        assert score(text) < 0.5, text
    for text in ("I will kill you.", "You are a stupid idiot.", "Idiot!", "What an idiot, that clown over there.", "That idiot is late. And that moron by the door is late as well."):
        assert score(text) >= 0.7, text


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs_of(spark, [*ODD, (20, "You are a stupid idiot, you clown.", "en")]), none).collect()
    assert len(got) == len(ODD) + 1
    assert {r.predicted for r in got if r.doc_id == 20} == {1} and {r.predicted for r in got if r.doc_id != 20} == {0}
    clash = none.selectExpr("*", "'x' AS text", "1 AS y", "2 AS t", "3 AS i")
    assert toxicity.scores(docs_of(spark, []), clash).count() == 0 and toxicity.scores(docs_of(spark, ODD), clash.limit(0)).count() == len(ODD)


# 9


def test_chat_round_trip(spark):
    odd = ["a", "", None, "\\", "\\l", "</turn>\n", "<more>", "### user:\n", "\\### Assistant: </turn> ok", "x\ny", "\\\\b<"]
    rows = [(c, t, role, text) for c, (role, text) in enumerate(itertools.product(["assistant", "user", None, "a:\nb", "<#\\"], odd)) for t in range(2)]
    rows += [(500, 1, "assistant", "one"), (500, 1, "assistant", "two"), (500, 0, "user", "u"), (500, None, "user", "first"), (500, 2, "assistant", "two"), (None, 0, "assistant", "n"), (500, 3, "user", "u"), (500, 3, "user", "u")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id int, turn int, role string, text string, a int, formatted string")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = chatformat.format_conversations(df).withColumn("turns", chatformat.read_back(F.col("formatted"))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    told = {r.conv_id: r for r in chatformat.digests(df).collect()}
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (told[c].loss_chars, told[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chatformat.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = catalog.queries()[name](spark, data)
    result = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in result.description]
    want = [tuple(row[names.index(c)] for c in got.columns) for row in result.fetchall()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


# 10


def test_fingerprints(spark, data):
    docs = small(spark, data)
    got = {r.doc_id: r for r in imatch.digests(docs).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for k, (i, text) in enumerate(rows):
        n, after = len(text) // 4, rows[(k + 1) % len(rows)]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + after[1][:n]).encode()).hexdigest()
        if text == after[1]:
            assert got[i].near_next == 1.0
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    near = [r.near_edited for r in got.values()]
    far = [r.near_next for r in got.values()]
    assert sum(near) / len(near) > 0.4 and sum(far) / len(far) < 0.1 and all(0 <= x <= 1 for x in near + far)


@pytest.mark.parametrize("per_range", [imatch.RANGE, 7])
def test_fingerprints_equal_the_plain_ones(spark, data, per_range):
    rows = sorted((r.doc_id, r.text or "") for r in small(spark, data).collect())
    rows += [(10**6, "Tiny one"), (10**6 + 1, "a " + LONG[:40]), (10**6 + 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edits = [(text[: len(text) - len(text) // 4] + rows[(k + 1) % len(rows)][1][: len(text) // 4]) for k, (_, text) in enumerate(rows)]
    prints, of_edits = brute.fingerprints([t for _, t in rows], [t for _, t in rows], imatch), brute.fingerprints([t for _, t in rows], edits, imatch)
    got = {r.doc_id: r for r in imatch.digests(docs, per_range=per_range).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[k], of_edits[k])
        assert got[i].near_edited == pytest.approx(brute.likeness(prints[k], of_edits[k], imatch))
        assert got[i].near_next == pytest.approx(brute.likeness(prints[k], prints[(k + 1) % len(rows)], imatch))


def test_fingerprints_of_odd_rows(spark):
    got = imatch.digests(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    assert imatch.digests(docs_of(spark, [(1, "alone here", None)])).first().near_next == 1.0
    assert imatch.digests(docs_of(spark, [])).count() == 0


def test_likeness(spark):
    row = spark.createDataFrame([("00aaaaaaaa.01bbbbbbbb", "00aaaaaaaa.01cccccccc.02dddddddd")], "a string, b string")
    assert row.select(imatch.likeness(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 3)


# the pipeline


def test_pipeline_stages(spark, data, tmp_path):
    docs, kept = small(spark, data), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((name, docs, after))
        docs = after
    assert [n for n, _, _ in kept] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    for _, _, after in kept[:-1]:
        assert after.columns == small(spark, data).columns
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    _, before, after = kept[1]
    classes = brute.near_classes([t for _, t in rows(before)])
    assert [i for i, _ in rows(after)] == [i for k, (i, _) in enumerate(rows(before)) if classes[k] == k]
    _, before, after = kept[2]
    want = brute.repeats([(i, t.encode()) for i, t in rows(before)])
    assert rows(after) == [(i, want[i][3].decode("utf-8", "ignore")) for i, _ in rows(before)]
    _, before, after = kept[3]
    items = [(r.item_id, r.text) for r in small(spark, data, "benchmark").collect()]
    assert [i for i, _ in rows(after)] == [w[0] for w in brute.contamination(rows(before), items) if not w[-1]]
    library = Tokenizer.from_file(VOCABULARY)
    texts = dict(rows(after))
    for r in kept[4][2].collect():
        assert r.lossless and r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_pipeline_on_odd_rows_and_nothing(spark, data):
    for rows in (ODD, []):
        docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.count() <= len(rows)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_ctw_tables_take_the_place_of_their_rows():
    import numpy as np

    keys, values = np.arange(1, 50, dtype=np.uint64), np.arange(49.0)
    heads = {ctw.GRAM: (keys, values), ctw.WORD: (keys[:3], values[:3])}
    grams, words = ctw.tables(heads)
    assert heads == {ctw.GRAM: grams, ctw.WORD: words} and ctw.tables(heads) == [grams, words]
    assert list(grams.get(keys)) == list(values) and np.isnan(words.get(keys[3:])).all()
