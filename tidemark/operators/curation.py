"""Paragraphs and bounded chunks, budgets, dictionary clustering, JSON answers, mapped documents, composite pipelines (W2, W4, W6, W7)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import clean_text, initials, squeeze
from tidemark.functions.vectors import cosine, l2_normalize
from tidemark.operators.mentions import canonical, clusters, fuzzy_pairs, suppress_overlaps
from tidemark.session import cut

#: Line beginnings that end a paragraph (fixed values).
STRUCTURE = ("#", "*", "-", "1.", ">")
#: Bytes of chunks that go back to Spark at once.
PIECE = 1 << 20


def join_paragraphs(text: str | None) -> str:
    """Compatibility letters, lines of a paragraph joined (hyphens closed), tables and lists as they are, blank lines squeezed."""
    out: list[str] = []
    held = ""  # a paragraph whose sentence goes on
    blank_before = in_table = False

    def put(line: str) -> None:
        line = re.sub(r" {2,}", " ", line)
        if line or not out or out[-1]:
            out.append(line)

    for raw in unicodedata.normalize("NFKC", text or "").split("\n"):
        line = raw.strip()
        if not line:
            in_table = False
            blank_before = True
            if not held:
                put("")
            continue
        structural = line.startswith((*STRUCTURE, "|", "[", "**"))
        if held:
            if not structural:
                line = held[:-1] + line if held.endswith("-") else f"{held} {line}"
            else:
                put(held)
                if blank_before:
                    put("")
            held = ""
        blank_before = False
        in_table = in_table or "|" in line
        if in_table or line.startswith(STRUCTURE) or line.endswith((".", "?", "!")):
            put(line)
        else:
            held = line
    if held:
        put(held)
    return "\n".join(out).strip()


def with_paragraphs(df: DataFrame, text: str = "text", to: str = "paragraphs") -> DataFrame:
    @F.pandas_udf(df.schema[text].dataType)
    def joined(texts: pd.Series) -> pd.Series:
        return texts.map(join_paragraphs)

    return df.withColumn(to, joined(text))


def split_point(text: str, target: int, reach: int = 200) -> int:
    """The best end of a chunk near target: before a heading, a note, after a blank line, at a table's border, after a line, else target."""
    low = max(0, target - reach)
    for marks, skip in ((("\n**",), 1), (("\n#",), 1), (("\n_Note",), 1), (("\nNote:",), 1), (("\n\n",), 2)):
        at = max(text.rfind(m, low, target) for m in marks)
        if at >= 0:
            return at + skip
    line_start = text.rfind("\n", 0, target) + 1
    line_end = text.find("\n", target)
    if "|" in text[line_start : line_end if line_end >= 0 else len(text)]:
        begin = line_start
        while begin > 0 and "|" in text[text.rfind("\n", 0, begin - 1) + 1 : begin - 1]:
            begin = text.rfind("\n", 0, begin - 1) + 1
        if begin > low:
            return begin
    at = text.rfind("\n", low, target)
    return at + 1 if at >= 0 else target


def chunks(text: str | None, size: int = 200, overlap: int = 50) -> list[tuple[int, str]]:
    """Overlapping chunks of at most size tokens as (first character, text); ends snap back to boundaries, and no token is left out between chunks."""
    text = text or ""
    tokens = [m.span() for m in re.finditer(r"\S+", text)]
    if len(tokens) <= size:
        return [(0, text)]
    out, first = [], 0
    while first < len(tokens):
        last = min(first + size, len(tokens))
        begin, end = tokens[first][0], tokens[last - 1][1]
        if last < len(tokens):
            snapped = split_point(text, end)
            end = snapped if snapped > begin else end
        out.append((begin, text[begin:end]))
        if last == len(tokens):
            break
        # On by size - overlap tokens at least, but never past the first token that this chunk doesn't hold.
        after = next((k for k in range(first + 1, last) if tokens[k][0] >= end), last)
        first = min(max(first + size - overlap, after - overlap), after)
    return out


def with_chunks(df: DataFrame, text: str = "text", size: int = 200, overlap: int = 50) -> DataFrame:
    """One row for each chunk, with chunk, offset, chunk_text and the columns of df but for the text, which would come again with each of its chunks.

    A task holds one text's words and PIECE bytes of chunks at once.
    """
    others = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in others]).add("chunk", "integer").add("offset", "integer").add("chunk_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = batch.column(batch.num_columns - 1), batch.select(others)
            rows: list[int] = []
            made: list[tuple[int, int, str]] = []
            held = 0

            def packed(rows=rows, made=made, rest=rest) -> pa.RecordBatch:
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
                out = pa.RecordBatch.from_arrays([*rest.take(pa.array(rows, pa.int64())).columns, *columns], [*others, "chunk", "offset", "chunk_text"])
                rows.clear()
                made.clear()
                return out

            for i in range(batch.num_rows):
                for k, (offset, part) in enumerate(chunks(texts[i].as_py(), size, overlap)):
                    rows.append(i)
                    made.append((k, offset, part))
                    held += len(part) + 100
                    if held >= PIECE:
                        yield packed()
                        held = 0
            if rows:
                yield packed()

    return df.select(*others, text).mapInArrow(run, schema)


def append_notes(chunk: Column, notes: Column) -> Column:
    """A chunk with the notes that its [n] marks name, in order."""
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(chunk, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("bigint"))))
    found = F.filter(F.transform(refs, lambda n: F.when(F.map_contains_key(notes, n), F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.element_at(notes, n)))), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, F.concat(chunk, F.lit("\n\n"), F.array_join(found, "\n"))).otherwise(chunk)


def merge_spans(df: DataFrame, keys: list[str], name: str, start: str, end: str, confidence: str, order: str) -> DataFrame:
    """Mentions of overlapping chunks: by text the first span with the highest confidence."""
    first = F.min_by(F.struct(start, end), order).alias("_s")
    return df.groupBy(*keys, name).agg(first, F.max(confidence).alias(confidence), F.count("*").alias("n")).select(*keys, name, f"_s.{start}", f"_s.{end}", confidence, "n")


def best_at_span(df: DataFrame, keys: list[str], specificity: str, confidence: str, order: str) -> DataFrame:
    """Of mentions with equal keys the most specific, then the most confident, then the first."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(specificity).desc_nulls_last(), F.col(confidence).desc_nulls_last(), order)))
    return ranked.where("_k = 1").drop("_k")


def fair_shares(lengths: Column, budget: int | Column) -> Column:
    """Max-min fair whole shares of a budget, in the order of lengths: the shortest are served first, the rest share what is left."""
    indexed = F.array_sort(F.transform(lengths, lambda x, i: F.struct(x.cast("int").alias("x"), i.alias("i"))))
    n = F.size(lengths)
    start = F.struct(F.lit(budget).cast("int").alias("left"), F.lit(0).alias("k"), F.array().cast("array<struct<i:int,s:int>>").alias("out"))

    def give(acc: Column, item: Column) -> Column:
        share = F.least(item["x"], F.floor(acc["left"] / (n - acc["k"])).cast("int"))
        return F.struct((acc["left"] - share).alias("left"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], F.array(F.struct(item["i"].alias("i"), share.alias("s")))).alias("out"))

    return F.transform(F.array_sort(F.aggregate(indexed, start, give, lambda acc: acc["out"])), lambda x: x["s"])


def token_budget_parts(df: DataFrame, keys: list[str], item: str, tokens: str, most: int = 2048) -> DataFrame:
    """Split each group into parts of at most so many tokens, in the order of items; a single larger item is a part of its own."""
    listed = F.array_sort(F.collect_list(F.struct(item, F.col(tokens).cast("int").alias("t"))))
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("part"), F.array().cast("array<int>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        fresh = (acc["part"] < 0) | (acc["sum"] + x["t"] > most)
        part = acc["part"] + fresh.cast("int")
        return F.struct(F.when(fresh, x["t"]).otherwise(acc["sum"] + x["t"]).alias("sum"), part.alias("part"), F.concat(acc["out"], F.array(part)).alias("out"))

    grouped = df.groupBy(*keys).agg(listed.alias("x"))
    parts = F.aggregate("x", start, place, lambda acc: acc["out"])
    return grouped.withColumn("z", F.arrays_zip(F.col("x"), parts.alias("p"))).select(*keys, F.explode("z").alias("z")).select(*keys, F.col(f"z.x.{item}").alias(item), F.col("z.x.t").alias("tokens"), F.col("z.p").alias("part"))


def smart_batches(df: DataFrame, block: str, item: str, size: str, target: int = 300, small: int = 10) -> DataFrame:
    """Batches of a block's clusters by size: small ones are gathered until target, each large one is a batch of its own."""
    order = Window.partitionBy(block, F.col(size) <= small).orderBy(F.col(size).desc(), item)
    running = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tag = F.when(F.col(size) <= small, F.concat(F.lit("s"), F.floor(F.coalesce(running, F.lit(0)) / target))).otherwise(F.concat(F.lit("l"), F.row_number().over(order)))
    return df.withColumn("batch", tag)


def outer_json(text: Column, opening: str = "[", closing: str = "]") -> Column:
    """What stands between the first opening and the last closing bracket, both included; null if there are none."""
    return F.nullif(F.regexp_extract(text, "(?s)" + re.escape(opening) + ".*" + re.escape(closing), 0), F.lit(""))


def balanced_json(text: str | None) -> str | None:
    """The first JSON object in a text, fenced or not."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    decoder = json.JSONDecoder()
    for k in (m.start() for m in re.finditer(r"\{", body)):
        try:
            value, _ = decoder.raw_decode(body[k:])
            return json.dumps(value)
        except ValueError:
            continue
    return None


def listed_acronyms(field: Column) -> Column:
    """An acronym field as a list: JSON, Python notation, or split at ; , | and /."""
    quoted = F.translate(field, "'", '"')
    split = F.filter(F.transform(F.split(field, r"[;,|/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(field, "array<string>"), F.from_json(quoted, "array<string>"), split)


def plausible_acronym(name: Column, found: Column) -> Column:
    """The acronym that equals the name's initials, else the one in capitals that shares most letters by place with them, else the first."""
    want = initials(name)
    scored = F.transform(found, lambda a, i: F.struct(
        F.when(F.upper(a) == want, 0).when(a.rlike("^[A-Z0-9]{2,12}$"), 1).otherwise(2).alias("k"),
        (-F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a))), lambda p: F.substring(a, p, F.lit(1)) == F.substring(want, p, F.lit(1))))).alias("s"), F.abs(F.length(a) - F.length(want)).alias("d"), i.alias("i"), a.alias("a")))
    return F.array_min(scored)["a"]


def is_subsequence_acronym(short: Column, name: Column) -> Column:
    """Letters of the acronym occur in the name in order."""
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.split(short, ""), ".*"))
    return short.rlike("^[A-Za-z0-9]+$") & F.rlike(name, pattern)


def title_case(name: Column) -> Column:
    """Words with a capital, acronyms as they are, small words low except at the beginning."""
    small = "of the and for in on at to by a an".split()
    return F.array_join(F.transform(F.split(squeeze(name), " "), lambda w, i: F.when(w.rlike("^[A-Z0-9]{2,6}$"), w).when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.initcap(w))), " ")


def met_forms(texts: DataFrame, words: Column, forms: DataFrame, form_words: Column) -> DataFrame:
    """Rows of texts (_k) and forms (all columns) whose first two words, or only word, stand side by side in the text; words: arrays.

    What is joined are names of texts and pairs of words, never texts; a form without words meets every text.
    """
    two = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))).otherwise(F.array().cast("array<string>"))
    each = texts.select("_k", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words, two))).alias("_w"))
    return each.join(forms.withColumn("_w", F.array_join(F.slice(form_words, 1, 2), " ")), "_w").drop("_w")


def detect_form(df: DataFrame, text: str, forms: DataFrame) -> DataFrame:
    """The first of forms (form, name, ord) by ord whose words stand in a text: a join on the forms' first two words, then the whole form.

    Each distinct text is searched once, named by its digest, and every row with it gets its answer. A null text has none, and forms without words are in none.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    texts = df.select(F.md5(text).alias("_k"), plain(F.col(text)).alias("_p")).where("_k IS NOT NULL").dropDuplicates(["_k"])
    named = forms.select(plain(F.col("form")).alias("form"), "name", "ord").where("form <> ''")
    met = met_forms(texts, F.split("_p", " "), named, F.split("form", " "))
    long = met.where(F.size(F.split("form", " ")) > 2).join(texts, "_k").where(F.concat(F.lit(" "), "_p", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("form"), F.lit(" ")))).select(met.columns)
    found = met.where(F.size(F.split("form", " ")) <= 2).unionByName(long).groupBy("_k").agg(F.min_by("name", "ord").alias("detected"))
    return df.withColumn("_k", F.md5(text)).join(found, "_k", "left").drop("_k")


def heuristic_queries(title: Column, place: Column, years: Column) -> Column:
    """Offline queries for a record: by title, by title and place, by title and year; those whose part is missing are left out."""
    made = F.array(title, F.concat_ws(" in ", title, F.nullif(place, F.lit(""))), F.concat_ws(" ", title, F.nullif(years, F.lit(""))))
    return F.array_distinct(F.filter(made, lambda q: q.isNotNull() & (q != "")))


def heuristic_judgement(query: Column, record: Column) -> Column:
    """0 to 3 by the share of the query's distinct words that the record has, halves to even."""
    of = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    share = F.size(F.array_intersect(of(query), of(record))) / F.greatest(F.size(of(query)), F.lit(1))
    return F.least(F.lit(3), F.rint(4 * share).cast("int"))


def judged_at(rankings: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """Mean over queries of the mean judgement of their first k results; queries without judgements are left out."""
    scored = rankings.where(F.col("rank") <= k).join(judgements, ["query_id", "id"])
    return scored.groupBy("query_id").agg(F.avg("judgement").alias("m")).agg(F.count("*").alias("n_queries"), F.round(F.avg("m"), 6).alias("judged"))


def sanitized(box: Column) -> Column:
    """A box (x1, y1, x2, y2 as array): divided by 1000 if it is in pixels (any value over 1.5), clamped to 0..1, corners in order; null if it has no area."""
    scaled = F.transform(box, lambda x: F.when(F.array_max(box) > 1.5, x / 1000).otherwise(x))
    c = F.transform(scaled, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))
    ordered = F.array(F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3]))
    return F.when((F.size(box) == 4) & (ordered[0] < ordered[2]) & (ordered[1] < ordered[3]), ordered)


def merge_pages(a: DataFrame, b: DataFrame, key: str, objects: str) -> DataFrame:
    """Pages of both, a's objects before b's."""
    other = b.select(key, F.col(objects).alias("_o"))
    empty = F.filter(F.coalesce(objects, "_o"), lambda x: F.lit(False))
    return a.select(key, objects).join(other, key, "full_outer").select(key, F.concat(F.coalesce(objects, empty), F.coalesce("_o", empty)).alias(objects))


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column whether it has one value only in all rows."""
    return df.agg(*[(F.count_distinct(c) <= 1).alias(c) for c in columns])


# Dictionaries of variables


def ward_merges(vectors: np.ndarray) -> list[tuple[float, int, int]]:
    """All of Ward's merges, cheapest first, as (cost, a member, a member): chains of nearest neighbours, in memory of the vectors' size."""
    n = len(vectors)
    centre, size, alive, merges, chain = vectors.astype(float).copy(), np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        cost = ((centre - centre[a]) ** 2).sum(1) * size * size[a] / (size + size[a])
        cost[~alive] = cost[a] = np.inf
        b = int(np.argmin(cost))
        if len(chain) == 1 or cost[b] < cost[chain[-2]]:
            chain.append(b)
            continue
        b, chain = chain[-2], chain[:-2]
        merges.append((float(cost[b]), min(a, b), max(a, b)))
        a, b = min(a, b), max(a, b)
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[0])


def cut_tree(merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """The clusters when k are left."""
    parent = list(range(len(merges) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for _, a, b in merges[: max(0, len(parent) - k)]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.unique([find(x) for x in range(len(parent))], return_inverse=True)[1]


def ward(vectors: np.ndarray, k: int) -> np.ndarray:
    """Ward's clusters of a dictionary's variables when k are left."""
    return cut_tree(ward_merges(vectors), k)


def silhouettes(vectors: np.ndarray, labels: list[np.ndarray]) -> list[float]:
    """Mean silhouettes of clusterings; members alone count 0. Distances are held for a few rows at a time."""
    n = len(vectors)
    groups = [np.eye(label.max() + 1)[label] for label in labels]
    total, step = np.zeros(len(labels)), max(1, 4_000_000 // max(1, vectors.size))
    for k in range(0, n, step):
        d = np.sqrt(((vectors[k : k + step, None] - vectors[None]) ** 2).sum(2))
        rows = np.arange(len(d))
        for j, (label, group) in enumerate(zip(labels, groups, strict=True)):
            sums, sizes, own = d @ group, group.sum(0), label[k : k + step]
            a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
            mean = sums / sizes
            mean[rows, own] = np.inf
            b = mean.min(1)
            total[j] += np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).sum()
    return [float(t / n) for t in total]


def silhouette(vectors: np.ndarray, label: np.ndarray) -> float:
    return silhouettes(vectors, [label])[0]


def group_variables(df: DataFrame, block: str, item: str, vec: str, least: int = 3, most: int = 30) -> DataFrame:
    """Ward clusters of each block's items, least to most of them, as many as give the best mean silhouette. A block is one data dictionary.

    Below six items, or where the range has one number only, there are sqrt(n / 2) of them, three at least, as far as the range goes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(item)
        x = np.array(frame[vec].tolist(), float)
        high = min(most, len(x) - 1)
        low = max(2, min(least, high))
        merges = ward_merges(x)
        if len(x) < 6 or low >= high:
            label = cut_tree(merges, max(1, min(len(x), max(low, min(high, max(3, int((len(x) / 2) ** 0.5)))))))
        else:
            labels = [cut_tree(merges, k) for k in range(low, high + 1)]
            label = labels[int(np.argmax(silhouettes(x, labels)))]
        return frame[[block, item]].assign(cluster=label.astype(np.int32))

    return df.select(block, item, vec).groupBy(block).applyInPandas(run, f"`{block}` {kinds[block]}, `{item}` {kinds[item]}, cluster int")


def representatives(df: DataFrame, cluster: str, item: str, vec: str) -> DataFrame:
    """By cluster the item nearest to the cluster's mean vector."""
    unit = df.select(cluster, item, l2_normalize(F.col(vec)).alias("v"))
    mean = unit.select(cluster, F.posexplode("v").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    near = unit.join(mean, cluster).withColumn("s", F.round(cosine(F.col("v"), F.col("m")), 9))
    return near.groupBy(cluster).agg(F.max_by(item, F.struct("s", -F.col(item))).alias(item), F.count("*").alias("n"))


# Composite pipelines


def review_items(windows: DataFrame, timeseries: DataFrame, explanations: DataFrame, keys: list[str]) -> DataFrame:
    """Nested review items: a window's padded series beside its explanations, none as an empty list."""
    grouped = explanations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("provider", "classification", F.coalesce("confidence", F.lit(0.0)).alias("confidence")))).alias("explainers"))
    none = F.array().cast("array<struct<provider:string,classification:string,confidence:double>>")
    return windows.join(timeseries, keys, "left").join(grouped, keys, "left").withColumn("explainers", F.coalesce("explainers", none))


def dedup_mentions(mentions: DataFrame, page: list[str], name: str = "text", rank: str = "rank") -> DataFrame:
    """Overlap suppression by page, then clusters of names by fuzzy likeness and acronyms, then a canonical form for each with its count and forms.

    mentions: page columns, text, start, end, score, rank. They are read once: all that follows is on the distinct names with their counts, which are kept.
    """
    kept = suppress_overlaps(mentions, page, rank=rank, columns=[name, rank]).groupBy(name).agg(F.count("*").alias("count"), F.min(rank).alias("rank"))
    named = cut(kept.groupBy(clean_text(F.col(name)).alias("name")).agg(F.sum("count").alias("count"), F.min("rank").alias("rank")))
    edges = fuzzy_pairs(named, "name")
    short = named.where(F.col("name").rlike("^[A-Z0-9]{2,6}$")).select(F.col("name").alias("s"))
    long = named.where(F.col("name").contains(" ")).select(F.col("name").alias("l"), initials(F.col("name")).alias("s"))
    edges = edges.unionByName(short.join(long, "s").select(F.col("s").alias("a"), F.col("l").alias("b")))
    placed = named.join(clusters(named, edges), "name")
    return canonical(placed, "cluster", "name", "count", "rank")


def map_document(df: DataFrame, mapping: dict[str, str], payload: str, keep: str = "additional") -> DataFrame:
    """Columns from JSON paths (mapping: column to path), lists joined by comma, and the top-level fields that no path uses as a map."""
    used = {p.split(".")[0] for p in mapping.values()}

    def value(p: str) -> Column:
        raw = F.get_json_object(payload, "$." + p)
        return F.coalesce(F.array_join(F.array_distinct(F.from_json(raw, "array<string>")), ", "), raw)

    rest = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: ~k.isin(*used) & v.isNotNull())
    return df.select("*", *[value(p).alias(c) for c, p in mapping.items()], rest.alias(keep))
