"""Dataset mentions in documents: chunks, footnotes, tables, overlaps, fuzzy duplicates, clusters (W2)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from tidemark.functions.text import initials
from tidemark.operators.graph import components
from tidemark.session import cut


def token_windows(df: DataFrame, text: str = "text", size: int = 200, overlap: int = 50) -> DataFrame:
    """One row for each window of white-space tokens: chunk number, first token, text. Windows step by size - overlap; the last reaches the end."""
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    n = F.size("_tokens")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / (size - overlap))).cast("int")
    out = df.withColumn("_tokens", tokens).where(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("chunk") * (size - overlap)
    return out.withColumns({"first_token": first, "n_tokens": F.least(F.lit(size), n - first), "chunk_text": F.array_join(F.slice("_tokens", first + 1, F.lit(size)), " ")}).drop("_tokens")


def footnote_refs(text: Column) -> Column:
    """Distinct numbers of [n] marks, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))))


def footnotes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add notes (map of number to text) and body: the notes at a text's end whose number the text refers to, and what stands before them."""
    closed, opened, bare = re.compile(r"^\[(\d+)\]\s+(.*)"), re.compile(r"^\[(\d+)\s+(.*)"), re.compile(r"^(\d{1,3})\s+([A-Z\"'(].*|http.*|www.*)")

    def split(text: str | None) -> tuple[dict, str]:
        text = text or ""
        refs = set(map(int, re.findall(r"\[(\d+)\]", text)))
        lines, notes, begin = text.split("\n"), {}, None
        for k in range(len(lines) - 1, -1, -1) if refs else ():
            line = lines[k].strip()
            if not line:
                continue
            m = closed.match(line) or opened.match(line) or bare.match(line)
            if m and (int(m[1]) in refs or int(m[1]) < 200):
                if int(m[1]) in refs:
                    notes[int(m[1])] = m[2]
                begin = k
            elif begin is not None:
                break
        return notes, text if begin is None else "\n".join(lines[:begin])

    @F.pandas_udf("notes map<bigint,string>, body string")
    def found(texts: pd.Series) -> pd.DataFrame:
        both = [split(t) for t in texts]
        return pd.DataFrame({"notes": [b[0] for b in both], "body": [b[1] for b in both]})

    return df.withColumn("_f", found(text)).select("*", "_f.notes", "_f.body").drop("_f")


def table_runs(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Markdown tables: runs of lines with '|' that hold a separator row, as (first line, last line) from 0."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content")).where(F.col("content").contains("|"))
    rule = F.col("content").rlike(r"^\s*\|[\-\s\|]+\|")
    # Lines of a run have the same difference between line number and rank.
    run = F.col("line") - F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    grouped = lines.withColumns({"run": run, "rule": rule}).groupBy(*keys, "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max("rule").alias("rule"))
    return grouped.where("rule").drop("run", "rule")


def sentence_context(text: Column, start: Column, sentences: int = 1) -> Column:
    """The sentence that holds a position and so many on either side. Sentences end in . ! or ? and white space."""
    marked = F.split(F.regexp_replace(text, r"([.!?]+\s+)", "$1\u0001"), "\u0001")
    at = F.size(F.split(F.regexp_replace(F.substring(text, F.lit(1), start), r"([.!?]+\s+)", "$1\u0001"), "\u0001"))
    first = F.greatest(F.lit(1), at - sentences)
    return F.trim(F.array_join(F.slice(marked, first, at + sentences - first + 1), ""))


def suppress_overlaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", score: str = "score", margin: float = 0.05, rank: str | None = None, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Of overlapping spans of a page keep the better one (its columns, all if none are given): the higher score; within the margin the longer, then the lower rank, then the one before.

    Spans are met by start, then by order (all columns if it isn't given). What is kept is disjoint, so a span can only meet the last one kept: it takes
    its place or goes. A page's spans are sorted and passed once, and only the last one kept is held. A null score counts as 0, a null place as 0.
    """
    place = [F.coalesce(F.col(c), F.lit(0)) for c in (start, end)]
    rows = df.select("*", *[c.alias(f"_{n}") for c, n in zip([*place, F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.col(rank) if rank else F.lit(0)], "sevr", strict=True)])
    by_start = Window.partitionBy(*keys).orderBy("_s", *(order or []), *(["_e", "_v", "_r"] if order else []), *[c for c in df.columns if c not in keys])
    # A span that begins where those before it have ended, as a page's first, meets none of them.
    reach = F.max("_e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(reach, F.col("_s")) <= F.col("_s"))
    kept = columns or df.columns
    return rows.select(*kept, "_s", "_e", "_v", "_r", "_new").mapInArrow(partial(_last_kept, margin=margin), df.select(*kept).schema)


def _last_kept(batches: Iterator[pa.RecordBatch], margin: float) -> Iterator[pa.RecordBatch]:
    """The rows kept of sorted ones that end in _s, _e, _v, _r and _new."""

    def above(a: float, b: float) -> bool:
        return a > b or a != a and b == b  # a NaN is above all numbers

    def better(m: tuple, last: tuple) -> bool:
        size, held = m[1] - m[0], last[1] - last[0]
        if above(m[2], last[2] + margin):
            return True
        return abs(m[2] - last[2]) <= margin and (size > held or size == held and m[3] is not None and last[3] is not None and above(last[3], m[3]))

    carried = last = None  # the last row kept, if it is of a batch before; its values
    for batch in batches:
        if not batch.num_rows:
            continue
        *columns, new = [c.to_numpy(zero_copy_only=False).tolist() if not c.null_count else c.to_pylist() for c in batch.columns[-5:]]
        whole = batch.select(batch.schema.names[:-5])
        begins = np.array(new, bool)
        alone = begins & np.append(begins[1:], False)
        kept, at = alone.copy(), None
        if begins[0] and carried is not None:
            yield carried
            carried = None
        for k in np.flatnonzero(~alone).tolist():
            m = tuple(c[k] for c in columns)
            if begins[k] or m[1] <= last[0] or last[1] <= m[0]:
                if carried is not None:
                    yield carried
            elif better(m, last):
                if at is not None:
                    kept[at] = False
            else:
                continue
            carried, last, at = None, m, k
            kept[k] = True
        if at is not None:
            kept[at] = False
            carried = whole.slice(at, 1)
        yield whole.filter(pa.array(kept))
    if carried is not None:
        yield carried


def non_overlapping(df: DataFrame, keys: list[str], start: str, end: str, by: list[Column]) -> DataFrame:
    """Spans of a page best first by the given columns (then by place), each kept if it overlaps none kept before; in the order of the page."""
    spans = F.array_sort(F.collect_list(F.struct(*[c.alias(f"b{k}") for k, c in enumerate(by)], F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*df.columns).alias("row"))))
    clash = lambda kept, m: F.exists(kept, lambda k: (m["s"] < k["e"]) & (k["s"] < m["e"]))
    kept = F.aggregate("x", F.slice("x", 1, 0), lambda acc, m: F.when(clash(acc, m), acc).otherwise(F.concat(acc, F.array(m))))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(spans.alias("x")).select(F.explode(kept).alias("m")).select("m.row.*")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, on the bits of one integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity of 0 to 100: twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words and shared words with either rest; 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (both + " " + s if both and s else both or s for s in (only_a, only_b))
    return max(ratio(with_a, with_b), *((ratio(both, with_a), ratio(both, with_b)) if both else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one of at most its length; of equal lengths, either way."""

    def best(short: str, long: str) -> float:
        n = len(short)
        stretches = {long[max(0, k) : k + n] for k in range(1 - n, len(long))}
        return max(ratio(short, s) for s in stretches if s)

    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


def are_fuzzy_duplicates(a: str, b: str, short: int = 10, low: float = 85.0, high: float = 95.0) -> bool:
    """Equal but for case, or two of the three ratios at least low (high for short texts)."""
    if a.lower() == b.lower():
        return True
    least = high if min(len(a), len(b)) < short else low
    met = (token_sort_ratio(a, b) >= least) + (token_set_ratio(a, b) >= least)
    return met == 2 or met == 1 and partial_ratio(a, b) >= least  # the dearest ratio only where it decides


@F.pandas_udf(StructType().add("pairs", ArrayType(StringType())).add("bits", ArrayType(LongType())))
def _features(texts: pd.Series) -> pd.DataFrame:
    """A text's pairs of letters, each with its occurrence, and two bit sets, each as four numbers and how much it leaves out.

    The first has a bit for each of the first 8 letters in each of 32 classes, the second one for the pairs of each of 256 hashes.
    """

    def pairs(text: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for k in range(len(text) - 1):
            seen[text[k : k + 2]] += 1
            out.append(f"{text[k : k + 2]}{seen[text[k : k + 2]]}")
        return out

    def packed(places: set[int], n: int) -> list[int]:
        row = sum(1 << p for p in places).to_bytes(32, "little")
        return [*(int.from_bytes(row[k : k + 8], "little", signed=True) for k in range(0, 32, 8)), n - len(places)]

    def bits(text: str, pairs: list[str]) -> list[int]:
        counts = Counter(ord(c) % 32 for c in text)
        return packed({8 * c + k for c, n in counts.items() for k in range(min(n, 8))}, len(text)) + packed({zlib.crc32(p.encode()) % 256 for p in pairs}, len(pairs))

    found = texts.map(pairs)
    return pd.DataFrame({"pairs": found, "bits": [bits(t, p) for t, p in zip(texts, found, strict=True)]})


def _common(a: str, b: str, first: int = 0) -> Column:
    """Letters (or, from bit set 5, pairs of letters) that two texts share at most."""
    return sum((F.bit_count(F.get(a, first + k).bitwiseAND(F.get(b, first + k))) for k in range(4)), F.least(F.get(a, first + 4), F.get(b, first + 4)))


def _spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt to all cores, as what they meet in a join is many times what they are."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "a", by)


def near_tokens(names: DataFrame, least: float, text: str = "a", rare: bool = False) -> DataFrame:
    """(a, n, bits, g): names (a, text) by the tokens of which any name with a ratio of at least least has one too.

    With r = least / 100 the common subsequence of texts of n <= m letters has at least r (n + m) / 2 of them, so m <= n (2 - r) / r. A deletion spoils two pairs of letters and an insertion one, so the
    texts share at least s (n + m) - 1 pairs, s = 1.5 r - 1. Hence they meet in a prefix of either: its first pairs in an order for all, all but as many as any partner must share, and one.
    Texts too short for that meet in a letter. The order is by a hash, the same in every table, or with rare by frequency in this one.
    """
    r = least / 100
    slope = 1.5 * r - 1
    short = 2 / slope if slope > 0 else float("inf")
    columns = [F.col("a"), F.col(text).alias("t")]
    each = cut(names.select(*columns).distinct().select("a", "t", F.length("t").alias("n"), _features("t").alias("f")).select("a", "t", "n", "f.pairs", "f.bits"))
    letters = each.where(F.col("n") < short).select("a", "n", "bits", F.explode(F.array_distinct(F.filter(F.split("t", ""), lambda c: c != ""))).alias("g"))
    if slope <= 0:
        return letters
    shared = F.greatest(F.lit(1.0), F.ceil(slope * (F.col("n") + F.col("n") * (r / (2 - r))) - 1 - 1e-6))
    if rare:
        tokens = each.select("a", "t", "n", "bits", F.explode("pairs").alias("g"))
        counts = tokens.groupBy("g").agg(F.count("*").alias("f"))
        place = F.row_number().over(Window.partitionBy("a", "t").orderBy("f", "g"))
        prefix = tokens.join(counts, "g").withColumn("k", place).where(F.col("k") <= F.col("n") - shared).select("a", "n", "bits", "g")
    else:
        ordered = F.array_sort(F.transform("pairs", lambda g: F.struct(F.crc32(g.cast("binary")).alias("f"), g.alias("g"))))
        prefix = each.where(F.col("n") - shared >= 1).select("a", "n", "bits", F.explode(F.slice(ordered, F.lit(1), (F.col("n") - shared).cast("int"))["g"]).alias("g"))
    return prefix.unionByName(letters)


def _fits(least: float) -> Column:
    """Whether names (n, bits) and (m, bits2) may have the ratio, by length, letters and pairs of letters."""
    r = least / 100
    both = F.col("n") + F.col("m")
    lengths = (F.col("m") * r <= F.col("n") * (2 - r) + 1e-6) & (F.col("n") * r <= F.col("m") * (2 - r) + 1e-6)
    return lengths & (2 * _common("bits", "bits2") >= r * both - 1e-6) & (_common("bits", "bits2", 5) >= (1.5 * r - 1) * both - 1 - 1e-6)


def _near(forms: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b), a < b, of names with a pair of forms (a, t) that may have a ratio of at least least; none is left out. What meets in a token is compared inside the join, before it makes a row."""
    meet = near_tokens(forms, least, "t", rare=True)
    other = meet.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bits2"), F.col("g").alias("h"))
    longer = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    pairs = _spread(meet, "g").join(other, (F.col("g") == F.col("h")) & (F.col("a") != F.col("b")) & longer & _fits(least))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def ratios_between(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, target, ratio) of names of near_tokens() and of a second such table with target, with a ratio of at least least, none left out."""
    other = right.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bits2"), F.col("g").alias("h"), "target")
    pairs = _spread(left, "g").join(other, (F.col("g") == F.col("h")) & _fits(least)).select("a", "b", "target").distinct()
    return pairs.withColumn("ratio", _ratio("a", "b")).where(F.col("ratio") >= least)


def ratio_pairs(df: DataFrame, name: str, least: float = 85.0) -> DataFrame:
    """Pairs (a, b, ratio), a < b, of distinct names with a ratio of at least least, none left out."""
    names = cut(df.select(F.col(name).alias("a")).where("a IS NOT NULL").distinct())
    return _near(names.select("a", F.col("a").alias("t")), least).withColumn("ratio", _ratio("a", "b")).where(F.col("ratio") >= least)


def fuzzy_candidates(names: DataFrame, low: float = 85.0, high: float = 95.0) -> DataFrame:
    """Pairs (a, b), a < b, of names (a) among which all fuzzy duplicates are.

    Two of three ratios have to be met. Names whose words in order, or distinct words in order, are near by their ratio come from _near(). Any other pair meets the partial ratio and, by a
    word that both have, the token set ratio. With p = r / (2 - r), r = ratio / 100, its shorter name of n letters has at least p n of them in common with the longer one, and either the shared words are
    at least p of one name's distinct words, or these differ in at most 1 - r of their letters. A deleted letter spoils two pairs of letters and an inserted one a further one, which bounds the
    pairs that the longer name may lack.
    """

    @F.pandas_udf("folded string, ordered string, distinct string")
    def forms(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"folded": texts.map(str.lower), "ordered": texts.map(lambda s: " ".join(sorted(s.split()))), "distinct": texts.map(lambda s: " ".join(sorted(set(s.split()))))})

    each = cut(names.select("a", forms("a").alias("f")).select("a", "f.folded", "f.ordered", "f.distinct"))
    equal = [each.join(each.select(F.col("a").alias("b"), form), form).where("a < b").select("a", "b") for form in ("folded", "ordered")]
    near = _near(each.select("a", F.explode(F.array_distinct(F.array("ordered", "distinct"))).alias("t")), min(low, high))
    # Words that two names share, with the letters of the names and of their distinct words.
    rows = cut(each.select("a", F.length("a").alias("n"), _features("a")["bits"].alias("bits"), F.length("distinct").alias("u"), _features("distinct")["bits"].alias("ubits"), F.filter(F.split("distinct", " "), lambda w: w != "").alias("words")))
    one = rows.withColumn("word", F.explode("words"))
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    r = F.when(F.col("n") < 10, high / 100).otherwise(low / 100)
    p = r / (2 - r)
    lost = F.greatest(3 * (1 - r), 4 * (1 - r) / (2 - r))  # of the shorter name's pairs, by deleted and inserted letters
    partial = (_common("bits", "bits2") >= p * F.col("n") - 1e-6) & (_common("bits", "bits2", 5) >= F.col("n") - 1 - F.floor(F.col("n") * lost + 1e-6))
    longer = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("a") < F.col("a2")))
    met = _spread(one, "word").join(two, (F.col("word") == F.col("word2")) & longer & partial)
    near_words = 2 * _common("ubits", "ubits2") >= r * (F.col("u") + F.col("u2")) - 1e-6
    least_words = p * F.least("u", "u2") - 1e-6
    shared = met.groupBy("a", "a2").agg((F.sum(F.length("word") + 1) - 1).alias("s"), F.max(near_words).alias("near"), F.max(least_words).alias("least"))
    by_word = shared.where(F.col("near") | (F.col("s") >= F.col("least"))).select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b"))
    return equal[0].union(equal[1]).union(near).union(by_word).distinct()


def fuzzy_pairs(df: DataFrame, name: str, low: float = 85.0, high: float = 95.0) -> DataFrame:
    """Pairs (a, b), a < b, of distinct names that are fuzzy duplicates, none left out: fuzzy_candidates(), each checked by the ratios."""
    pairs = fuzzy_candidates(df.select(F.col(name).alias("a")).where("a IS NOT NULL").distinct(), low, high)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[are_fuzzy_duplicates(a, b, 10, low, high) for a, b in zip(f["a"], f["b"], strict=True)]]

    return pairs.mapInPandas(check, pairs.schema)


def acronym_pairs(df: DataFrame, short: str, long: str) -> DataFrame:
    """Pairs of distinct shorts and longs where the short is part of the long's initials, by a join on the parts."""
    shorts = df.select(F.col(short).alias("short")).where(F.length("short") > 0).distinct().withColumn("key", F.upper(F.trim("short")))
    longs = df.select(F.col(long).alias("long")).where("long IS NOT NULL").distinct().withColumn("i", initials(F.col("long"))).where("i <> ''")
    n = F.length("i")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda w: F.substring("i", k, w)))))
    return shorts.join(longs.select("long", F.explode(parts).alias("key")), "key").where(F.length("short") <= F.length("long")).select("short", "long")


def clusters(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (name, cluster): the connected component of each name by edges (a, b), named by its first name; names alone are their own."""
    found = components(edges.select("a", "b"))
    return names.select("name").distinct().join(found.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("cluster"))


def canonical(mentions: DataFrame, cluster: str, name: str, count: str, rank: str) -> DataFrame:
    """By cluster the canonical name (lowest rank, then longest, then first), the summed count and the other forms."""
    best = F.min_by(name, F.struct(F.col(rank), -F.length(name), F.col(name)))
    return mentions.groupBy(cluster).agg(best.alias("canonical"), F.sum(count).alias("n"), F.array_sort(F.collect_set(name)).alias("forms"))
