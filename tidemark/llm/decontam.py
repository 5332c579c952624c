"""Finds benchmark passages in documents: a prefix-filtered set join of item windows with document words.

Words are runs of digits, letters and bytes over 0x7F, A-Z in lower case. A window is WINDOW consecutive words of an
item, or a whole item of fewer. The shingles (SHINGLE consecutive words) of all windows are counted over all documents
and ordered by rarity; a document that contains a window must contain its rarest shingle, so that necessary prefix of one is all that is
joined. A candidate must lie within its document by length and position, and is then verified word by word, first by the words' hashes, then by their letters.

Distinct pairs of window and item are dealt to blocks of about BLOCK by a hash of both, so what is broadcast has a fixed bound even if one window
is in very many items; each block is searched in all documents, and documents are never shuffled. Between many blocks, what was found is written down. Null texts have no words and are never contaminated; items without words have
no window; a null item id counts as the id ''. Items that share an id count once. Every document row gives one row, repeated rows and ids too;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Rolling, carried, cut, mix, parts, staged, tidy

WINDOW, SHINGLE = 10, 3
#: Pairs of window and item in a block, about; blocks searched before what was found is written; candidates verified at once.
BLOCK, WRITTEN, AT_ONCE = 250_000, 8, 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spelled(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of a run of texts, where each row's words begin, the text in lower case, and where in it each word begins and ends."""
    rows = len(starts) - 1
    # A space after each text keeps words from running on.
    text = np.full(len(data) + rows + 1, 32, np.uint8)
    text[1 + np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(starts))] = _LOWER[data]
    inside = _IN_WORD[text]
    begin, end = np.flatnonzero(~inside[:-1] & inside[1:]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return Rolling(text).ranges(begin, end), np.searchsorted(begin, np.append(starts[:-1] + np.arange(rows), len(text))), text, begin, end


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a run of texts, and where each row's words begin."""
    return spelled(data, starts)[:2]


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each size consecutive words, by the first."""
    n = max(0, len(word) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return mix(out)


class Block:
    """Distinct windows, the items that have each, and their shingles."""

    def __init__(self, items: list[str], windows: list[str]):
        names, own = np.unique(np.array(windows, object), return_inverse=True) if windows else (np.zeros(0, object), np.zeros(0, np.int64))
        self.items: list[list[str]] = [[] for _ in names]
        for item, w in zip(items, own.tolist(), strict=True):
            self.items[w].append(item)
        raw = [w.encode() for w in names]
        starts = np.cumsum([0, *map(len, raw)])
        hashes, first, self.text, begin, end = spelled(np.frombuffer(b"".join(raw), np.uint8), starts)
        self.size = np.diff(first)
        #: By window and place, a word's hash and where its letters are.
        inside = np.arange(WINDOW) < self.size[:, None]
        at = np.minimum(first[:-1, None] + np.arange(WINDOW), max(0, len(hashes) - 1))
        self.words, self.begin, self.length = (np.where(inside, x[at], np.zeros(1, x.dtype)) if len(x) else np.zeros(at.shape, x.dtype) for x in (hashes, begin, end - begin))
        #: By shingle size, the shingles in use with the window and the place of each.
        self.tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(1, SHINGLE + 1):
            found = []
            for size in np.unique(self.size[np.minimum(self.size, SHINGLE) == k]).tolist():
                mine = np.flatnonzero(self.size == size)
                for place in range(size - k + 1):
                    found.append((shingles(self.words[mine, place : place + k].ravel(), k)[::k], mine, np.full(len(mine), place)))
            if found:
                self.tokens[k] = tuple(np.concatenate(x) for x in zip(*found, strict=True))
        self.prefixes: dict[int, tuple] = {}

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep each window's rarest shingle by counts (sorted shingles, numbers), in a tie that of fewer windows, then the smaller hash."""
        for k, (token, window, place) in self.tokens.items():
            known, numbers = counts.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            i = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
            n = np.where(known[i] == token, numbers[i], 0) if len(known) else np.zeros(len(token), np.int64)
            _, which, sharing = np.unique(token, return_inverse=True, return_counts=True)
            order = np.lexsort((place, token, sharing[which], n, window))
            rarest = order[np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))]
            rarest = rarest[np.argsort(token[rarest], kind="stable")]
            unique, first = np.unique(token[rarest], return_index=True)
            self.prefixes[k] = (unique, np.append(first, len(rarest)), window[rarest], place[rarest])

    def hits(self, word: np.ndarray, first: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, window) of every occurrence in what spelled() gave."""
        found = [np.zeros((3, 0), np.int64)]
        for k, (unique, ends, window, place) in self.prefixes.items():
            have = shingles(word, k)
            i = np.minimum(np.searchsorted(unique, have), len(unique) - 1)
            at = np.flatnonzero(unique[i] == have)
            many = np.cumsum(ends[i[at] + 1] - ends[i[at]])
            low = 0
            while low < len(at):  # a shingle of very many windows is taken in steps
                high = max(low + 1, int(np.searchsorted(many, (many[low - 1] if low else 0) + AT_ONCE, "right")))
                found.append(self._verified(at[low:high], i[at[low:high]], ends, window, place, word, first, text, begin, end))
                low = high
        return tuple(np.concatenate(found, axis=1))

    def _verified(self, at, i, ends, window, place, word, first, text, begin, end) -> np.ndarray:
        many = ends[i + 1] - ends[i]
        which = np.arange(int(many.sum())) + np.repeat(ends[i] - (np.cumsum(many) - many), many)
        at, win = np.repeat(at, many), window[which]
        start, row = at - place[which], np.searchsorted(first, at, "right") - 1
        # Length and position: the window must lie in the document.
        fits = (start >= first[row]) & (start + self.size[win] <= first[row + 1])
        start, row, win = start[fits], row[fits], win[fits]
        for j in range(WINDOW):
            there = np.minimum(start + j, len(word) - 1)
            same = (self.size[win] <= j) | ((word[there] == self.words[win, j]) & (end[there] - begin[there] == self.length[win, j]))
            start, row, win = start[same], row[same], win[same]
        for j in range(WINDOW):  # equal hashes and lengths: the letters
            length = np.where(self.size[win] > j, self.length[win, j], 0)
            of = np.repeat(np.arange(len(win)), length)
            step = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            other = np.bincount(of[text[begin[np.minimum(start + j, len(word) - 1)][of] + step] != self.text[self.begin[win, j][of] + step]], minlength=len(win))
            start, row, win = start[other == 0], row[other == 0], win[other == 0]
        return np.stack([row, start, win])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, data, starts in parts(batch[1]):
            _, first, text, begin, end = spelled(data, starts)
            items, found = [], []
            for r in range(len(first) - 1):
                name = batch[0][at + r].as_py() or ""
                mine = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin[first[r] : first[r + 1]].tolist(), end[first[r] : first[r + 1]].tolist(), strict=True)]
                for k in range(max(1, len(mine) - WINDOW + 1) if mine else 0):
                    items.append(name)
                    found.append(" ".join(mine[k : k + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], ["item", "window"])


def _counted(docs: DataFrame, block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of a block occurs in all documents: by size, sorted shingles and numbers."""

    @tidy("decontam")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {k: np.unique(v[0]) for k, v in block.value.tokens.items()}
        sums = {k: np.zeros(len(v), np.int64) for k, v in tokens.items()}
        for batch in batches:
            for _, _, data, starts in parts(batch[0]):
                word, first = words(data, starts)
                for k, unique in tokens.items():
                    have = shingles(word, k)
                    i = np.minimum(np.searchsorted(unique, have), len(unique) - 1)
                    sums[k] += np.bincount(i[unique[i] == have], minlength=len(unique))
        for k, unique in tokens.items():
            some = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(unique[some].view(np.int64)), pa.array(sums[k][some])], ["k", "token", "n"])

    rows = docs.select("t").mapInArrow(run, "k int, token bigint, n bigint").groupBy("k", "token").agg(F.sum("n").alias("n")).toArrow()
    size, token, n = rows.column("k").to_numpy(), rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return {int(k): (token[order][size[order] == k], n[order][size[order] == k]) for k in np.unique(size)}


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> list[list[int]]:
    """For each row the maximal runs of words that spans cover, as start, end, start, ..."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    wide = row << 40  # rows apart
    reach = np.maximum.accumulate(wide + end) if len(row) else end
    new = np.flatnonzero(np.concatenate([[True], (wide + start)[1:] > reach[:-1]])) if len(row) else np.zeros(0, np.int64)
    last = (reach & ((1 << 40) - 1))[np.append(new[1:], len(row)) - 1] if len(row) else end
    out: list[list[int]] = [[] for _ in range(rows)]
    for r, a, b in zip(row[new].tolist(), start[new].tolist(), last.tolist(), strict=True):
        out[r] += [a, b]
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK) -> DataFrame:
    """Rows (id_col, n_words, spans, items): word spans that occurring windows cover (start, end, start, ...), by block, and the
    items' ids. One row for each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    windows = cut(benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).mapInArrow(_windows, "item string, window string").distinct())
    blocks = max(1, -(-windows.count() // block_windows))
    src, texts_of = carried(docs, id_col, text_col)
    whole = len(src.columns) == 1
    state = src.toDF("id") if whole else src.toDF("id", "t")
    found = state.select(F.col("id").getField(text_col).alias("t")) if whole else state.select("t")
    state = state.withColumns({"n": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for b in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).toArrow()
        block = Block(mine.column("item").to_pylist(), mine.column("window").to_pylist())
        block.order(_counted(found, spark.sparkContext.broadcast(block)) if mine.num_rows else {})
        shared, last = spark.sparkContext.broadcast(block), b == blocks - 1

        @tidy("decontam")
        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for at, end, data, starts in parts(texts_of(batch)):
                    mine = batch.slice(at, end - at)
                    read = spelled(data, starts)
                    row, start, win = block.hits(*read)
                    first = read[1]
                    spans = [a + b for a, b in zip(mine.column("spans").to_pylist(), _runs(row, start - first[row], start - first[row] + block.size[win], end - at), strict=True)]
                    items = mine.column("items").to_pylist()
                    pairs = np.unique(np.stack([row, win]), axis=1)
                    for r, w in zip(*pairs.tolist(), strict=True):
                        items[r] = block.items[w] if not items[r] else items[r] + block.items[w]
                    done = [mine.column("id"), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(set(x)) if len(x) > 1 else x for x in items], pa.list_(pa.string()))]
                    if whole:
                        yield pa.RecordBatch.from_arrays(done, ["id", "n", "spans", "items"])
                    else:  # the texts are needed up to the last block
                        yield pa.RecordBatch.from_arrays([done[0], pa.nulls(end - at, pa.string()) if last else mine.column("t"), *done[1:]], ["id", "t", "n", "spans", "items"])

        state = state.mapInArrow(run, f"id {kind}, {'' if whole else 't string, '}n bigint, spans array<int>, items array<string>")
        if b % WRITTEN == WRITTEN - 1 and not last:
            state = staged(state)
    return state.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document (id_col, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = occurrences(docs, benchmark, id_col, **options)

    @tidy("decontam")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for spans in batch.column("spans").to_pylist():
                covered, end = 0, 0
                for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    covered += max(0, b - max(a, end))
                    end = max(end, b)
                hit.append(covered)
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch[0], batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([n > 0 for n in hit], pa.bool_()),
            ], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
