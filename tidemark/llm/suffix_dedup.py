"""Removes byte strings that stood earlier in the corpus, by sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or in
the same document before. Strings are judged on the input and never cross documents.

Suffixes are only sorted where they may matter. Every LENGTH-byte window is named by an anchor: the leftmost smallest hash among
its runs of ANCHOR bytes, so equal windows have equal anchors. Anchors are counted over the whole corpus; windows whose
anchor occurs once are unlike all others. The others travel as short strings, those of one anchor to one task, which sorts
the suffixes at all their window starts: multikey quicksort, several bytes at a step, to SHALLOW bytes, then blind tries
(a round compares each group with one of its suffixes and branches at the first differing byte) to LENGTH bytes. Equal neighbours
in that order are equal windows; all but the earliest are hits. Neighbouring windows with equal anchors travel as one string, up to
STRETCH starts, so a text that repeats itself travels once. An anchor that occurs over HOT times is dealt to
several tasks by document and place; what stays unmatched there meets once more, grouped by the windows' own digests.

A null text counts as empty; a null id comes before all others. Rows with equal id and text are one document, and each
gets its result; texts under one id are ordered by their hash. Texts under LENGTH bytes lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Rolling, cut, parts, staged, tidy

LENGTH, ANCHOR, SHALLOW = 100, 36, 33
#: Occurrences of an anchor that one task sorts, windows in a task, about, and starts that one string holds (a power of 2).
HOT, WINDOWS, STRETCH = 5_000, 600_000, 1 << 14
#: Repeated anchors that may be broadcast (8 bytes each); beyond, a join finds them.
BROADCAST = 4_000_000


class Windows:
    """The windows of a run of texts: each run of windows that share an anchor at one place (or, joined, an anchor's bytes), by first start and length."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int = LENGTH, joined: bool = False):
        wide = length - ANCHOR + 1  # anchors in a window
        room = np.maximum(np.diff(starts) - length + 1, 0)
        self.row = np.zeros(0, np.int64)
        if not room.sum():
            self.at = self.count = self.row
            self.anchor = np.zeros(0, np.uint64)
            return
        hashes = Rolling(data).windows(ANCHOR)
        bits = np.uint64(len(data).bit_length())
        tagged = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full((-(-len(tagged) // wide) + 1) * wide, np.uint64(2**64 - 1))
        padded[: len(tagged)] = tagged
        blocks = padded.reshape(-1, wide)
        from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(from_right[: len(tagged)], from_left[wide - 1 : wide - 1 + len(tagged)])
        start = np.arange(int(room.sum())) + np.repeat(starts[:-1] - (np.cumsum(room) - room), room)
        anchor = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        new = np.concatenate([[True], (hashes[anchor[1:]] != hashes[anchor[:-1]] if joined else anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        if joined:  # a string's first start is at most STRETCH from its last
            new |= (start - np.repeat(starts[:-1], room)) % STRETCH == 0
        first = np.flatnonzero(new)
        self.at, self.count = start[first], np.diff(np.append(first, len(start)))
        self.anchor = hashes[anchor[first]]
        self.row = np.searchsorted(starts, self.at, "right") - 1


def sort_suffixes(text: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Rank of the length bytes at each start; equal strings have equal ranks, and ranks are in byte order."""
    n, at = len(at), at.astype(np.int64)
    buffer = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))
    rank, live = np.zeros(n, np.int64), np.arange(n)

    def refine(live: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Split groups by key; of those that have several members still, the members and their keys."""
        group = rank[live]
        if bits == 64 or n >> (64 - bits):
            order = np.lexsort((key, group)) if bits < 64 else np.argsort(key)
        else:
            order = np.argsort((group.astype(np.uint64) << np.uint64(bits)) | key)
        group, key, live = group[order], key[order], live[order]
        block = np.concatenate([[True], group[1:] != group[:-1]])
        run = block | np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(live))
        rank[live] = group + np.maximum.accumulate(np.where(run, index, 0)) - np.maximum.accumulate(np.where(block, index, 0))
        many = (np.diff(np.append(np.flatnonzero(run), len(live))) > 1)[np.cumsum(run) - 1]
        return live[many], key[many]

    # Multikey quicksort to the shallow depth, eight bytes at first, then five beside the group's number.
    if n:
        live, _ = refine(live, words[at].astype(np.uint64), 64)
    for depth in range(8, shallow, 5):
        if len(live):
            live, _ = refine(live, words[at[live] + depth].astype(np.uint64) >> np.uint64(24), 40)
    # Blind tries for what is left: branch off one suffix of each group at the first difference from it.
    while len(live):
        live = live[np.argsort(rank[live], kind="stable")]
        group = rank[live]
        block = np.concatenate([[True], group[1:] != group[:-1]])
        pivot = live[np.maximum.accumulate(np.where(block, np.arange(len(live)), 0))]
        key = np.full(len(live), 1 << 16, np.uint64)
        left = np.flatnonzero(live != pivot)
        for depth in range(shallow, length, 8):
            mine, its = words[at[live[left]] + depth].astype(np.uint64), words[at[pivot[left]] + depth].astype(np.uint64)
            if depth + 8 > length:
                mine, its = (x >> np.uint64(8 * (depth + 8 - length)) << np.uint64(8 * (depth + 8 - length)) for x in (mine, its))
            differ = mine != its
            mine, its, where = mine[differ], its[differ], left[differ]
            xor = mine ^ its
            same = sum(((xor >> np.uint64(64 - 8 * k)) == 0).astype(np.uint64) for k in range(1, 8))
            byte = (mine >> (np.uint64(56) - np.uint64(8) * same)) & np.uint64(255)
            common = np.uint64(depth) + same
            key[where] = np.where(mine < its, (common << np.uint64(8)) | byte, np.uint64(2 << 16) | ((np.uint64(255) - common) << np.uint64(8)) | byte)
            left = left[~differ]
        live, key = refine(live, key, 18)
        live = live[key != np.uint64(1 << 16)]
    return rank


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("v"), text.alias("t"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, starts in parts(batch[0]):
            keys, counts = np.unique(Windows(data, starts).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of data[at : at + size]."""
    ends = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.arange(int(ends[-1])) + np.repeat(at - ends[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())])


STRINGS = "h bigint, n bigint, d bigint, v bigint, at bigint, s binary"


def _strings(docs: DataFrame, repeated: DataFrame, n_repeated: int, broadcast: int, hot: int) -> DataFrame:
    """Rows (h, n, d, v, at, s): the bytes under each run of windows whose anchor is repeated."""
    return _found_by_broadcast(docs, repeated, hot) if n_repeated <= broadcast else _found_by_join(docs, repeated)


def _found_by_broadcast(docs: DataFrame, repeated: DataFrame, hot: int) -> DataFrame:
    """One pass over the texts with all repeated anchors at hand. Counts are only needed, and only sent, where they are over hot; others say 2."""
    often = {r.h: r.n for r in repeated.where(F.col("n") > hot).collect()}
    keys = np.sort(repeated.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    names = np.sort(np.array(list(often), np.int64).view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast((keys, names, np.array([often[h] for h in names.view(np.int64).tolist()], np.int64)))

    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, counts = known.value
        for batch in batches if len(keys) else ():
            d, v = batch[0].to_numpy(), batch[1].to_numpy()
            for first, _, data, starts in parts(batch[2], 1 << 20):
                w = Windows(data, starts, joined=True)
                i = np.minimum(np.searchsorted(keys, w.anchor), len(keys) - 1)
                take = np.flatnonzero(keys[i] == w.anchor)
                row, anchor, n = w.row[take], w.anchor[take], np.full(len(take), 2, np.int64)
                if len(names):
                    j = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
                    n = np.where(names[j] == anchor, counts[j], n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(n), pa.array(d[first + row]), pa.array(v[first + row]),
                    pa.array(w.at[take] - starts[row]), _gathered(data, w.at[take], w.count[take] + LENGTH - 1),
                ], ["h", "n", "d", "v", "at", "s"])

    return docs.mapInArrow(run, STRINGS)


def _found_by_join(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Anchors' places meet the repeated anchors in a join, then their documents, so that only bytes that are needed travel."""

    @tidy("suffix")
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, v = batch[0].to_numpy(), batch[1].to_numpy()
            for first, _, data, starts in parts(batch[2], 1 << 20):
                w = Windows(data, starts, joined=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.anchor.view(np.int64)), pa.array(d[first + w.row]), pa.array(v[first + w.row]), pa.array(w.at - starts[w.row]), pa.array(w.count)], ["h", "d", "v", "at", "c"])

    @tidy("suffix")
    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.column("x")[k].values
                h, n, at, c = (x.field(name).to_numpy() for name in ("h", "n", "at", "c"))
                data = np.frombuffer(batch.column("t")[k].as_py().encode(), np.uint8)
                same = lambda name, k=k, m=len(h): pa.array(np.full(m, batch.column(name)[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), same("d"), same("v"), pa.array(at), _gathered(data, at, c + LENGTH - 1)], ["h", "n", "d", "v", "at", "s"])

    hits = docs.mapInArrow(places, "h bigint, d bigint, v bigint, at bigint, c bigint").join(repeated, "h")
    by_text = hits.groupBy("d", "v").agg(F.collect_list(F.struct("h", "n", "at", "c")).alias("x"))
    return docs.join(by_text, ["d", "v"]).mapInArrow(bytes_of, STRINGS)


def _later(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of a whole partition: windows that are not the earliest of their kind, as runs, and the earliest of hot anchors."""
    schema = pa.schema([("d", pa.int64()), ("v", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    column = table.column("s").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(column.buffers()[2], np.uint8)
    d, v, begin, often = (table.column(c).to_numpy() for c in ("d", "v", "at", "n"))
    windows = np.diff(ends) - LENGTH + 1
    of = np.repeat(np.arange(len(d)), windows)
    step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = sort_suffixes(text, ends[of] + step)
    order = np.lexsort((v, d))
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], (d[order][1:] != d[order][:-1]) | (v[order][1:] != v[order][:-1])]))
    place = (number[of] << 40) | (begin[of] + step)
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    earliest = np.empty(len(rank), np.int64)
    earliest[order] = np.repeat(np.minimum.reduceat(place[order], first), np.diff(np.append(first, len(order))))
    later = np.flatnonzero(place > earliest)
    if len(later):
        run = np.flatnonzero(np.concatenate([[True], (of[later][1:] != of[later][:-1]) | (step[later][1:] != step[later][:-1] + 1)]))
        o, a = of[later][run], begin[of[later][run]] + step[later][run]
        yield pa.RecordBatch.from_arrays([pa.array(d[o]), pa.array(v[o]), pa.array(a), pa.array(np.diff(np.append(run, len(later)))), pa.nulls(len(o), pa.binary())], schema=schema)
    unsure = np.flatnonzero((place == earliest) & (often[of] > hot))
    for k in range(0, len(unsure), 100_000):
        u = unsure[k : k + 100_000]
        o, p = of[u], ends[of[u]] + step[u]
        digest = [xxhash.xxh3_128_digest(text[x : x + LENGTH].tobytes()) for x in p.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(d[o]), pa.array(v[o]), pa.array(begin[o] + step[u]), pa.array(np.ones(len(o), np.int64)), pa.array(digest, pa.binary())], schema=schema)


def later_windows(docs: DataFrame, broadcast: int = BROADCAST, hot: int = HOT) -> DataFrame:
    """Rows (d, v, at, n): n windows from byte at on that also start earlier. docs: (d, v, t)."""
    repeated = cut(docs.select("t").mapInArrow(tidy("suffix")(_anchors), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    total = repeated.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    strings = _strings(docs, repeated, total.k, broadcast, hot)
    parallel = max(8, int((total.n or 0) * (LENGTH - ANCHOR + 1) / 2 / WINDOWS))
    salt = F.when(F.col("n") > hot, F.pmod(F.xxhash64("d", F.floor(F.col("at") / STRETCH)), F.ceil(F.col("n") / hot))).otherwise(F.lit(0))
    found = strings.repartition(parallel, "h", salt).mapInArrow(tidy("suffix")(lambda b: _later(b, hot)), "d bigint, v bigint, at bigint, n bigint, digest binary")
    if (total.most or 0) <= hot:
        return found.drop("digest")
    # The earliest windows of a hot anchor's parts: a digest has at most as many as there are parts.
    found = staged(found)
    apart = found.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("d", "v", "at"))).alias("x")).where(F.size("x") > 1)
    again = apart.select(F.explode(F.slice("x", F.lit(2), F.size("x") - 1)).alias("x")).select("x.d", "x.v", "x.at", F.lit(1).cast("long").alias("n"))
    return found.where(F.col("digest").isNull()).drop("digest").unionByName(again)


def removed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes that windows cover."""
    order = np.argsort(at)
    start, end = at[order], np.maximum.accumulate(at[order] + n[order] - 1 + LENGTH)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:], len(end)) - 1]


def _with_spans(df: DataFrame, id_col: str, text_col: str, broadcast: int, hot: int, others: tuple[Column, ...] = ()) -> DataFrame:
    docs = _keyed(df, id_col, text_col)
    spans = later_windows(docs, broadcast, hot).groupBy("d", "v").agg(F.collect_list("at").alias("a"), F.collect_list("n").alias("w"))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("v"), F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *others).alias("row"))
    return rows.join(spans, ["d", "v"], "left").select("row.*", "a", "w")


def _kept(text: str | None, at: np.ndarray, n: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    raw = (text or "").encode()
    if not len(at):
        return raw, []
    spans = list(zip(*(x.tolist() for x in removed(at, n)), strict=True))
    borders = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)), spans


_NONE = np.zeros(0, np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [_NONE if x is None else np.array(x, np.int64) for x in batch.column(name).to_pylist()]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST, hot: int = HOT) -> DataFrame:
    """df with the repeated bytes taken out of its text, and removed_bytes, removed_spans (array of start and end byte).

    Cutting bytes may split a character; what is left of such a character goes as well.
    """
    others = [c for c in df.columns if c not in (id_col, text_col)]
    found = _with_spans(df, id_col, text_col, broadcast, hot, tuple(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    names = [f"c{k}" for k in range(len(others))]
    schema = f"id {df.schema[id_col].dataType.simpleString()}, t string, {''.join(f'c{k} {df.schema[c].dataType.simpleString()}, ' for k, c in enumerate(others))}removed_bytes bigint, removed_spans array<array<bigint>>"

    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, spans = [], [], []
            for value, at, n in zip(batch.column("t"), _lists(batch, "a"), _lists(batch, "w"), strict=True):
                text = value.as_py()
                kept, cut_out = _kept(text, at, n)
                texts.append(text if not cut_out else kept.decode("utf-8", "ignore"))
                gone.append(sum(b - a for a, b in cut_out))
                spans.append([list(s) for s in cut_out])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), *(batch.column(c) for c in names), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["id", "t", *names, "removed_bytes", "removed_spans"])

    out = found.mapInArrow(run, schema)
    back = {id_col: "id", text_col: "t"} | {c: f"c{k}" for k, c in enumerate(others)}
    return out.select(*[F.col(back[c]).alias(c) for c in df.columns], "removed_bytes", "removed_spans")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST, hot: int = HOT) -> DataFrame:
    """Per row (id_col, n_bytes, n_removed, n_spans, kept_sha256)."""
    found = _with_spans(df, id_col, text_col, broadcast, hot)

    @tidy("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, sha = [], [], [], []
            for value, at, n in zip(batch.column("t"), _lists(batch, "a"), _lists(batch, "w"), strict=True):
                kept, cut_out = _kept(value.as_py(), at, n)
                gone.append(sum(b - a for a, b in cut_out))
                size.append(len(kept) + gone[-1])
                spans.append(len(cut_out))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
