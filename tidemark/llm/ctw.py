"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary decisions; every decision has its own binary context tree, whose node at depth d is
chosen by the d bytes before. A node's Krichevsky-Trofimov estimate and the product of its children's weighted
probabilities are mixed with weight 1/2 each, from the given depth up to 0; the weights that the training text leaves at
the nodes on a path mix the estimates of all depths when a byte is scored. A context never trained on predicts 1/2 for
each bit. Texts begin after so many bytes 0xFF and end with one, which is scored as well (UTF-8 has no such byte).

What Spark gathers is the count of each distinct byte string of depth + 1 bytes and of each distinct word, dealt into BUCKETS by
the last three context bytes; a row carries many of them as packed numbers. Each bucket's trees are then built on their own, and only the nodes at
depth 2 come together (at most 65,536 contexts of 255 nodes, whatever the corpus). The most frequent HEAD byte strings and words
go to the executors with their values by broadcast; what a text has besides travels to its bucket and is valued there.

Null texts count as empty: one token (the end), one scored byte. Rows with a null id are in fold 0. Each row gives one
row, repeated rows and ids too. With nothing to learn from, N is 0 and every bit has probability 1/2. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Rolling, fold, mix, parts, shared_dir, staged, tidy

#: Context bytes at most: with the byte itself they fill 64 bits.
DEPTH = 7
#: Byte strings, and words, that a broadcast holds at most: with their tables some 250 and 60 MB in a worker.
HEAD, HEAD_WORDS = 5_800_000, 1_000_000
#: Word and byte-string entries that a task gathers before it merges them.
MERGE = 2_500_000
#: Text bytes that a task takes at once, and rows whose keys it deals at once.
PART, DEALT = 1 << 19, 2_000
#: Text bytes of a bucket, about, and how many buckets there are at least and at most.
BUCKET_BYTES, BUCKETS = 2 << 20, (8, 65_536)
PAD = 0xFF
GRAM, WORD, NODE = 0, 1, 2
#: The key of the end token, and one that no byte string or word has (0xC0 is no byte of UTF-8).
END, EMPTY = np.uint64(1), np.uint64(0xC0C0C0C0C0C0C0C0)

_DELIMITER = np.zeros(256, bool)
_DELIMITER[[0x20, *range(0x09, 0x0E), PAD]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Part:
    """The byte strings and the words of a run of texts, as keys, each with its row."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int, words: bool = True):
        lengths, rows = np.diff(starts), len(starts) - 1
        row = np.arange(rows)
        text = np.full(len(data) + rows * (depth + 1) + 8, PAD, np.uint8)
        text[np.arange(len(data)) + np.repeat(row * (depth + 1) + depth, lengths)] = data
        self.first = starts[:-1] + row  # where each row's byte strings begin
        at = np.arange(len(data) + rows) + np.repeat(row * depth, lengths + 1)
        raw = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))[at]
        # The latest context byte is the highest, so sorted keys are in the trees' order; the byte itself is the lowest.
        self.grams = ((raw & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | ((raw >> np.uint64(8 * depth)) & np.uint64(255))
        if words:
            text = _LOWER[text]
            space = _DELIMITER[text]
            begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
            keys = Rolling(text).ranges(begin, end)
            self.words = np.where((keys <= END) | (keys == EMPTY), keys + np.uint64(2), keys)
            self.word_row = np.searchsorted(starts[:-1] + row * (depth + 1) + depth, begin, "right") - 1
            self.n_words = np.bincount(self.word_row, minlength=rows)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers in few bytes: their bytes by place, compressed. Sorted keys and small counts have long runs there."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(array: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the stretches of an array between ends; null where one is empty."""
    ends = ends.tolist()
    return pa.array([_pack(array[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _bucket(kind: int, keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Byte strings with the same three latest context bytes share a bucket; words are spread."""
    return (mix(keys >> np.uint64(8 * (depth - 2)) if kind == GRAM else keys) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(kind: int, keys: np.ndarray, others: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in use by bucket: (bucket numbers, ends, keys, others)."""
    own = _bucket(kind, keys, depth, buckets)
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.append(first, len(own)), keys[order], others[order]


def gather(df: DataFrame, learn: Column, depth: int, buckets: int, text_col: str = "text") -> DataFrame:
    """Rows (kind, bucket, keys, counts): training counts of every byte string anywhere, and of every word learned from, some tasks' share each."""

    @tidy("ctw model")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {GRAM: ([], [], 0), WORD: ([], [], 0)}

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            own, ends, keys, counts = _by_bucket(kind, keys, counts, depth, buckets)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int8)), pa.array(own), _packed(keys, ends), _packed(counts.astype(np.int64), ends)], ["kind", "bucket", "keys", "counts"])

        def add(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ks, cs, size = held[kind]
            ks.append(keys)
            cs.append(counts)
            held[kind] = (ks, cs, size + len(keys))
            if held[kind][2] > MERGE:
                merged = _merged(ks, cs)
                # What stays large after merging is passed on, so that a task's memory is bounded.
                if len(merged[0]) > MERGE // 2:
                    held[kind] = ([], [], 0)
                    yield rows(kind, *merged)
                else:
                    held[kind] = ([merged[0]], [merged[1]], len(merged[0]))

        for batch in batches:
            learned = np.array(batch[1].fill_null(False).to_pylist(), bool)
            for first, end, data, starts in parts(batch[0], PART):
                part, take = Part(data, starts, depth), learned[first:end]
                if take.all():
                    yield from add(GRAM, *_runs(part.grams))
                else:
                    trained = np.repeat(take, np.diff(np.append(part.first, len(part.grams))))
                    yield from add(GRAM, *_runs(part.grams[trained]))
                    keys, counts = _runs(part.grams[~trained])
                    yield from add(GRAM, keys, counts * 0)
                yield from add(WORD, *_runs(part.words[take[part.word_row]]))
                yield from add(WORD, np.array([END]), np.array([take.sum()]))
        for kind, (ks, cs, _) in held.items():
            if ks:
                yield rows(kind, *_merged(ks, cs))

    return df.select(text_col, learn.alias("learn")).mapInArrow(run, "kind tinyint, bucket bigint, keys binary, counts binary")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after a shift by 8."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def _kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 1.1447298858494002


_FEW = _kt_of(*np.meshgrid(np.arange(64.0), np.arange(64.0), indexing="ij"))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same, by a table where both are small."""
    few = (zeros < len(_FEW)) & (ones < len(_FEW))
    out = _FEW[np.where(few, zeros, 0).astype(np.int64), np.where(few, ones, 0).astype(np.int64)]
    out[~few] = _kt_of(zeros[~few], ones[~few])
    return out


class Tree:
    """A bucket's trees from sorted byte strings and their counts: the distinct (context, byte) keys at each depth, the deepest first, down to depth 3."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.counts, self.above, self.changes = [keys], [counts.astype(float)], [], []
        for _ in range(depth - 3):
            up, which = np.unique(_up(self.keys[-1]), return_inverse=True)
            self.above.append(which.astype(np.int32))
            self.counts.append(np.bincount(which, self.counts[-1], len(up)))
            self.keys.append(up)
        for keys in self.keys:
            self.changes.append(keys[1:] ^ keys[:-1])

    def nodes(self, decision: int) -> list[Nodes]:
        """The nodes of one decision at each depth, the deepest first, mixed with those below."""
        found: list[Nodes] = []
        for k, (keys, counts, change) in enumerate(zip(self.keys, self.counts, self.changes, strict=True)):
            new = np.concatenate([[True], change >= np.uint64(1 << (8 - decision))])
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            ones = np.add.reduceat(counts * ((keys >> np.uint64(7 - decision)) & np.uint64(1)).astype(np.uint8), first)
            node = Nodes(first, np.cumsum(new, dtype=np.int32) - np.int32(1), total - ones, ones)
            if k:
                below = found[-1]
                below.up = node.of[self.above[k - 1][below.first]]
                node.mix(np.bincount(below.up, below.weighted, len(first)))
            found.append(node)
        return found

    def names(self, node: Nodes, decision: int) -> np.ndarray:
        """Numbers of the nodes at depth 3: the context, then a 1 and the bits before the decision."""
        keys = self.keys[-1][node.first]
        return (keys >> np.uint64(8) << np.uint64(8)) | ((keys & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - decision))


class Nodes:
    """Nodes of one depth and decision: where each begins among the depth's keys, each key's node, and the zeros and ones seen."""

    def __init__(self, first: np.ndarray, of: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.first, self.of, self.zeros, self.ones = first, of, zeros, ones
        self.weighted, self.stop = _kt(zeros, ones), np.ones(len(first))
        self.up = of[:0]

    def mix(self, below: np.ndarray) -> None:
        self.weighted, self.stop = _mixed(self.weighted, below)


def _mixed(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability, and the weight left on its own estimate."""
    odds = below - kt
    with np.errstate(over="ignore"):
        e = np.exp(odds)
    return np.where(odds > 500, below, kt + np.log(1 + e)) - np.log(2), 1 / (1 + e)


def _estimates(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.stack([zeros + 0.5, ones + 0.5]) / (zeros + ones + 1)


def _up(keys: np.ndarray) -> np.ndarray:
    """Names of the nodes with a context byte less."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


def merged(counted: DataFrame, buckets: int, depth: int) -> DataFrame:
    """Each bucket's counts together: rows (kind, bucket, keys, counts, sizes), and of kind NODE the sums of its nodes for those at depth 2.

    sizes: how many keys have a count under 2, 4, 8, ..., then their counts' sum and how many were learned.
    """

    @tidy("ctw model")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            for kind, bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ks, cs = held.setdefault((kind, bucket), ([], []))
                ks.append(keys)
                cs.append(counts)
        nodes: list[np.ndarray] = []
        names = ["kind", "bucket", "keys", "counts", "sizes"]
        for kind, bucket in list(held):
            ks, cs = held.pop((kind, bucket))
            keys, counts = _merged([_unpack(x) for x in ks], [_unpack(x, np.int64) for x in cs])
            sizes = np.bincount(np.floor(np.log2(counts + 1.5)).astype(int), minlength=64)[:64]
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([bucket], pa.int64()), pa.array([_pack(keys)], pa.binary()), pa.array([_pack(counts)], pa.binary()), pa.array([[*sizes.tolist(), int(counts.sum()), int((counts > 0).sum())]], pa.list_(pa.int64()))], names)
            if kind == GRAM:
                tree = Tree(keys, counts, depth)
                for d in range(8):
                    top = tree.nodes(d)[-1]
                    nodes.append(np.stack([tree.names(top, d).view(np.float64), top.zeros, top.ones, top.weighted]))
        if nodes:
            every = np.concatenate(nodes, axis=1)
            up, which = np.unique(_up(every[0].view(np.uint64)), return_inverse=True)
            sums = np.stack([np.bincount(which, every[k], len(up)) for k in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([pa.array([NODE], pa.int8()), pa.array([0], pa.int64()), pa.array([_pack(up)], pa.binary()), pa.array([_pack(sums.ravel())], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names)

    return counted.repartition(buckets, "bucket").mapInArrow(run, "kind tinyint, bucket bigint, keys binary, counts binary, sizes array<bigint>")


class Top:
    """What the nodes of depths 0 to 2 add to those below: by the name of a node at depth 2, the summed share of each bit, and the weight that is left."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        levels, ups = [], []
        for depth in (2, 1, 0):
            weighted, stop = _mixed(_kt(zeros, ones), below)
            levels.append((stop, _estimates(zeros, ones)))
            if depth:
                above, which = np.unique(_up(names), return_inverse=True)
                ups.append(which)
                if depth == 2:
                    self.names = names
                names, zeros, ones, below = above, *(np.bincount(which, x, len(above)) for x in (zeros, ones, weighted))
        share, left = np.zeros((2, len(names))), np.ones(len(names))
        for depth in (2, 1, 0):
            stop, estimate = levels[depth]
            share, left = share + left * stop * estimate, left * (1 - stop)
            if depth:
                share, left = share[:, ups[depth - 1]], left[ups[depth - 1]]
        self.share, self.left = share, left

    def at(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.names, names)
        return self.share[:, i], self.left[i]


def _top(nodes: DataFrame) -> Top:
    """The depth-2 nodes' sums over all buckets, added by Spark."""

    @tidy("ctw model")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sums in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                x = _unpack(sums, np.float64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(keys, np.int64)), *map(pa.array, x)], ["name", "zeros", "ones", "below"])

    sums = nodes.select("keys", "counts").mapInArrow(run, "name bigint, zeros double, ones double, below double").groupBy("name").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    names = sums.column("name").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return Top(names[order], *(sums.column(c).to_numpy()[order] for c in ("zeros", "ones", "below")))


def values(keys: np.ndarray, counts: np.ndarray, top: Top, depth: int) -> np.ndarray:
    """log10 of the mixture's probability of the last byte of each of a bucket's byte strings, which must be sorted."""
    tree, out = Tree(keys, counts, depth), np.zeros(len(keys))
    for d in range(8):
        found = tree.nodes(d)
        share, left = top.at(_up(tree.names(found[-1], d)))
        for k in range(len(found) - 1, -1, -1):
            node = found[k]
            share, left = share + left * node.stop * _estimates(node.zeros, node.ones), left * (1 - node.stop)
            if k:
                share, left = share[:, found[k - 1].up], left[found[k - 1].up]
        bit = ((keys >> np.uint64(7 - d)) & np.uint64(1)).astype(np.int64)
        out += np.log10(share[bit, found[0].of])
    return out


class Lookup:
    """An open-addressing hash table from 64-bit keys to doubles, built and read in whole arrays. A key and its value are one item of 16 bytes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(1.4 * len(keys) + 1).bit_length())) - 1)
        pairs = np.empty((int(self.mask) + 1, 2), np.uint64)
        pairs[:, 0], pairs[:, 1] = EMPTY, np.float64(np.nan).view(np.uint64)
        for k in range(0, len(keys), 1 << 18):  # little beside the table itself
            self._put(pairs, keys[k : k + (1 << 18)], values[k : k + (1 << 18)].astype(np.float64).view(np.uint64))
        self.table = pairs.ravel().view(np.complex128)

    def _put(self, pairs: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        slot, left = (mix(keys) & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[pairs[slot[left], 0] == EMPTY]
            pairs[slot[free], 0] = keys[free]
            won = free[pairs[slot[free], 0] == keys[free]]  # of several for one place the last has it
            pairs[slot[won], 1] = values[won]
            left = left[pairs[slot[left], 0] != keys[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, nan where there is none."""
        out = np.empty(len(keys))
        for k in range(0, len(keys), 1 << 15):  # what is at hand stays in the cache
            self._get(keys[k : k + (1 << 15)], out[k : k + (1 << 15)])
        return out

    def _get(self, keys: np.ndarray, out: np.ndarray) -> None:
        slot = (mix(keys) & self.mask).astype(np.int64)
        got = np.take(self.table, slot).view(np.uint64).reshape(-1, 2)
        out[:] = got[:, 1].view(np.float64)
        left = np.flatnonzero((got[:, 0] != keys) & (got[:, 0] != EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            got = np.take(self.table, slot[left]).view(np.uint64).reshape(-1, 2)
            out[left] = got[:, 1].view(np.float64)
            left = left[(got[:, 0] != keys[left]) & (got[:, 0] != EMPTY)]


class Model:
    """The merged counts, what the top nodes add, the token totals, and the most frequent keys with their values."""

    def __init__(self, rows: DataFrame, top, buckets: int, depth: int, tokens: int, types: int):
        self.rows, self.top, self.buckets, self.depth, self.tokens, self.types = rows, top, buckets, depth, tokens, types
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: dict[int, bool] = {}

    def of_words(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def take_head(self, kind: int, sizes: np.ndarray, limit: int) -> None:
        """Hold the most frequent keys of a kind, limit at most. sizes: how many keys have a count under 2, 4, 8, ..."""
        under = int(next(k for k in range(65) if sizes[k:].sum() <= limit))
        least, top, depth = 2**under - 1, self.top, self.depth
        self.whole[kind] = not sizes[:under].sum()

        @tidy("ctw model")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    keys, counts = _unpack(keys), _unpack(counts, np.int64)
                    often = np.flatnonzero(counts >= least)
                    if len(often):
                        value = values(keys, counts, top.value, depth) if kind == GRAM else counts.astype(float)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(value[often])], ["key", "value"])

        got = self.rows.where(F.col("kind") == kind).select("keys", "counts").mapInArrow(run, "key bigint, value double").toArrow()
        self.heads[kind] = got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()


def fit(df: DataFrame, learn: Column, text_col: str = "text", limit: int = HEAD, depth: int = DEPTH) -> Model:
    """Train on the rows for which learn holds; byte strings of all rows of df get their probabilities. depth: 3 to 7."""
    size = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    buckets = int(min(BUCKETS[1], max(BUCKETS[0], size // BUCKET_BYTES)))
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    merged(gather(df, learn, depth, buckets, text_col), buckets, depth).write.partitionBy("kind").parquet(path)
    rows = df.sparkSession.read.schema("bucket bigint, keys binary, counts binary, sizes array<bigint>, kind int").parquet(path)
    sums = {kind: np.zeros(66, np.int64) for kind in (GRAM, WORD)}
    for r in rows.where("sizes IS NOT NULL").select("kind", F.posexplode("sizes").alias("k", "x")).groupBy("kind", "k").agg(F.sum("x").alias("x")).collect():
        sums[r.kind][r.k] = r.x
    top = df.sparkSession.sparkContext.broadcast(_top(rows.where(F.col("kind") == NODE)))
    model = Model(rows, top, buckets, depth, int(sums[WORD][64]), int(sums[WORD][65]))
    model.take_head(GRAM, sums[GRAM][:64], limit)
    model.take_head(WORD, sums[WORD][:64], min(limit, HEAD_WORDS))
    return model


def _rest(found: DataFrame, model: Model) -> DataFrame:
    """Rows (row, score, base, known): the sums over the keys of found (row, grams, words) that are not in the heads, each valued in its bucket."""
    depth, buckets, top, whole_words = model.depth, model.buckets, model.top, model.whole[WORD]
    of_words = Model(None, None, buckets, depth, model.tokens, model.types).of_words

    @tidy("ctw rest")
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, DEALT) for b in batches for k in range(0, b.num_rows, DEALT)):
            row = batch.column("row").to_numpy()
            for kind, name in ((GRAM, "grams"), (WORD, "words")):
                lists = [_unpack(x) if x else np.zeros(0, np.uint64) for x in batch.column(name).to_pylist()]
                keys, of = np.concatenate([np.zeros(0, np.uint64), *lists]), np.repeat(row, [len(x) for x in lists])
                order = np.argsort(keys)
                own, ends, keys, of = _by_bucket(kind, keys[order], of[order], depth, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own), _packed(keys, ends), pa.nulls(len(own), pa.binary()), _packed(of, ends)], ["kind", "bucket", "keys", "counts", "rows"])

    @tidy("ctw rest")
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            for kind, bucket, keys, counts, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model_rows, asked = held.setdefault((kind, bucket), ([], []))
                if counts is None:
                    asked.append((keys, of))
                else:
                    model_rows.append((keys, counts))
        for kind, bucket in list(held):
            model_rows, asked = held.pop((kind, bucket))
            if not asked:
                continue
            keys, counts = (_unpack(model_rows[0][0]), _unpack(model_rows[0][1], np.int64)) if model_rows else (np.array([EMPTY]), np.zeros(1, np.int64))  # words never learned
            value = values(keys, counts, top.value, depth) if kind == GRAM else of_words(counts)
            want, of = np.concatenate([_unpack(x) for x, _ in asked]), np.concatenate([_unpack(x, np.int64) for _, x in asked])
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            there = (keys[i] == want) & ((kind == GRAM) | (counts[i] > 0))
            got = np.where(there, value[i], 0.0 if kind == GRAM else of_words(np.zeros(1))[0])
            row, which = np.unique(of, return_inverse=True)
            sums, known, zero = np.bincount(which, got, len(row)), np.bincount(which, there, len(row)).astype(np.int64), np.zeros(len(row))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(sums if kind == GRAM else zero), pa.array(zero if kind == GRAM else sums), pa.array(known * (kind == WORD))], ["row", "score", "base", "known"])

    asked = found.select("row", "grams", "words").mapInArrow(deal, "kind int, bucket bigint, keys binary, counts binary, rows binary")
    known = model.rows.where(F.col("kind").isin(*([GRAM] * (not model.whole[GRAM]) + [WORD] * (not whole_words)))).select("kind", "bucket", "keys", "counts", F.lit(None).cast("binary").alias("rows"))
    each = known.unionByName(asked).repartition(buckets, "bucket").mapInArrow(meet, "row bigint, score double, base double, known bigint")
    return each.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("score", "base", "known")])


def tables(heads: dict) -> list[Lookup]:
    """Hash tables of a broadcast's keys and values: built once in each worker, in their place, so a worker doesn't hold both and the broadcast stays as small as its rows."""
    for kind in (GRAM, WORD):
        if not isinstance(heads[kind], Lookup):
            heads[kind] = Lookup(*heads[kind])
    return [heads[kind] for kind in (GRAM, WORD)]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of df.

    df must be what fit() saw, since byte strings without a value there count as 0.
    """
    words_of = model.heads[WORD]
    shared = df.sparkSession.sparkContext.broadcast({GRAM: model.heads[GRAM], WORD: (words_of[0], model.of_words(words_of[1]))})
    unseen, depth, src, all_words = float(model.of_words(np.zeros(1))[0]), model.depth, df.select(id_col, text_col), model.whole[WORD]
    kind = src.schema[0].dataType.simpleString()

    @tidy("ctw")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = tables(shared.value)
        for batch in batches:
            for first, end, data, starts in parts(batch[1], PART):
                part, n = Part(data, starts, depth), end - first
                value = grams.get(part.grams)
                lost = np.isnan(value)
                total = np.add.reduceat(np.where(lost, 0, value), part.first)
                known = words.get(np.append(part.words, END))
                finish, known = known[-1], known[:-1]
                absent = np.isnan(known)
                base = np.bincount(part.word_row, np.where(absent, unseen if all_words else 0, known), n) + (unseen if np.isnan(finish) else finish)
                n_known = np.bincount(part.word_row[~absent], minlength=n) + int(finish > unseen)
                before = np.append(0, np.cumsum(lost))[np.append(part.first, len(lost))]
                absent &= not all_words
                yield pa.RecordBatch.from_arrays([
                    batch[0].slice(first, n), pa.array(np.diff(starts)), pa.array((part.n_words + 1).astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(total),
                    _packed(part.grams[lost], before), _packed(part.words[absent], np.append(0, np.cumsum(np.bincount(part.word_row[absent], minlength=n)))),
                ], [id_col, "n_bytes", "n_tokens", "n_known", "base_score", "score", "grams", "words"])

    found = src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double, grams binary, words binary")
    if not all(model.whole.values()):
        # Each row has a number of its own, fixed by writing it.
        found = staged(found.withColumn("row", F.monotonically_increasing_id()))
        more = lambda c: F.coalesce(F.col(f"more_{c}"), F.lit(0))
        found = found.drop("grams", "words").join(_rest(found, model), "row", "left").withColumns({"n_known": F.col("n_known") + more("known"), "base_score": F.col("base_score") + more("base"), "score": F.col("score") + more("score")})
    return found.select(id_col, "n_bytes", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, limit: int = HEAD, depth: int = DEPTH) -> DataFrame:
    """Train on all folds but one and score every row, with held_out."""
    mine = fold(F.col(id_col), folds)
    model = fit(df, mine != held, text_col, limit, depth)
    return score(df, model, id_col, text_col).withColumn("held_out", mine == held)
