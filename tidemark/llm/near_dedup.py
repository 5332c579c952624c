"""Near-duplicate classes by consistent weighted sampling.

A text is a weighted set of shingles of WORDS words (letters and digits, A-Z in lower case): a shingle weighs its count times the
mean inverse document frequency of its words, from counts over all documents in 2**20 hashed cells. Improved consistent weighted
sampling draws HASHES samples a text; two texts agree in a sample with the probability of their weighted Jaccard similarity.
Samples are banded by ROWS; texts that share a band are candidates and are verified exactly on their whole shingle sets.

Equal texts are one node from the start. In a bucket every text is checked against the bucket's first text, never
all against all. A bucket whose texts are then still in several components is open: for some turns those outside its largest component are
checked against one text of it, another each turn; those still apart are checked
against all others there that they can be alike to: by a bound from the weight of shingles that no other such text has, and by the samples' agreement. That is done
in blocks of PAIRED by PAIRED texts, to which at first only samples and weights travel; the texts follow to the blocks where they have a candidate. Classes are the connected components of the verified links.

A text of fewer than WORDS words is one shingle; a text without words, null or empty, is alike only to equal texts (null
equals empty). Rows with a null id take part; a class of which no row has an id has a null class_id. Each row gives one row, repeated
rows and ids too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, mix, parts, staged, tidy, utf8
from tidemark.llm.decontam import shingles, words
from tidemark.operators.graph import components

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 12
HASHES = ROWS * BANDS
#: Samples that a pair must agree in to be verified: below it, at the least similarity, once in 20,000 pairs.
AGREE = 27
#: Turns in which a bucket's texts are checked against one more text of its largest component (each band another), before all are.
TURNS = 1
CELLS = 1 << 20
#: Texts, and characters of them, on either side of a block in which what is still apart is checked.
PAIRED, PAIRED_CHARS = 1024, 16 << 20
#: Ids of texts to verify that may be broadcast; beyond, a join finds the texts.
BROADCAST = 500_000
#: Shingles sampled at once, so that the arrays stay in the cache.
CHUNK = 1 << 15

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weighted(data: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles of a run of texts, by row."""
    word, first = words(data, starts)
    count = np.diff(first)
    weight = np.concatenate([[0.0], np.cumsum(idf[word & np.uint64(CELLS - 1)])])
    full = np.maximum(count - WORDS + 1, 0)
    at = np.arange(int(full.sum())) + np.repeat(first[:-1] - (np.cumsum(full) - full), full)
    token, row, size = shingles(word, WORDS)[at], np.repeat(np.arange(len(count)), full), np.full(len(at), WORDS)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = [int(shingles(word[first[r] : first[r + 1]], count[r])[0]) ^ int(count[r]) for r in short]
        at, token, row, size = np.append(at, first[short]), np.append(token, np.array(whole, np.uint64)), np.append(row, short), np.append(size, count[short])
    mean = (weight[at + size] - weight[at]) / size
    order = np.lexsort((token, row)) if len(short) else np.argsort(token, kind="stable")
    if not len(short):
        order = order[np.argsort(row[order], kind="stable")]
    row, token, mean = row[order], token[order], mean[order]
    new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], token[new], mean[new] * np.diff(np.append(new, len(row)))


def sample(token: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of several sets: [set, hash]. first: where each set begins."""
    log_weight = np.log(weight).astype(np.float32)
    count = np.diff(np.append(first, len(token)))
    out = np.empty((len(first), HASHES), np.int32)
    unit, half = np.float32(2.0**-24), np.float32(2.0**-25)
    low = np.uint64(0xFFFFFF)
    uniform = lambda bits: bits.astype(np.int32).astype(np.float32) * unit + half
    for k in range(HASHES):
        x = (token ^ _SEEDS[k]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(32)
        r = -np.log(uniform(x >> np.uint64(40)) * uniform((x >> np.uint64(16)) & low))
        c = -np.log(uniform(y >> np.uint64(40)) * uniform((y >> np.uint64(16)) & low))
        beta = (y & np.uint64(0xFFFF)).astype(np.int32).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_weight / r + beta)
        a = np.log(c) - r * (t - beta + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), count))
        least = least[np.searchsorted(least, first)]
        out[:, k] = (mix(token[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)
    return out


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency by cell, from all rows of docs (t), and their number."""

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            sums[CELLS] += batch.num_rows
            for _, _, data, starts in parts(batch[0]):
                word, first = words(data, starts)
                row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
                pair = np.sort((row << np.uint64(20)) | (word & np.uint64(CELLS - 1)))
                pair = pair[np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))] if len(pair) else pair
                sums[:CELLS] += np.bincount((pair & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    got = docs.select("t").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS + 1)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return (np.log((counts[CELLS] + 1) / (counts[:CELLS] + 1)) + 1).astype(np.float32), int(counts[CELLS])


def signatures(docs: DataFrame, idf) -> DataFrame:
    """Rows (d, m, sig, bands) for docs (d, m, t); texts without words have null sig and bands. idf: a broadcast."""

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, starts in parts(batch.column("t"), 1 << 20):
                row, token, weight = weighted(data, starts, idf.value)
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                sig = np.empty((len(first), HASHES), np.int32)
                k = 0
                while k < len(first):
                    stop = max(k + 1, int(np.searchsorted(first, first[k] + CHUNK)))
                    last = first[stop] if stop < len(first) else len(token)
                    sig[k:stop] = sample(token[first[k] : last], weight[first[k] : last], first[k:stop] - first[k])
                    k = stop
                band = np.zeros((len(first), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::ROWS].astype(np.uint64))
                there = np.zeros(end - at, bool)
                there[row[first]] = True
                lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(there) - there, there.sum()).astype(np.int32) * n, mask=np.append(~there, False)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(at, end - at), batch.column("m").slice(at, end - at), lists(sig, HASHES), lists(band.view(np.int64), BANDS)], ["d", "m", "sig", "bands"])

    return docs.select("d", "m", "t").mapInArrow(run, "d bigint, m string, sig array<int>, bands array<bigint>")


def similarity(pairs: DataFrame, idf) -> DataFrame:
    """Weighted Jaccard similarity of whole texts: rows (a, b, similarity) for pairs (a, b, ta, tb)."""

    @tidy("near")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n, found = part.num_rows, []
                for name in ("ta", "tb"):
                    for at, _, data, starts in parts(part.column(name), 1 << 40):
                        row, token, weight = weighted(data, starts, idf.value)
                        found.append((row + at, token, weight, np.bincount(row, weight, n)))
                (ra, ta, wa, sa), (rb, tb, wb, sb) = found
                row, token, weight = np.append(ra, rb), np.append(ta, tb), np.append(wa, wb)
                order = np.lexsort((token, row))
                row, token, weight = row[order], token[order], weight[order]
                same = np.flatnonzero((row[1:] == row[:-1]) & (token[1:] == token[:-1]))
                shared = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), n)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shared / np.maximum(sa + sb - shared, 1e-12))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def shared_weights(texts: DataFrame, idf) -> DataFrame:
    """Rows (node, total, shared) for texts (node, t): the weight of a text's shingles, and of those that another of the texts has too.

    What two texts share is at most the lesser of their shared weights, which bounds their similarity before any pair is made.
    A task passes on a shingle that it meets several times once, so a frequent shingle is as many rows as there are tasks.
    """
    names = ["token", "node", "total", "shared", "n"]

    @tidy("near")
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch[0].to_numpy()
            for at, end, data, starts in parts(batch[1]):
                row, token, weight = weighted(data, starts, idf.value)
                _, first, which, count = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
                many = count[which] > 1
                total, shared = (np.bincount(row, w, end - at) for w in (weight, weight * many))
                mine, marks = node[at:end], token[first[count > 1]].view(np.int64)
                alone = token[~many].view(np.int64)
                k, m, n = len(mine), len(marks), len(alone)
                zero = np.zeros
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([mine, marks, alone])), pa.array(np.concatenate([mine, zero(m, np.int64), node[at + row[~many]]])), pa.array(np.concatenate([total, zero(m), zero(n)])),
                    pa.array(np.concatenate([shared, zero(m), weight[~many]])), pa.array(np.concatenate([zero(k, np.int8), np.full(m, 2, np.int8), np.ones(n, np.int8)])),
                ], names)

    made = texts.select("node", "t").mapInArrow(local, "token bigint, node bigint, total double, shared double, n tinyint")
    # A shingle's list holds one text a task at most: those met twice in a task come as a mark.
    met = made.groupBy((F.col("n") > 0).alias("told"), "token").agg(F.sum("n").alias("s"), F.collect_list(F.when(F.col("n") < 2, F.struct("node", "total", "shared"))).alias("x"))
    each = met.select("told", "s", F.explode("x").alias("x")).select("x.node", F.when(~F.col("told"), F.col("x.total")).otherwise(0.0).alias("total"), F.when(~F.col("told") | (F.col("s") > 1), F.col("x.shared")).otherwise(0.0).alias("shared"))
    return each.groupBy("node").agg(F.sum("total").alias("total"), F.sum("shared").alias("shared"))


def _agreement(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def links(docs: DataFrame, nodes: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between nodes; enough of them to connect all that are connected."""
    members = cut(nodes.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("key")))
    buckets = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("rep")).where("n > 1"))
    samples = nodes.where(F.col("sig").isNotNull()).select("node", "sig")

    def texts_of(needed: DataFrame) -> DataFrame:
        """Rows (node, t) of the nodes needed, which must be distinct."""
        small = needed.count() <= BROADCAST
        wanted = nodes.join(needed, "node").select("node", F.coalesce("d", F.lit(-(2**63))).alias("d"), "m")
        keyed = docs.select(F.coalesce("d", F.lit(-(2**63))).alias("d"), "m", "t")
        return keyed.join(F.broadcast(wanted) if small else wanted, ["d", "m"]).groupBy("node").agg(F.first("t").alias("t"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        return cut(similarity(both, idf).where(F.col("similarity") >= least - 1e-9).select("a", "b"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), the smaller node first, whose samples agree often enough to be verified."""
        ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        both = ordered.join(samples.toDF("a", "sa"), "a").join(samples.toDF("b", "sb"), "b")
        return both.where(_agreement("sa", "sb") >= AGREE).select("a", "b")

    def open_buckets(edges: DataFrame) -> DataFrame:
        """Rows (key, node, c, minor) of buckets whose texts are in several components: minor ones are outside the largest."""
        parts_of = components(edges)
        placed = cut(members.join(buckets.where("n > 2").select("key"), "key").join(parts_of, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
        sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        return cut(placed.join(sizes, "key").select("key", "node", "c", (F.col("c") != F.col("largest")).alias("minor")))

    # Every text against the first of its bucket.
    tested = cut(likely(members.join(buckets, "key").select(F.col("rep").alias("x"), F.col("node").alias("y"))))
    edges = verified(tested)
    # Then those still apart against one text after another of the bucket's largest component.
    for turn in range(TURNS):
        still = open_buckets(edges)
        pivots = still.where("NOT minor").groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("y"))
        more = cut(likely(still.where("minor").select("key", F.col("node").alias("x")).join(pivots, "key")).join(tested, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        tested, edges = cut(tested.union(more)), cut(edges.union(verified(more)))
    # What is still apart is checked in full: two of the smaller components meet once, each of their texts meets all of the largest.
    # Within a bucket those outside its largest component meet the others block by block; only links come out.
    still = open_buckets(edges)
    texts = cut(texts_of(still.select("node").distinct()))
    weights = shared_weights(texts, idf).where(F.col("shared") >= (least - 1e-6) * F.col("total"))
    facts = cut(weights.join(samples, "node").join(texts.select("node", F.length("t").alias("chars")), "node"))
    kept = still.join(facts.select("node", "chars"), "node")
    on_side = lambda test: F.ceil(F.greatest(F.count_if(test) / PAIRED, F.sum(F.when(test, F.col("chars"))) / PAIRED_CHARS)).cast("int")
    sizes = kept.groupBy("key").agg(on_side(F.col("minor")).alias("nx"), on_side(F.lit(True)).alias("ny")).where("nx > 0")
    placed = kept.drop("chars").join(sizes, "key").withColumn("h", F.xxhash64("node"))
    mine, other = F.pmod("h", F.col("nx")).cast("int"), F.pmod("h", F.col("ny")).cast("int")
    left = placed.where("minor").select("key", "node", "c", "minor", F.lit(True).alias("left"), mine.alias("x"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    right = placed.select("key", "node", "c", "minor", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), other.alias("y"))
    fields = "key bigint, x int, y int, node bigint, c bigint, minor boolean, left boolean, total double, shared double, sig array<int>"
    blocks = left.unionByName(right).join(facts.drop("chars"), "node").select(*[f.split()[0] for f in fields.split(", ")])
    open_blocks = cut(blocks.groupBy("key", "x", "y").applyInArrow(lambda table: _block_candidates(table, least), fields))
    found = open_blocks.join(texts, "node").groupBy("key", "x", "y").applyInArrow(lambda table: _block_links(table, idf.value, least), "a bigint, b bigint").distinct()
    return edges.union(cut(found))


def _may_be_alike(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The left and the right rows of a block, and which of their pairs components, bound and samples leave."""
    node, part, minor, left, total, shared = (table.column(c).to_numpy() for c in ("node", "c", "minor", "left", "total", "shared"))
    sig = np.array(table.column("sig").combine_chunks().flatten()).reshape(len(node), HASHES)
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    both = np.minimum(shared[x][:, None], shared[y][None])
    may = (part[x][:, None] != part[y][None]) & (~minor[y][None] | (node[x][:, None] < node[y][None])) & (both >= (least - 1e-6) * (total[x][:, None] + total[y][None] - both))
    if may.any():
        agree = np.zeros(may.shape, np.int8)
        for k in range(HASHES):
            agree += sig[x, k][:, None] == sig[y, k][None]
        may &= agree >= AGREE
    return x, y, may


def _block_candidates(table: pa.Table, least: float) -> pa.Table:
    """The rows of a block that may be alike to one of the other side."""
    x, y, may = _may_be_alike(table, least)
    return table.take(pa.array(np.append(x[may.any(axis=1)], y[may.any(axis=0)])))


def _block_links(table: pa.Table, idf: np.ndarray, least: float) -> pa.Table:
    """Links between the left and the right texts of a block: by components, bound and samples first, then exactly."""
    x, y, may = _may_be_alike(table, least)
    node = table.column("node").to_numpy()
    a, b = [], []
    if may.any():
        data, starts = utf8(table.column("t").combine_chunks())
        row, token, weight = weighted(data[starts[0] : starts[-1]], starts - starts[0], idf)
        first = np.searchsorted(row, np.arange(len(node) + 1))
        sums = np.bincount(row, weight, len(node))
        for i in np.flatnonzero(may.any(axis=1)):
            mine, w = token[first[x[i]] : first[x[i] + 1]], weight[first[x[i]] : first[x[i] + 1]]
            for j in np.flatnonzero(may[i]):
                its, v = token[first[y[j]] : first[y[j] + 1]], weight[first[y[j]] : first[y[j] + 1]]
                at = np.minimum(np.searchsorted(mine, its), len(mine) - 1)
                same = mine[at] == its
                common = np.minimum(w[at[same]], v[same]).sum()
                if common >= (least - 1e-9) * (sums[x[i]] + sums[y[j]] - common):
                    a.append(min(node[x[i]], node[y[j]]))
                    b.append(max(node[x[i]], node[y[j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row (id_col, class_id, class_size, digest, class_key): the smallest id of its class, the class's rows, the text's md5, and a number of its own for each class, since a repeated id can be the smallest of two."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("d"), F.md5(text).alias("m"), text.alias("t"))
    table, _ = frequencies(docs)
    idf = df.sparkSession.sparkContext.broadcast(table)  # 2**20 numbers, whatever the corpus
    signed = staged(signatures(docs, idf))
    # One node for each distinct text; its number is fixed by writing it.
    nodes = staged(signed.groupBy("m").agg(F.min("d").alias("d"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    found = components(links(docs, nodes, idf, least))
    labelled = nodes.select("m", "node").join(found, "node", "left").select("m", F.coalesce("component", "node").alias("c"))
    rows = cut(signed.select("d", "m").join(labelled, "m"))
    ids = rows.groupBy("c").agg(F.min("d").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(ids, "c").select(F.col("d").cast(df.schema[id_col].dataType).alias(id_col), "class_id", "class_size", F.col("m").alias("digest"), F.col("c").alias("class_key"))
