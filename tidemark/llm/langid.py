"""Language ID by unigram pieces, summed over all segmentations.

A language gives each piece of a fixed public vocabulary a probability. A word (a whole run of letters, in lower case, after
the vocabulary's word mark, however long) has as probability the sum over all ways to cut it into pieces, found by the forward
algorithm, for long words on logarithms; a text has the product of its words'. Training is expectation-maximisation: the expected piece counts of
every distinct training word are summed by Spark, so what reaches the driver is one number a piece and language.

The sample for training holds about PER_LANGUAGE documents a language, taken by a hash of the id, whatever the size of
the corpus. Null languages, null and empty texts aren't learned from. A text that is null or has no letter is `und`
with score 0, and so is every text if nothing can be learned. Ties go to the language that sorts first. Each row gives
one row; repeated rows and ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carried, fold, staged, tidy

#: Training documents of a language, about.
PER_LANGUAGE = 1000
#: Rounds of expectation-maximisation, and count added to each piece.
ROUNDS, ADDED = 3, 0.05
#: Words whose probabilities a worker remembers, letters of them, and bytes of text handled at once.
CACHE, CACHED_LETTERS, CHUNK = 120_000, 8_000_000, 1 << 20
#: Letters up to which a word's sums can't underflow, and letters of equally long words handled at once.
SHORT, AT_ONCE = 32, 1 << 18
LETTERS = regex.compile(r"\p{L}+")
#: The word mark of the vocabulary (fixed value).
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(model: bytes) -> list[str]:
    """The vocabulary's pieces of letters, in lower case, with or without the word mark."""
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = {vocabulary.id_to_piece(i).lower() for i in range(vocabulary.get_piece_size())}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix(MARK) or "a"))


def _hash(points: np.ndarray) -> np.ndarray:
    out = np.zeros(points.shape[:-1], np.uint64)
    for k in range(points.shape[-1]):
        out = (out + points[..., k].astype(np.uint64) + np.uint64(1)) * _STEP
    return out


class Pieces:
    """Finds which pieces start at which letters of many words at once. Any other single letter is the unknown piece."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.array([int(_hash(np.array([[ord(c) for c in p]], np.uint32))[0]) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    def words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words of equal length, their indices and their letters."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, every in by_length.items():
            step = max(1, AT_ONCE // length)
            for k in range(0, len(every), step):
                rows = every[k : k + step]
                yield np.array(rows), np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)

    def arcs(self, points: np.ndarray) -> list[np.ndarray]:
        """By length less one, the piece of that length that each word has at each start, or -1."""
        length, found = points.shape[1], []
        letters = points.astype(np.uint64) + np.uint64(1)
        key = np.zeros(points.shape, np.uint64)
        for size in range(1, min(length, self.longest) + 1):
            key = (key[:, : length - size + 1] + letters[:, size - 1 :]) * _STEP
            if self.n:
                at = np.minimum(np.searchsorted(self.hashes, key), self.n - 1)
                ids = np.where(self.hashes[at] == key, self.ids[at], np.int32(-1))
            else:
                ids = np.full(key.shape, -1, np.int32)
            found.append(np.where(ids < 0, np.int32(self.n), ids) if size == 1 else ids)
        return found

    @staticmethod
    def _steps(arcs: list[np.ndarray], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, pieces of the words there) in the order of ends, where any word has one."""
        some = [(ids >= 0).any(axis=0) for ids in arcs]
        for end in range(1, length + 1):
            for size in range(1, min(end, len(arcs)) + 1):
                if some[size - 1][end - size]:
                    yield end - size, end, arcs[size - 1][:, end - size]

    def forward(self, points: np.ndarray, p: np.ndarray, arcs: list[np.ndarray] | None = None) -> np.ndarray:
        """Logarithm of the summed probability of every prefix of each word: [end, word, language]. p: [piece, language], zeros last."""
        n, length = points.shape
        logs = length > SHORT
        sums = np.full((length + 1, n, p.shape[1]), -np.inf if logs else 0.0)
        sums[0] = 0 if logs else 1
        with np.errstate(divide="ignore"):
            weight = np.log(p) if logs else p
            for start, end, ids in self._steps(arcs or self.arcs(points), length):
                if logs:
                    np.logaddexp(sums[end], sums[start] + weight[ids], out=sums[end])
                else:
                    sums[end] += sums[start] * weight[ids]
            return sums if logs else np.log(sums)

    def expected(self, points: np.ndarray, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected count of each piece in words that occur weights times, under one language's p."""
        arcs, length = self.arcs(points), points.shape[1]
        ahead = self.forward(points, p[:, None], arcs)[:, :, 0]
        behind, out = np.full(ahead.shape, -np.inf), np.zeros(self.n + 2)
        behind[length] = 0
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        for start, end, ids in reversed(list(self._steps(arcs, length))):
            through = log_p[ids] + behind[end]
            np.logaddexp(behind[start], through, out=behind[start])
            out += np.bincount(ids + 1, np.exp(ahead[start] + through - ahead[length]) * weights, len(out))
        return out[1:]


def _words(text: str) -> list[str]:
    """The words of a text with the word mark."""
    return [MARK + w for w in LETTERS.findall(text.lower())]


class Model:
    """Learned piece probabilities; predict() remembers the words it has met."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = Pieces(pieces), languages, np.vstack([p, np.zeros(p.shape[1])])
        self.forget()

    def forget(self) -> None:
        """Give the remembered words' memory back."""
        self.known: dict[str, int] = {}
        self.table, self.letters = np.zeros((0, len(self.languages))), 0

    def learn(self, words: list[str]) -> None:
        found = np.empty((len(words), len(self.languages)))
        for rows, points in self.pieces.words(words):
            found[rows] = self.pieces.forward(points, self.p)[-1]
        self.known |= {w: len(self.table) + i for i, w in enumerate(words)}
        self.table = np.vstack([self.table, found])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [_words(t or "") for t in texts]
        everything = set().union(*cut)
        new = list(everything.difference(self.known))
        self.letters += sum(map(len, new))
        if len(self.known) + len(new) > CACHE or self.letters > CACHED_LETTERS:
            self.forget()
            new = list(everything)
        if new and self.languages:
            self.learn(new)
        names, scores = [], []
        for words in cut:
            if not words or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
            odds = np.exp(total - total.max())
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return names, scores


def train(df: DataFrame, vocabulary: str, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about per_language of the rows of each language for which learn holds."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as file:
        pieces = pieces_of(file.read())
    rows = df.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros((1, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = rows.where((F.pmod(F.xxhash64("i"), F.lit(1_000_000)) / 1e6) < share[F.col("l")])

    @tidy("langid")
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                counts.update((lang, w) for w in _words(text))
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"l": pa.array([k[0] for k in keys], pa.string()), "w": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    counted = staged(drawn.select("t", "l").mapInArrow(words, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n")))
    p = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast((pieces, languages, p))

        @tidy("langid")
        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces, languages, p = now.value
            finder, rows = Pieces(pieces), np.vstack([p, np.zeros(p.shape[1])])
            sums = np.zeros(p.shape)
            for batch in batches:
                of, w, n = np.array(batch[0].to_pylist(), object), batch[1].to_pylist(), batch[2].to_numpy().astype(float)
                for k, lang in enumerate(languages):
                    mine = np.flatnonzero(of == lang)
                    for at, points in finder.words([w[i] for i in mine]):
                        sums[:, k] += finder.expected(points, n[mine[at]], rows[:, k])
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece.astype(np.int32)), "lang": pa.array(lang.astype(np.int32)), "n": pa.array(sums[piece, lang])})

        sums = np.zeros(p.shape)
        for r in counted.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            sums[r.piece, r.lang] = r.n
        p = (sums + ADDED) / (sums + ADDED).sum(0)
        now.unpersist()
    return Model(pieces, languages, p)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred, score): the likeliest language of each whole text and its share of the likelihoods."""
    src, texts_of = carried(df, id_col, text_col)
    # The model has one number a piece and language, whatever the size of the corpus.
    shared = df.sparkSession.sparkContext.broadcast(model)

    @tidy("langid")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = texts_of(batch)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(sizes, before + CHUNK, "right"))))
                names, scores = model.predict(texts.slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_arrays([batch[0].slice(at, end - at), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])
                at = end
        model.forget()  # workers live on, and other stages need the memory

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double")


def predictions(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Train on all folds but one and predict every row: (id_col, held_out, lang_pred, score)."""
    model = train(df, vocabulary, fold(F.col(id_col), folds) != held, text_col, lang_col, id_col)
    return predict(df, model, id_col, text_col).select(id_col, (fold(F.col(id_col), folds) == held).alias("held_out"), "lang_pred", "score")
