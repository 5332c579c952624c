"""Byte-level BPE by backtracking: longest matches, checked pair by pair, give the exact merges in linear time.

encode() and decode() work on whole texts. A text is cut at the special tokens' strings, then by the vocabulary's
pattern; each piece is encoded on its own. In a piece, the longest token that starts at a position is looked up in an
Aho-Corasick automaton. It is taken if the pair of the previous token and it is one that the merges would leave
as it stands; else shorter prefixes are tried, and if none fits, the previous token is given back. A bit for each
position keeps a dead end from being entered twice.

Null texts count as empty: no ids. Every row gives one row; repeated rows and ids are kept. Columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import carried, kept, tidy

#: How byte-level BPE vocabularies cut text into pieces (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; beyond this it starts afresh.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary, given as the JSON text of a tokenizers file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        cut = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True) or spec.get("normalizer"):
            raise ValueError("this encoder needs a byte-level BPE vocabulary that cuts texts by the byte-level pattern, without prefix space or normalizer")
        letters, model = byte_letters(), spec["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        tokens = [b""] * size
        for token, i in model["vocab"].items():
            tokens[i] = raw(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            tokens[i] = content.encode()
        ids = {raw(token): i for token, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a merge by its pair, and, by token, the pair it is made of and the rank of that merge.
        self.ranks: dict[tuple[int, int], int] = {}
        self.halves = [(i, i, -1) for i in range(size)]
        for rank, (left, right) in enumerate(merges):
            a, b = model["vocab"][left], model["vocab"][right]
            self.ranks.setdefault((a, b), rank)
            made = model["vocab"][left + right]
            if self.halves[made][2] < 0:
                self.halves[made] = (a, b, rank)
        self.width = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: By token, the longest token that is a proper prefix of it, or -1.
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.pieces = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right side by side: no merge across their border would have come first."""
        key = (left, right)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, again and again: at each step the two that face each other
        # at the border must not be a pair whose merge comes before the one just undone.
        until = len(self.ranks)
        while True:
            if self.ranks.get((left, right), until) < until:
                return False
            of_left, of_right = self.halves[left], self.halves[right]
            if of_left[2] > of_right[2]:
                left, until = of_left[1], of_left[2]
            elif of_right[2] >= 0:
                # Of equal pairs the left one merges first, so at the rank of the right token the border still wins.
                right, until = of_right[0], of_right[2] + 1
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given with one letter a byte."""
        longest, shorter, width = self.automaton.iter_long, self.shorter, self.width
        out: list[int] = []
        at, n, open_at = 0, len(text), bytearray(b"\1") * (len(text) + 1)
        token = next(longest(text, 0))[1] if n else -1
        while at < n:
            while token >= 0:
                end = at + width[token]
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = next(longest(text, at))[1] if at < n else -1
                    break
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= width[token]
                token = shorter[token]
        return out

    def coded(self, piece: str) -> tuple[bytes, str]:
        """Ids of a piece as 32-bit integers, and in decimal."""
        if (found := self.known.get(piece)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.piece(piece.encode().decode("latin-1"))
            found = np.array(ids, np.int32).tobytes(), ",".join(map(str, ids))
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def codes(self, text: str) -> list[tuple[bytes, str]]:
        """coded() of every piece of a whole text."""
        if self.split is None or not self.split.search(text):
            return list(map(self.coded, self.pieces.findall(text)))
        out: list[tuple[bytes, str]] = []
        for k, run in enumerate(self.split.split(text)):
            if k % 2:
                out.append((np.array([self.special[run]], np.int32).tobytes(), str(self.special[run])))
            else:
                out += map(self.coded, self.pieces.findall(run))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(c[0] for c in self.codes(text)), np.int32).tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one buffer by the offset table."""
        start, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(length) - length
        return self.data[np.arange(int(length.sum())) + np.repeat(start - before, length)].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def _worker(key: int, spec) -> Bpe:
    """The vocabulary's tables, built once in each worker."""
    loaded = kept("bpe")
    if key not in loaded:
        loaded.clear()
        loaded[key] = Bpe(spec.value)
    return loaded[key]


def _spec(df: DataFrame, vocabulary: str):
    """The vocabulary file (a few MB, whatever the data) goes to the executors by broadcast, as they may not have it."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    return hash(spec), df.sparkSession.sparkContext.broadcast(spec)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Rows (id_col, ids array of int) with the ids of each whole text; with check, lossless: they decode to the text."""
    key, spec = _spec(df, vocabulary)
    src, texts_of = carried(df, id_col, text_col)
    names = [id_col, "ids", *["lossless"] * check]

    @tidy("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(key, spec)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t or "" for t in texts_of(part).to_pylist()]
                ids = [np.frombuffer(b"".join([c[0] for c in bpe.codes(t)]), np.int32) for t in texts]
                columns = [part[0], pa.array(ids, pa.list_(pa.int32()))]
                if check:
                    columns.append(pa.array([bpe.decode_bytes(i.astype(np.int64)) == t.encode() for i, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.known.clear()  # workers live on, and other stages need the memory

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>{', lossless boolean' if check else ''}")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, text) with the text of each list of ids; null lists give empty texts."""
    key, spec = _spec(df, vocabulary)
    src = df.select(id_col, ids_col)
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, text string"

    @tidy("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(key, spec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([bpe.decode(ids or []) for ids in batch[1].to_pylist()], pa.string())], [id_col, "text"])

    return src.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids again, and digest both: (id_col, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. Neither ids nor
    texts leave the task, so nothing is shuffled.
    """
    key, spec = _spec(df, vocabulary)
    src = df.select(id_col, text_col)
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    sha = hashlib.sha256

    @tidy("bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(key, spec)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch[1]:
                codes = bpe.codes(value.as_py() or "")
                ids = np.frombuffer(b"".join([c[0] for c in codes]), np.int32).astype(np.int64)
                counts.append(len(ids))
                ids_sha.append(sha(",".join([c[1] for c in codes]).encode()).hexdigest())
                text_sha.append(sha(bpe.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, schema)
