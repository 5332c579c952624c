"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns a clause's words into classes: insult, threat, target, agent, negation, report, other. Its insult arcs
are words and word beginnings with weights learned from labels, beside a few fixed ones; the other classes are fixed lists. Three
transducers are composed with it: negation marks what follows a negating word within three words, reported speech marks what
follows a verb of saying or stands in quotes, and the last one matches clauses. An insult matches as `targeted` if a target stands before or after it in its
clause, or if the clause is nothing but insults (an address: "Idiot!"); a threat matches if its target follows, or if
agent and target stand before it. Two or more insults in one clause that nothing licenses match as `piled` ("that idiot, a clown"). A last
transducer runs over a document's clauses: a clause with one insult that nothing licenses matches as `tirade` if an earlier clause
held such an insult or several; else it is `loose`, which weighs nothing and which no label can give a weight. "The word" and the like tell of
a word, as verbs of saying do. A threat without a target gives nothing. The logarithms of a document's sums by kind are the inputs of a
logistic score.

Training takes about SAMPLE labelled rows outside the held-out fold, by a hash of the id. The arcs come from two thirds of
them, the weights from the rest. Documents that share rare word triples (copies, near copies) count as one. An arc
must be more frequent in toxic documents than chance allows over all arcs tried; the beginning of words is an arc only if DIFFERENT words of
toxic documents alone begin with it and no word of the background vocabularies does. What labels say nothing of keeps its score: each
kind counts HOLD made-up documents with one match and the score of the fixed weights. Labels for unknown ids and null labels
are ignored; several labels of one id count as the highest. Null and empty texts match nothing and get the score of such
texts. Without labels the fixed arcs and weights remain. Each document row gives one row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import PART_BYTES, Rolling, cut, fold

#: Labelled rows to learn from, about.
SAMPLE = 9_000
#: Letters of a word beginning that may be an arc, and the chance of one false arc among all.
BEGINNINGS, CHANCE = range(5, 9), 0.02
#: So many different words must carry a beginning.
DIFFERENT = 3
NEGATED_WORDS = 3
#: Fixed lists of the grammar.
INSULTS = "idiot moron stupid loser scum pathetic worthless disgusting trash clown imbecile dumbass idiota estúpido idiote stupide dummkopf abschaum".split()
THREATS = "kill hurt destroy beat stab shoot burn töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they him her them du dich dein ihr euch tu te toi vous tú usted vosotros ustedes".split()
AGENTS = "i we someone ich wir je nous yo nosotros".split()
NEGATIONS = "not no never isn't aren't don't nobody nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says called wrote quoted claimed reported word words term sagte nannte schrieb wort dit appela écrit mot dijo llamó escribió palabra".split()
QUOTES, CLAUSE_ENDS, APOSTROPHES = "\"“”„«»", ".!?;\n。！？；…", "'’"
FIXED_WEIGHT = 2.0

KINDS = ("loose", "targeted", "negated", "reported", "threat", "softened", "piled", "tirade")
#: Weights before training: the constant, then one a kind; loose insults have none, before and after. And how many made-up documents hold to the others.
PRIOR = np.array([-3.0, 0.0, 3.6, 0.5, 0.5, 3.6, 0.0, 3.0, 3.0])
HOLD, RIDGE = 10.0, 0.01


def words_of(pieces: str, words: str) -> set[str]:
    """The background: pieces of letters of a sentencepiece model and the words of a tokenizers file with word ends, in lower case."""
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    with open(words, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    found = {model.id_to_piece(k).removeprefix("▁").lower() for k in range(model.get_piece_size())} | {w.removesuffix("</w>").lower() for w in vocabulary}
    return {w for w in found if w.isalpha()}


class Transducer:
    """Deterministic: by state and input label, the next state and the output label. Other labels pass unchanged."""

    def __init__(self, arcs: dict[tuple, tuple], start):
        self.arcs, self.start = arcs, start

    def step(self, state, label: str) -> tuple:
        return self.arcs.get((state, label), (state, label))

    def compose(self, then: Transducer, labels: tuple[str, ...]) -> Transducer:
        """The transducer that feeds this one's output to the other, over the states that labels can reach."""
        start, arcs = (self.start, then.start), {}
        todo = [start]
        seen = {start}
        while todo:
            a, b = todo.pop()
            for label in labels:
                a2, middle = self.step(a, label)
                b2, out = then.step(b, middle)
                arcs[(a, b), label] = ((a2, b2), out)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(arcs, start)


LABELS = ("other", "insult", "threat", "target", "agent", "negation", "report", "quote", "end")


def _matching(state: tuple, label: str) -> tuple:
    """A step of the clause matcher. State: only insults so far, agent seen, target seen, insults waiting (2: several), threat waiting."""
    bare, agent, target, insult, threat = state
    if label == "end":
        return (True, False, False, 0, False), ("targeted" if target or bare else "piled" if insult > 1 else "loose") if insult else "other"
    out, bare = "other", bare and label == "insult"
    if label == "insult":
        out, insult = ("targeted", insult) if target else ("other", min(2, insult + 1))
    elif label == "target":
        out, insult, threat, target = ("threat", insult, False, True) if threat else ("targeted" if insult else "other", 0, False, True)
    elif label == "threat":
        out, threat = ("threat", False) if agent and target else ("other", True)
    elif label == "agent":
        agent = True
    elif label in KINDS:
        out = label
    return (bare, agent, target, insult, threat), out


def grammar() -> Transducer:
    """Negation, then reported speech, then the clause matcher, as one transducer; its outputs that matter are KINDS."""
    negation = {(k, "negation"): (NEGATED_WORDS, "other") for k in range(NEGATED_WORDS + 1)} | {(k, "end"): (0, "end") for k in range(1, NEGATED_WORDS + 1)}
    for k in range(1, NEGATED_WORDS + 1):
        negation |= {(k, x): (k - 1, x) for x in ("other", "target", "agent", "report", "quote")}
        negation |= {(k, "insult"): (k - 1, "negated"), (k, "threat"): (k - 1, "softened")}
    reported = {(0, "report"): (1, "other"), (0, "quote"): (2, "other"), (1, "quote"): (2, "other"), (2, "quote"): (0, "other"), (1, "end"): (0, "end"), (2, "end"): (0, "end")}
    for k in (1, 2):
        reported |= {(k, "insult"): (k, "reported"), (k, "negated"): (k, "reported"), (k, "threat"): (k, "softened")}
    start = (True, False, False, 0, False)
    matching, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for label in (*LABELS, *KINDS):
            matching[state, label] = _matching(state, label)
            if (then := matching[state, label][0]) not in seen:
                seen.add(then)
                todo.append(then)
    return Transducer(negation, 0).compose(Transducer(reported, 0), LABELS).compose(Transducer(matching, start), LABELS)


def tirade() -> Transducer:
    """Over the clauses of a document: an insult that nothing licenses, after an earlier clause with one, is part of a tirade."""
    return Transducer({(0, "loose"): (1, "loose"), (0, "piled"): (1, "piled"), (1, "loose"): (1, "tirade")}, 0)


#: What a sign is: 1 a letter, 2 a quote, 3 the end of a clause, 4 an apostrophe, which belongs to a word between letters; by code point.
_SIGNS: list[np.ndarray] = []


def _signs() -> np.ndarray:
    if not _SIGNS:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        for value, signs in ((2, QUOTES), (3, CLAUSE_ENDS), (4, APOSTROPHES)):
            table[[ord(c) for c in signs]] = value
        _SIGNS.append(table)
    return _SIGNS[0]


class Tokens:
    """The words, quotes and clause ends of a run of texts in lower case, by code point. The only tokeniser here: learning, search and grammar share it."""

    def __init__(self, texts: list[str]):
        # Every text is a clause of its own at least.
        self.text = "\n" + "".join(t.lower() + "\n" for t in texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "replace"), np.uint32)
        kind = _signs()[self.points]
        letter = kind == 1
        inside = letter.copy()
        inside[1:-1] |= (kind[1:-1] == 4) & letter[:-2] & letter[2:]
        self.begin, self.stop = np.flatnonzero(~inside[:-1] & inside[1:]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.quotes, self.ends = np.flatnonzero(kind == 2), np.flatnonzero(kind == 3)
        self.starts = np.cumsum([1, *(len(t.lower()) + 1 for t in texts)])

    def word(self, k: int) -> str:
        return self.text[self.begin[k] : self.stop[k]]


class Lexicon:
    """Insult arcs with their weights: '=word' is a whole word, '^begin' a beginning. A word takes its heaviest arc; "idiot's" counts as "idiot"."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs = arcs | {"=" + w: max(FIXED_WEIGHT, arcs.get("=" + w, 0)) for w in INSULTS}
        self.fixed = {w: label for label, words in (("threat", THREATS), ("target", TARGETS), ("agent", AGENTS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.lengths = sorted({len(a) - 1 for a in self.arcs if a[0] == "^"})
        self.tables = {}
        for n in (0, *self.lengths):
            texts = [a[1:] for a in self.arcs if (a[0] == "=" if not n else a[0] == "^" and len(a) == n + 1)] + [w for w in THREATS if not n]
            ends = np.cumsum([0, *map(len, texts)])
            self.tables[n] = np.sort(Rolling(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)).ranges(ends[:-1], ends[1:]))
        self.rules, self.document = grammar(), tirade()

    def weight(self, word: str) -> float:
        found = [self.arcs.get("=" + word, 0.0), *(self.arcs.get("^" + word[:n], 0.0) for n in self.lengths if len(word) >= n)]
        return max(found)

    def label(self, word: str) -> tuple[str, float]:
        """A word's class and weight; before an apostrophe, if the whole word has none."""
        word = word.replace("’", "'")
        for w in dict.fromkeys((word, word.split("'")[0])):
            if w in self.fixed:
                return self.fixed[w], FIXED_WEIGHT
            if (weight := self.weight(w)) > 0:
                return "insult", weight
        return "other", 0.0

    def candidates(self, t: Tokens) -> np.ndarray:
        """Words that may match an insult or threat arc, by number."""
        rolling = Rolling(t.points)
        # A word with an apostrophe is looked up by what stands before it, as the whole words of the arcs have none.
        marks = np.flatnonzero(np.isin(t.points, [ord(c) for c in APOSTROPHES]))
        first = np.append(marks, len(t.points))[np.searchsorted(marks, t.begin)]
        stop = np.minimum(t.stop, first)
        hit = np.isin(rolling.ranges(t.begin, stop), self.tables[0])
        for n in self.lengths:
            long = np.flatnonzero(t.begin + n <= stop)
            hit[long] |= np.isin(rolling.ranges(t.begin[long], t.begin[long] + n), self.tables[n])
        return np.flatnonzero(hit)

    def clause(self, labels: list[tuple[str, float]], sums: np.ndarray, before: int) -> int:
        """Run the grammar over one clause's labels with their weights and add the weight of each match to sums, by kind.

        before is the state of the document's transducer; the state after this clause is returned.
        """
        state, insults, threats = self.rules.start, 0.0, 0.0
        for label, weight in (*labels, ("end", 0.0)):
            state, out = self.rules.step(state, label)
            insults += weight * (label == "insult" and out == "other")  # waits for its target
            if label == "threat":
                threats = weight
            if out == "threat":
                sums[KINDS.index(out)] += threats
            elif out in ("loose", "piled", "targeted") and label != "insult":
                before, out = self.document.step(before, out)
                sums[KINDS.index(out)] += insults
                insults = 0.0
            elif out in KINDS:
                sums[KINDS.index(out)] += weight
        return before

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text, the logarithm of 1 + its matches' weight, by kind."""
        out = np.zeros((len(column), len(KINDS)))
        texts = pc.fill_null(column, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
            t = Tokens(texts.slice(at, end - at).to_pylist())
            found = self.candidates(t)
            closing = np.searchsorted(t.ends, t.begin[found])  # the clause between two ends
            last, state = -1, self.document.start
            for k in np.unique(closing):
                low, high = t.ends[k - 1], t.ends[k]
                words = [(int(t.begin[w]), *self.label(t.word(w))) for w in range(*np.searchsorted(t.begin, (low, high)))]
                quotes = [(int(q), "quote", 0.0) for q in t.quotes[slice(*np.searchsorted(t.quotes, (low, high)))]]
                row = int(np.searchsorted(t.starts, low + 1, "right")) - 1
                state = self.clause([x[1:] for x in sorted(words + quotes)], out[at + row], state if row == last else self.document.start)
                last = row
            at = end
        return np.log1p(out)


def _arcs(text: str) -> set[str]:
    """Every word of a text and its beginnings."""
    t = Tokens([text])
    words = {w.replace("’", "'").split("'")[0] for w in map(t.word, range(len(t.begin)))}
    return {"=" + w for w in words} | {"^" + w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def _alike(text: str) -> list[int]:
    """Three smallest hashes of word triples: near copies share one at least."""
    words = re.findall(r"\w+", text.lower())
    triples = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh64_intdigest(t, seed) for t in triples) - 2**63 for seed in (1, 2, 3)]


def learn_arcs(rows: DataFrame, background: Iterable[str] = ()) -> dict[str, float]:
    """Weighted insult arcs from rows (t, y, w): text, label, and the weight that copies leave it. No word of background begins with a beginning's arc."""
    totals = rows.groupBy("y").agg(F.sum("w").alias("w")).collect()
    size = {int(r.y): r.w for r in totals}
    if not size.get(1) or not size.get(0):
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, y, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a in _arcs(text):
                    (toxic if y else clean)[a] += w
        arcs = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict({"a": pa.array(arcs, pa.string()), "p": pa.array([toxic[a] for a in arcs], pa.float64()), "q": pa.array([clean[a] for a in arcs], pa.float64())})

    counts = cut(rows.select("t", "y", "w").mapInArrow(run, "a string, p double, q double").groupBy("a").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 0"))
    words = counts.where("q = 0 AND a LIKE '=%'").select(F.substr("a", F.lit(2)).alias("w")).where(F.length("w") > BEGINNINGS[0])
    carried = words.select(F.explode(F.transform(F.sequence(F.lit(BEGINNINGS[0]), F.least(F.lit(BEGINNINGS[-1]), F.length("w") - 1)), lambda n: F.concat(F.lit("^"), F.substr("w", F.lit(1), n)))).alias("a"))
    carried = carried.groupBy("a").agg(F.count("*").alias("words"))
    counts = counts.where("p >= 3")
    share, tried = size[1] / (size[0] + size[1]), max(1, counts.count())
    rate = F.col("p") / (F.col("p") + F.col("q"))
    # Chernoff's bound on so high a share of toxic documents by chance.
    gain = (F.col("p") + F.col("q")) * (rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    counts = counts.join(carried, "a", "left").where((F.col("words") >= DIFFERENT) | F.col("a").startswith("="))
    kept = counts.where((rate >= 0.8) & (gain > float(np.log(tried / CHANCE)))).select("a", F.log(((F.col("p") + 0.5) / size[1]) / ((F.col("q") + 0.5) / size[0])).alias("weight")).collect()
    usual = {w.lower()[:n] for w in background for n in BEGINNINGS if len(w) >= n}
    return {r.a: float(r.weight) for r in kept if r.a[0] == "=" or r.a[1:] not in usual}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with step halving. Made-up documents of one match each hold to PRIOR; loose insults stay without weight."""
    made = np.eye(len(KINDS)) * np.log1p(FIXED_WEIGHT)
    w = np.concatenate([w, np.full(len(KINDS), HOLD)])
    y = np.concatenate([y, 1 / (1 + np.exp(-(PRIOR[0] + made @ PRIOR[1:])))])
    x, hold = np.vstack([x, made]), np.full(len(PRIOR), RIDGE)
    x[:, KINDS.index("loose")] = 0.0
    w[len(w) - len(KINDS) + KINDS.index("loose")] = 0.0
    x, beta = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (hold * (b - PRIOR) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (w * (y - p)) - hold * (beta - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return beta


def train(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, background: Iterable[str] = ()) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from about sample of the labelled rows for which learn (of the id) holds."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")).where(learn)
    draw = F.pmod(F.xxhash64("i", F.lit(8)), F.lit(1_000_000)) / 1e6
    drawn = marks.where(draw < min(1.0, sample / max(1, marks.count())))
    rows = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(drawn), "i")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [_alike(t) for t in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in m], pa.int64()) for k in range(3))], ["t", "y", "part", "m0", "m1", "m2"])

    # The sample is bounded, so a group in it is as well.
    rows = rows.select("t", "y", F.pmod(F.xxhash64("t"), F.lit(3)).alias("part")).mapInArrow(mark, "t string, y int, part bigint, m0 bigint, m1 bigint, m2 bigint")
    many = [F.count("*").over(Window.partitionBy(f"m{k}")) for k in range(3)]
    rows = cut(rows.repartition(12).withColumn("w", 1.0 / F.greatest(*many)).select("t", "y", "part", "w").repartition(12))
    lexicon = Lexicon(learn_arcs(rows.where("part > 0"), background))
    shared = df.sparkSession.sparkContext.broadcast(lexicon.arcs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(lexicon.features(batch[0]).tolist(), pa.list_(pa.float64())), batch[1], batch[2]], ["f", "y", "w"])

    got = rows.where("part = 0").select("t", "y", "w").mapInArrow(features, "f array<double>, y int, w double").collect()
    if not got:
        return lexicon, PRIOR
    return lexicon, _logistic(np.array([r.f for r in got]), np.array([r.y for r in got], float), np.array([r.w for r in got]))


def score(df: DataFrame, lexicon: Lexicon, beta: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score, matches): the logistic score and the features by kind, for every row."""
    src = df.select(id_col, text_col)
    # As many arcs as the bounded sample can support.
    shared = df.sparkSession.sparkContext.broadcast((lexicon.arcs, beta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, beta = shared.value
        lexicon = Lexicon(arcs)
        for batch in batches:
            f = lexicon.features(batch[1])
            p = 1 / (1 + np.exp(-(beta[0] + f @ beta[1:])))
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(p), pa.array(f.tolist(), pa.list_(pa.float64()))], [id_col, "score", "matches"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double, matches array<double>")


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, threshold: float = 0.7, background: Iterable[str] = ()) -> DataFrame:
    """Train outside one fold and score every row: (id_col, held_out, score, predicted)."""
    lexicon, beta = train(df, labels, fold(F.col("i"), folds) != held, id_col, text_col, background=background)
    return score(df, lexicon, beta, id_col, text_col).select(id_col, (fold(F.col(id_col), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
