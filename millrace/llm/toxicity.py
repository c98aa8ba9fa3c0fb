"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause as symbols (insult, threat, target, negation, report, quote,
other): insult, threat, target, negation and reported speech. Their composition reads the clause
once and tells each insult or threat as plain, targeted, negated or reported. The insult lexicon
(words and word beginnings) and the weights of these readings are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, id_crc, slices, steps, stored, texts

#: Labelled documents of each class that the lexicon and the weights are learned from, at most.
SAMPLE_DOCS = 4000

# Words of the grammar's closed classes, in five languages.
SEEDS = {"idiot", "moron", "scum", "stupid"}
THREATS = {"annihilate", "destroy", "hang", "hurt", "kill", "murder", "shoot", "stab", "strangle", "töten", "tuer", "matar"}
TARGETS = {"he", "her", "him", "she", "them", "they", "those", "you", "your", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "elles", "usted", "ustedes", "ellos", "ellas"}
NEGATIONS = {"no", "not", "never", "neither", "nor", "hardly", "don't", "isn't", "aren't", "kein", "keine", "nicht", "nie", "ne", "pas", "jamais", "nunca", "tampoco"}
REPORTS = {"alleged", "called", "claimed", "quoted", "reported", "said", "says", "stated", "told", "wrote", "sagte", "dit", "dijo"}
QUOTES = set("\"“”«»„")

READINGS = ("plain", "targeted", "negated", "reported", "threat")
#: Weights before any row is seen, and how many rows they stand for.
PRIOR, PRIOR_ROWS = np.array([3.0, 4.0, 1.0, 1.0, 3.0]), 1.0
BIAS = -3.0

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"\w+(?:'\w+)?|[\"“”«»„]")
_LETTERS = re.compile(r"[^\W\d_]{3,}")


class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and the tags put out."""

    def __init__(self, start, step, final=lambda state: frozenset()):
        self.start, self.step, self.final = start, step, final

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: both read the symbol, and the tags of both are put out."""

        def step(state, symbol):
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), x | y

        return Transducer((self.start, other.start), step, lambda state: self.final(state[0]) | other.final(state[1]))


_NONE = frozenset()
_tags = lambda *names: frozenset(names)
_event = frozenset("IT")

insult = Transducer(0, lambda s, x: (0, _tags("insult") if x == "I" else _NONE))
threat = Transducer(0, lambda s, x: (0, _tags("threat") if x == "T" else _NONE))
#: A target anywhere in the clause counts for all its events.
target = Transducer(0, lambda s, x: (1 if x == "Y" else s, _NONE), lambda s: _tags("targeted") if s else _NONE)
#: A negation reaches the next three words.
negation = Transducer(0, lambda s, x: (3 if x == "N" else max(0, s - 1), _tags("negated") if s and x in _event else _NONE))
#: A verb of report reaches to the clause's end; a quote mark opens or closes a quotation.
report = Transducer(0, lambda s, x: (1 if x == "R" else 1 - s if x == "Q" else s, _tags("reported") if s and x in _event else _NONE))

GRAMMAR = insult @ threat @ target @ negation @ report


class Lexicon:
    """Words and word beginnings (given with a trailing *) that insult."""

    def __init__(self, entries: list[str]):
        self.entries = sorted(entries)
        self.whole = {e for e in entries if not e.endswith("*")}
        self.begin = {e[:-1] for e in entries if e.endswith("*")}
        self.lengths = sorted({len(e) for e in self.begin})

    def __contains__(self, word: str) -> bool:
        return word in self.whole or any(word[:n] in self.begin for n in self.lengths)


class Grammar:
    """Reads whole texts: how often each reading occurs in their clauses."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.steps = lexicon, {}
        self.automaton = ahocorasick.Automaton()
        for e in {*lexicon.whole, *lexicon.begin, *THREATS}:
            self.automaton.add_word(e, len(e))
        self.automaton.make_automaton()

    def symbol(self, word: str) -> str:
        if word in QUOTES:
            return "Q"
        if word in self.lexicon:
            return "I"
        for symbol, words in (("T", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in words:
                return symbol
        return "O"

    def clause(self, text: str) -> Counter:
        state, events = GRAMMAR.start, []
        for word in _WORD.findall(text):
            key = state, self.symbol(word)
            if key not in self.steps:
                self.steps[key] = GRAMMAR.step(*key)
            state, tags = self.steps[key]
            if tags:
                events.append(tags)
        end, found = GRAMMAR.final(state), Counter()
        for tags in events:
            tags |= end
            if "threat" in tags and "targeted" not in tags:
                continue
            found["negated" if "negated" in tags else "reported" if "reported" in tags else "threat" if "threat" in tags else "targeted" if "targeted" in tags else "plain"] += 1
        return found

    def read(self, text: str) -> np.ndarray:
        """log(1 + count) of each reading over all clauses of the whole text."""
        low, found, done = text.lower(), Counter(), -1
        for at, n in self.automaton.iter(low):
            first = at - n + 1
            if first <= done or (first and (low[first - 1].isalnum() or low[first - 1] == "_")):
                continue
            # the clause begins after the last of these marks, or where the search last ended
            a = max(max(low.rfind(c, done + 1, first) for c in ".!?;:\n"), done) + 1
            clause = _CLAUSE.match(low, a)
            found += self.clause(clause[0])
            done = clause.end()
        return np.log1p([found[r] for r in READINGS])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def learn_lexicon(docs: DataFrame, least: int = 3, purity: float = 0.97) -> Lexicon:
    """Entries that tell toxic documents, by set cover: again and again the one that covers most of those left.

    docs has row (a number of its own), words (an array, each once) and toxic. An entry is a word or
    a word beginning of 4 to 7 letters. It must be in `least` toxic documents and, scaled to equal
    classes, hold `purity` of its documents on the toxic side; of entries that cover the same, the
    longest beginning is taken. Entries are counted by Spark; the driver gets those that are pure
    enough with the toxic documents of the sample that have them.
    """
    n = {r["toxic"]: r["count"] for r in docs.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon([*SEEDS])

    def beginnings(k: int):
        return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    each = docs.select("row", "toxic", F.explode(F.array_distinct(F.concat("words", *map(beginnings, range(4, 8))))).alias("entry"))
    share = F.col("hits") / n[1]
    counted = each.groupBy("entry").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("clean"))
    pure = counted.where((F.col("hits") >= least) & (share / (share + F.col("clean") / n[0]) >= purity)).select("entry")
    able = {r["entry"]: set(r["rows"]) for r in each.where("toxic = 1").join(pure, "entry").groupBy("entry").agg(F.collect_set("row").alias("rows")).collect()}
    order = sorted(able, key=lambda e: (-len(able[e]), -len(e), e))
    chosen, covered = [], set()
    while True:
        best, gain = None, least - 1
        for e in order:
            if len(able[e]) <= gain:
                break
            g = len(able[e] - covered)
            if g > gain:
                best, gain = e, g
        if best is None:
            break
        chosen.append(best)
        covered |= able[best]
    return Lexicon(sorted({*chosen, *SEEDS}))


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps, drawn to PRIOR."""
    w, prior, design = np.append(PRIOR, BIAS), np.append(PRIOR, BIAS), np.column_stack([x, np.ones(len(x))])
    hold = np.append(np.full(len(PRIOR), PRIOR_ROWS), 0.01)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (weight * (p - y)) + hold * (w - prior)
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(hold)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learns from labels.toxic of rows outside fold 0, at most sample_docs documents of each class.

    A document labelled more than once counts as its highest label. Without rows of both classes
    the seed words and prior weights stand.
    """
    seen = labels.where((id_crc() % folds != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    parts = [hashed_sample(seen.where(F.col("toxic") == t), "doc_id", sample_docs, n) for t, n in sorted(totals.items())]
    if len(parts) < 2:
        return ToxicityModel(Lexicon([*SEEDS]), PRIOR, BIAS)
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample_docs rows, so that they can be broadcast
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2000, 1 << 22):
            found = [sorted(set(_LETTERS.findall(t.lower()))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), b.column(2)], names=["row", "words", "toxic"])

    # a row's number need only tell the sample's rows apart
    numbered = sample.select(F.xxhash64("doc_id", "text").alias("row"), "text", F.col("toxic").cast("int").alias("toxic"))
    with steps(docs.sparkSession):
        lexicon = learn_lexicon(stored(numbered.mapInArrow(words, "row long, words array<string>, toxic int"), "toxicity-words"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in slices(batches, 0, 2000, 1 << 22):
            x = [grammar.read(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    read_rows = sorted(map(tuple, sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(read, "x array<double>, toxic int").collect()))
    if not read_rows:
        return ToxicityModel(lexicon, PRIOR, BIAS)
    x, y = np.array([r[0] for r in read_rows]), np.array([r[1] for r in read_rows], float)
    sampled = Counter(y.tolist())
    weight = np.array([totals[int(t)] / sampled[t] for t in y])
    return ToxicityModel(lexicon, *fit_weights(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts have no clause and get the score of the bias alone. A null doc_id stays
    and counts as not held out; repeated rows each give a row; other columns are not read. An empty
    table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for b in slices(batches, 2, 2000, 1 << 22):
            x = np.array([grammar.read(t) for t in b.column(2).to_pylist()]).reshape(-1, len(READINGS))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    wanted = texts(docs).select("doc_id", F.coalesce(id_crc() % folds == 0, F.lit(False)).alias("held_out"), "text")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
