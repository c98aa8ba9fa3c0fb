"""Language identification by a byte convolutional network, trained and applied with numpy.

Beside the learned languages the network has a class for texts of none of them, trained on windows
made by a rule. It plays no part in which language is told, only in whether a text is kept.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, id_crc, slices, small_batches

#: Bytes in a window.
WINDOW = 192
#: The convolution's widths in bytes, and its filters for each width.
WIDTHS, FILTERS = (2, 3, 4), 16
#: The training sample's bounds: documents, and windows drawn from hashed places of the whole text of each, with their characters.
SAMPLE_DOCS, EACH, SAMPLE_CHARS = 6000, 4, 176
#: The probability of a learned language below which a text is rejected.
LEAST = 0.2
#: Of so many windows one is turned into one of no learned language.
OTHERS = 4
# First and last letters of scripts from which windows of no learned language are made.
SCRIPTS = ["az", "αω", "ая", "აჰ", "את", "بي", "अह", "กฮ", "ぁん", "一龥", "가힣"]

_LETTER = re.compile(r"[^\W\d_]")
_FEW = 256  # windows in a numpy step


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' UTF-8 bytes in rows of WINDOW, zero-padded; and the text each row is of."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    each = np.array([-(-len(b) // WINDOW) for b in raw], dtype=np.int64)
    out = np.zeros((int(each.sum()), WINDOW), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    for b, n in zip(raw, each, strict=True):
        flat[at : at + len(b)] = np.frombuffer(b, dtype=np.uint8)
        at += int(n) * WINDOW
    return out, np.repeat(np.arange(len(raw)), each)


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; number forms such as a half or a Roman numeral's sign are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def other_text(text: str, rng: random.Random) -> str:
    """A text of no learned language: the letters of this one in any order, or letters of a script."""
    if rng.random() < 0.5:
        return "".join(rng.sample(text, len(text)))
    first, last = map(ord, rng.choice(SCRIPTS))
    some = [chr(rng.randint(first, last)) for _ in range(rng.randint(8, 40))]
    return " ".join("".join(rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(len(text) // 6 + 1))[: len(text)]


class ByteCNN:
    """One-hot bytes, convolutions of several widths, max pooling over a window, softmax over the classes and none of them."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes) + 1)).astype(np.float32)
        self.bias = np.zeros(len(classes) + 1, np.float32)
        self._pairs: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_pairs": None}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam on the cross entropy, classes weighted to count alike."""
        rng = np.random.default_rng(seed)
        weight = (len(y) / (len(self.bias) * np.maximum(np.bincount(y, minlength=len(self.bias)), 1)))[y]
        params = [*self.conv, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                rows = order[lo : lo + batch]
                grads = self._grads(x[rows], y[rows], weight[rows])
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self._pairs = None
        return self

    def _grads(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, pooled, where = len(x), [], []
        for w, table in zip(WIDTHS, self.conv, strict=True):
            span = WINDOW - w + 1
            c = sum(table[j][x[:, j : j + span]] for j in range(w))
            at = c.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(c, at[:, None, :], axis=1)[:, 0, :])
        h = np.concatenate(pooled, axis=1)
        z = np.maximum(h, 0) @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= (weight / n)[:, None]
        p = p.astype(np.float32)
        back = (p @ self.out.T) * (h > 0)
        grads, rows, cols = [], np.arange(n)[:, None], np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        for k, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
            g = np.zeros((w, 256, FILTERS), np.float32)
            for j in range(w):
                np.add.at(g[j], (x[rows, at + j], cols), back[:, k * FILTERS : (k + 1) * FILTERS])
            grads.append(g)
        return [*grads, np.maximum(h, 0).T @ p, p.sum(axis=0)]

    def _tables(self) -> list:
        """The same weights by byte pairs: half the look-ups. Made once in each process."""
        if self._pairs is None:
            pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS))
            two, three, four = self.conv
            self._pairs = [[pair(two[0], two[1])], [pair(three[0], three[1]), three[2]], [pair(four[0], four[1]), pair(four[2], four[3])]]
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax for each window."""
        (two,), (three, last), (four, rest) = self._tables()
        out = np.empty((len(x), len(self.bias)), np.float32)
        for lo in range(0, len(x), _FEW):
            b = x[lo : lo + _FEW].astype(np.int32)
            p = b[:, :-1] * 256 + b[:, 1:]
            h = [two[p].max(axis=1)]
            c = three[p[:, :-1]]
            c += last[b[:, 2:]]
            h.append(c.max(axis=1))
            c = four[p[:, :-2]]
            c += rest[p[:, 2:]]
            h.append(c.max(axis=1))
            z = np.maximum(np.concatenate(h, axis=1), 0) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[lo : lo + _FEW] = z / z.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """The class and its probability among the learned ones for each text, and how surely it is of one of them.

        Probabilities are means over all windows, weighted by their bytes. A text without a letter
        is `und` with 0 and 0.
        """
        real = [i for i, t in enumerate(texts) if has_letter(t)]
        langs, scores, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not real or not self.classes:
            return langs, scores, known
        x, of = windows([texts[i] for i in real])
        weight = (x != 0).sum(axis=1).astype(np.float64) + 1e-9
        p = self.probabilities(x) * weight[:, None]
        first = np.searchsorted(of, np.arange(len(real)))
        mean = np.add.reduceat(p, first, axis=0) / np.add.reduceat(weight, first)[:, None]
        learned, sure = mean[:, :-1], 1 - mean[:, -1]
        best = learned.argmax(axis=1)
        for k, i in enumerate(real):
            langs[i], scores[i], known[i] = self.classes[best[k]], float(min(1.0, learned[k, best[k]] / max(learned[k].sum(), 1e-12))), float(sure[k])
        return langs, scores, known


def train(docs: DataFrame, fold: int = 2, folds: int = 4, sample_docs: int = SAMPLE_DOCS) -> ByteCNN:
    """A network fitted to at most sample_docs labelled documents outside the held-out fold.

    Rows with a null lang, doc_id or text teach nothing. With no row left the network has no
    class and predicts `und`. The driver receives EACH windows of SAMPLE_CHARS characters for a
    document, from hashed places of its whole text; a text that is shorter gives one.
    """
    labelled = docs.where((id_crc() % folds != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = labelled.count()
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    drawn = [F.col("text").substr((F.pmod(F.xxhash64("doc_id", "lang", F.lit(i)), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)) for i in range(EACH)]
    pieces = F.array_distinct(F.array(*drawn))
    rows = hashed_sample(labelled.select("doc_id", "lang", pieces.alias("pieces")), "doc_id", sample_docs, total).collect()
    taught = [(r.lang, p) for r in rows for p in r.pieces if has_letter(p)]
    classes = sorted({lang for lang, _ in taught})
    model = ByteCNN(classes)
    if classes:
        rng = random.Random(5)
        texts = [p for _, p in taught] + [other_text(p, rng) for _, p in taught[::OTHERS]]
        x, of = windows(texts)
        y = np.array([classes.index(lang) for lang, _ in taught] + [len(classes)] * (len(texts) - len(taught)))[of]
        full = (x != 0).sum(axis=1) >= 24
        full |= ~np.isin(of, of[full])
        model.fit(x[full], y[full])
    return model


def identify(docs: DataFrame, model: ByteCNN, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null and empty texts and those without a letter give `und` and 0.0; a null doc_id stays and
    counts as not held out. Repeated rows each give a row; other columns are not read. An empty
    table gives no row.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 500, 1 << 20):
            langs, scores, _ = model.predict(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_crc() % folds == fold, F.lit(False)).alias("held_out"), F.col("text"))
    return wanted.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteCNN, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that are of a learned language with probability `least` or more.

    Texts that are null, empty or without a letter go; repeated rows and null ids are judged like
    any other row; an empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def told(text):
        import pandas as pd

        column = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], names=["text"])
        kept = [k >= least and a != "und" for part in slices([column], 0, 500, 1 << 20) for a, _, k in zip(*model.predict(part.column(0).to_pylist()), strict=True)]
        return pd.Series(kept, dtype=bool)

    small_batches(docs.sparkSession)
    return docs.where(told(F.col("text")))
