"""Benchmark decontamination: a BM25 index of test items, block-max pruning, and overlap of question and answer.

The index is over the items; every passage of every text is a query. An item's score is taken as
a share of its score with itself, and its threshold is what remains when the words go that an
overlap of `overlap` can do without, so no item that verification would accept stays below it.
Weak words cannot reach a threshold by themselves: a passage without any essential word of an
item is passed over (the pivot of WAND). For the rest, the greatest impacts within a block of
items bound their scores, and only blocks that can reach a threshold are scored in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts
from .shingles import shingle_hashes, word_hashes

K1, B = 1.2, 0.75
#: Least share of an item's five-word shingles in a passage, and of its question's and of its answer's.
OVERLAP, PART, SHINGLE = 0.8, 0.5, 5
#: Items of a block, of one index, and of one pass over the documents: the broadcast bounds grow with their product (some 50 MB a pass).
BLOCK, SHARD, PASS = 8, 500, 5000

_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The item's question: up to its last inner question mark, else all but its last sentence; the rest is its answer."""
    text = text.strip()
    at = text.rfind("?", 0, -1)
    if at >= 0:
        return text[: at + 1], text[at + 1 :]
    cuts = list(_SENTENCE.finditer(text))
    return (text[: cuts[-1].start()], text[cuts[-1].end() :]) if cuts else (text, "")


class ItemIndex:
    """BM25 impacts of at most SHARD items, scaled so that every item's threshold is 1."""

    def __init__(self, items: list[tuple[int, str]], overlap: float):
        parts = [question_and_answer(t) for _, t in items]
        words, n = word_hashes([f"{q}\n{a}" for q, a in parts])
        has = n > 0
        n_question = word_hashes([q for q, _ in parts])[1]
        of = np.repeat(np.arange(len(items)), n)
        self.overlap = overlap
        self.ids = [i for i, _ in items]
        sh, n_sh = shingle_hashes(words, n, SHINGLE)
        ends, firsts = np.cumsum(n_sh), np.cumsum(n_sh) - n_sh
        self.shingles = [sh[a:b] for a, b in zip(firsts, ends, strict=True)]
        self.in_question = [np.arange(k) + SHINGLE <= q for k, q in zip(n_sh, n_question, strict=True)]
        self.longest = int(n.max(initial=0))
        self.vocabulary, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(of * max(1, len(self.vocabulary)) + term, return_counts=True)
        item, term = pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary))
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log(1 + (has.sum() - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(1e-9, n[has].mean() if has.any() else 1)))
        own = np.bincount(item, weights=impact, minlength=len(items))
        share = impact / own[item]
        essential = np.zeros(len(self.vocabulary), bool)
        for i in np.flatnonzero(has):
            mine = np.flatnonzero(item == i)
            mine = mine[np.argsort(share[mine], kind="stable")]
            spare = int((1 - overlap) * len(np.unique(self.shingles[i])) + 1e-9)
            least = share[mine[: len(mine) - spare]].sum() - 1e-6 if spare < len(mine) else 0.0
            least = max(least, 1e-9)
            essential[term[mine[np.cumsum(share[mine]) >= least]]] = True
            share[mine] /= least
        self.essential = essential
        # postings by term, and each term's greatest share in each block of items
        order = np.lexsort((item, term))
        self.item, self.share = item[order], share[order]
        self.posting = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-len(items) // BLOCK)
        self.most = np.zeros((len(self.vocabulary), self.blocks), np.float32)
        np.maximum.at(self.most, (term, item // BLOCK), (share * (1 + 1e-6)).astype(np.float32))

    def search(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, bm25 share, overlap, question's, answer's) of all items verified in the texts of these words."""
        if not len(words) or not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        if not known.size:
            return []
        term = at[known]
        # passages: two strides long and a stride apart, so that an item fits into one whole
        stride = self.longest + 16
        firsts, strides = np.cumsum(counts) - counts, -(-counts // stride)
        base = np.cumsum(strides) - strides
        text = np.searchsorted(firsts, known, side="right") - 1
        passage = base[text] + (known - firsts[text]) // stride
        # each word belongs to the passage that begins with its stride, and to the one before
        early = (known - firsts[text]) >= stride
        passage, term = np.concatenate([passage, passage[early] - 1]), np.concatenate([term, term[early]])
        wanted = np.unique(passage[self.essential[term]])
        if not wanted.size:
            return []
        keep = np.isin(passage, wanted)
        pair = np.unique(passage[keep] * len(self.vocabulary) + term[keep])
        passage, term = pair // len(self.vocabulary), pair % len(self.vocabulary)
        found: dict[tuple[int, int], tuple] = {}
        cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        # groups of passages, so that the table of bounds stays small
        for lo in range(0, len(cut), 512):
            group = cut[lo : lo + 512]
            end = cut[lo + 512] if lo + 512 < len(cut) else len(passage)
            bound = np.add.reduceat(self.most[term[group[0] : end]], group - group[0], axis=0)
            for row in np.flatnonzero((bound >= 1 - 1e-4).any(axis=1)):
                a = group[row]
                b = group[row + 1] if row + 1 < len(group) else end
                self._score(int(passage[a]), term[a:b], bound[row] >= 1 - 1e-4, words, counts, firsts, base, stride, found)
        return [(t, i, *v) for (t, i), v in sorted(found.items())]

    def _score(self, passage, terms, able, words, counts, firsts, base, stride, found) -> None:
        ranges = [np.arange(self.posting[t], self.posting[t + 1]) for t in terms]
        at = np.concatenate(ranges)
        at = at[able[self.item[at] // BLOCK]]
        score = np.bincount(self.item[at], weights=self.share[at], minlength=len(self.ids))
        hits = np.flatnonzero(score >= 1 - 1e-6)
        if not hits.size:
            return
        text = int(np.searchsorted(base, passage, side="right")) - 1
        start = firsts[text] + (passage - base[text]) * stride
        stop = min(start + 2 * stride, firsts[text] + counts[text])
        here = shingle_hashes(words[start:stop], np.array([stop - start]), SHINGLE)[0]
        for i in hits:
            short = len(self.shingles[i]) == 1
            if short:  # an item of fewer words than a shingle: its words in a row
                there = self._in_a_row(int(i), words[start:stop])
            else:
                there = np.isin(self.shingles[i], here)
            whole = float(there.mean())
            if whole < self.overlap:
                continue
            q = self.in_question[i]
            part = lambda mask, t=there: float(t[mask].mean()) if mask.any() else 1.0
            value = (float(score[i]), whole, part(q), part(~q))
            if min(value[2:]) < PART:
                continue
            key = (text, int(i))
            if key not in found or value[1] > found[key][1]:
                found[key] = value

    def _in_a_row(self, i: int, words: np.ndarray) -> np.ndarray:
        for size in range(1, SHINGLE + 1):
            runs = len(words) - size + 1
            if runs > 0:
                sh = shingle_hashes(np.lib.stride_tricks.sliding_window_view(words, size).reshape(-1), np.full(runs, size), SHINGLE)[0]
                if np.isin(self.shingles[i], sh).all():
                    return np.array([True])
        return np.array([False])


def indexes(benchmark: DataFrame, overlap: float = OVERLAP) -> Iterator[list[ItemIndex]]:
    """Indexes of all items, those of PASS items at a time; items that are null or have no word are in none."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-items.count() // PASS))
    for p in range(passes):
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()))
        yield [ItemIndex(rows[i : i + SHARD], overlap) for i in range(0, len(rows), SHARD)]


def search_texts(shards: list[ItemIndex], texts_: list[str]) -> list[tuple]:
    words, counts = word_hashes(texts_)
    return [(t, s.ids[i], *rest) for s in shards for t, i, *rest in s.search(words, counts)]


_STEP, _SIZE = 300, 1 << 20


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """A row for every document and test item that it holds: doc_id, item_id, bm25, overlap, question_overlap, answer_overlap.

    Clean documents have no row. A text holds an item if one passage has `overlap` of its five-word
    shingles, and at least PART of those that lie in its question and PART of the others, which
    touch its answer; a part without a shingle is held. bm25 is the item's score over its
    threshold. Null and empty texts hold nothing; an item of 1 to 4 words is held where its words
    stand in a row. Null doc_ids and repeated rows keep their rows; an empty table of either kind
    gives none.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"
    parts = []
    for shards in indexes(benchmark, overlap):
        index = spark.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            types = [pa.int64()] * 2 + [pa.float64()] * 4
            for b in slices(batches, 1, _STEP, _SIZE):
                ids = b.column(0).to_pylist()
                rows = [(ids[t], *rest) for t, *rest in search_texts(index.value, b.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"])

        parts.append(texts(docs).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no test item as `contaminated` tells it; null and empty texts stay."""
    small_batches(docs.sparkSession)
    for shards in indexes(benchmark, overlap):
        index = docs.sparkSession.sparkContext.broadcast(shards)

        @F.pandas_udf("boolean")
        def clean(text, index=index):
            import pandas as pd

            good, at = np.ones(len(text), bool), 0
            column = pa.RecordBatch.from_arrays([pa.array(text.fillna(""), pa.string())], names=["text"])
            for b in slices([column], 0, _STEP, _SIZE):
                for t, *_ in search_texts(index.value, b.column(0).to_pylist()):
                    good[at + t] = False
                at += b.num_rows
            return pd.Series(good)

        docs = docs.where(clean(F.col("text")))
    return docs
