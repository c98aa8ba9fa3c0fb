"""Substring dedup by content-defined chunks: every two documents that share a passage of 50 words meet.

Texts are compared as their words: runs of letters and digits in lower case with single blanks
between. A gear hash rolls over their bytes; at the end of a word it tells the 64 bytes before. A
window of 50 words is marked by the least hash at a word's end within it that depends on no byte
outside, so a window that two documents share has the same mark in both, wherever it stands.
Neighbouring windows of one mark make a chunk: its ends lie where the least hash changes, so they
come from the content, and an insertion moves only the chunks that it touches. Chunks overlap, so
that every window lies whole in one. They are deduplicated by the digest of their words: a chunk
met before is paired with the first document that holds it. The windows of the first document of
a chunk are hashed one by one, and paired with the first that holds each. Pairs are grown to the
whole passage in common, word by word.

A document here is a row's doc_id with its text, so rows that share an id stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, result, sized, slices, small_batches, stored
from .shingles import _FOLD, _powers, mix

#: Bytes that the gear hash depends on: as many as it has bits.
REACH = 64
#: Words of a passage at least.
WORDS = 50
#: Bytes of the texts that are hashed at once, unless one text alone is longer.
_CHARS = 1 << 20
_STEP = 400
_WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")

#: A fixed random number for each byte, made from a rule.
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + GEAR[byte] in 64 bits, so that a byte has left it after REACH more."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16, 32):  # the span doubles: h[i] + (h[i - k] << k)
        grown = h.copy()
        grown[k:] += h[:-k] << np.uint64(k)
        h = grown
    return h


def normal(text: str) -> bytes:
    """The words of a text in lower case with single blanks between, as UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def least_of(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first..last] for each pair of places, last included."""
    out, span, level = np.zeros(len(first), x.dtype), 1, x
    n = last - first + 1
    while span <= n.max(initial=0):
        some = np.flatnonzero((n >= span) & (n < 2 * span))
        out[some] = np.minimum(level[first[some]], level[last[some] - span + 1])
        level, span = np.minimum(level[:-span], level[span:]), 2 * span
    return out


class Windows:
    """The windows of `least` words of some texts, in chunks: neighbours with the same mark."""

    def __init__(self, texts_: list[str], least: int) -> None:
        raw = [normal(t) for t in texts_]
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in raw], np.int64)
        data = np.frombuffer(b" ".join(t for t in raw if t), np.uint8)
        self.least, total = least, int(counts.sum())
        self.sums, self.text = np.zeros(total + 1, np.uint64), np.repeat(np.arange(len(counts)), counts)
        at = np.append(0, np.flatnonzero(data == 32) + 1)[:total]
        power, self.inverse = _powers(len(data))
        sums = np.append(np.uint64(0), np.cumsum(data.astype(np.uint64) * power[: len(data)]))
        ends = np.append(at[1:] - 1, len(data))[:total]
        words = mix((sums[ends] - sums[at]) * self.inverse[at])
        np.cumsum(words * power[:total], out=self.sums[1:])
        first = (np.cumsum(counts) - counts)[self.text]
        #: The place of every word in its text, in bytes.
        self.place = at - at[first]
        if total < least:
            self.at, self.key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        else:
            self.at = np.flatnonzero(np.arange(total) - first + least <= counts[self.text])  # the first word of a window
            mark, last = mix(rolled(data)[ends - 1]), self.at + least - 1
            # the first word whose end the hash reaches without a byte before the window; in a window of fewer bytes its last word
            inside = np.minimum(np.searchsorted(ends, at[self.at] + REACH), last)
            self.key = least_of(mark, inside, last)
            few = ends[last] - at[self.at] < REACH
            self.key[few] = self.hashes(self.at[few], least)
        of = self.text[self.at]
        new = np.append(True, (self.key[1:] != self.key[:-1]) | (of[1:] != of[:-1]))[: len(of)]
        #: The first window of each chunk and how many windows it has.
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(of)))

    def hashes(self, at: np.ndarray, words) -> np.ndarray:
        """Hashes of the runs of so many words from the words at these places."""
        return mix((self.sums[at + words] - self.sums[at]) * self.inverse[at] + np.asarray(words).astype(np.uint64))


def _listed(of: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in values]


def versions(docs: DataFrame) -> DataFrame:
    """doc (a digest of id and text), doc_id and text of the rows that have an id; a null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select(doc_key("doc_id", "text").alias("doc"), "text", "doc_id")


def doc_key(doc_id: str, text: str):
    """Sorts as the ids do: the id's 8 bytes with the sign turned, then 8 bytes of the text's digest, which need only tell the texts of one id apart."""
    ordered = F.unhex(F.lpad(F.hex(F.col(doc_id).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(ordered, F.substring(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), 1, 8))


def chunks(docs: DataFrame, least: int) -> DataFrame:
    """For every document its chunks: the mark, the digest of all their words, and the place, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _STEP, _CHARS):
            w = Windows(b.column(1).to_pylist(), least)
            at = w.at[w.first]
            lists = _listed(w.text[at], b.num_rows, w.key[w.first].view(np.int64), w.hashes(at, w.size + least - 1).view(np.int64), w.place[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc", "key", "digest", "start"])

    return versions(docs).select("doc", "text").mapInArrow(run, "doc binary, key array<long>, digest array<long>, start array<int>")


def windows(owners: DataFrame, least: int) -> DataFrame:
    """The windows of the chunks at `places` (2 x the start, and 1 more where others hold the chunk) of doc, text, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _STEP, _CHARS):
            w = Windows(b.column(1).to_pylist(), least)
            at, wanted = w.at[w.first], b.column(2)
            places = wanted.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            order = np.unique((rows.astype(np.int64) << 33) + places)
            own = (w.text[at].astype(np.int64) << 33) + 2 * w.place[at]
            shared, alone = np.isin(own + 1, order), np.isin(own, order)
            keep = np.repeat(shared | alone, w.size)
            at, shared = w.at[keep], np.repeat(shared, w.size)[keep]
            lists = _listed(w.text[at], b.num_rows, w.hashes(at, least).view(np.int64), w.place[at].astype(np.int32), shared)
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc", "digest", "start", "shared"])

    return owners.select("doc", "text", "places").mapInArrow(run, "doc binary, digest array<long>, start array<int>, shared array<boolean>")


def alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many first bytes two arrays share, compared in steps that double until they differ."""
    n, at, step = min(len(x), len(y)), 0, 256
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def common_passages(a: bytes, b: bytes, anchors: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Passages of `least` whole words or more that a and b share around the anchors: (first word in a, in b, words)."""
    x, y, found, spans, done = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), [], [], {}
    ends_a, ends_b = (np.append(np.flatnonzero(s == 32), len(s)) for s in (x, y))

    def covered(i: int, j: int) -> bool:
        """Whether passages found before hold the window of a and that of b."""
        to_a, to_b = (int(ends[min(np.searchsorted(ends, at) + least - 1, len(ends) - 1)]) for ends, at in ((ends_a, i), (ends_b, j)))
        return any(lo <= i and to_a <= hi for lo, hi, _, _ in spans) and any(lo <= j and to_b <= hi for _, _, lo, hi in spans)

    for i, j in sorted(anchors):
        if done.get(i - j, -1) > i or i >= len(x) or j >= len(y) or (spans and covered(i, j)):
            continue
        right = alike(x[i:], y[j:])
        left = alike(x[:i][::-1], y[:j][::-1])
        done[i - j] = i + right
        lo, hi = i - left, i + right
        # whole words only: what is cut at an end is left out
        inside = lambda s, at: 0 < at < len(s) and s[at - 1] != 32 and s[at] != 32
        if inside(a, lo) or inside(b, lo + j - i):
            lo = min((a.find(b" ", lo, hi) + 1) or hi, hi)
        if inside(a, hi) or inside(b, hi + j - i):
            hi = max(a.rfind(b" ", lo, hi), lo)
        words = len(a[lo:hi].split())
        if words >= least:
            found.append((a.count(b" ", 0, lo + (a[lo] == 32)), b.count(b" ", 0, lo + j - i + (a[lo] == 32)), words))
            spans.append((lo, hi, lo + j - i, hi + j - i))
    return found


def own_passages(a: bytes, anchors: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Passages made of the windows of `least` words at the anchors' two places in a: (first word, the same, words)."""
    starts = np.append(0, np.flatnonzero(np.frombuffer(a, np.uint8) == 32) + 1)
    at = np.unique(np.searchsorted(starts, np.array(anchors).ravel()))
    run = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return [(int(r[0]), int(r[0]), int(r[-1] - r[0]) + least) for r in run]


def _span(places: list[tuple[int, int]], first: int, words: int) -> tuple[int, int]:
    return places[first][0], places[first + words - 1][1]


def passages(docs: DataFrame, least: int) -> DataFrame:
    """doc, start, end (code points), n_words and first (the first document's) of every passage that `repeated_passages` tells."""
    chunk = stored(chunks(docs, least), "chunks")
    each = chunk.select("doc", F.explode(F.arrays_zip("key", "digest", "start")).alias("b")).select("doc", "b.key", "b.digest", "b.start")
    # each side that is grouped is stored before the join, so that Spark can split the rows of a key that very many hold
    met = stored(each.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key"), "passage-marks")
    likely = stored(each.join(met, "key").select("doc", "digest", "start"), "passage-chunks")
    owner = stored(likely.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("doc").alias("last")), "passage-owners")
    placed = stored(likely.join(owner, "digest").select("doc", "start", "first", "last"), "passage-places")
    packed = ((F.col("start").cast("long") * (1 << 32)) + F.col("first.start")).alias("anchor")
    known = placed.where(F.col("doc") != F.col("first.doc")).select("doc", F.col("first.doc").alias("first_doc"), packed)

    wanted = stored(likely.select("doc").distinct(), "passage-documents")
    found = versions(docs).join(sized(wanted, wanted.count()), "doc", "left_semi")
    found = stored(found.groupBy("doc").agg(F.first("text").alias("text")), "passage-texts")  # a repeated row is one document
    owned = placed.where(F.col("doc") == F.col("first.doc"))
    owned = owned.groupBy("doc").agg(F.collect_list(F.col("start").cast("long") * 2 + (F.col("last") > F.col("doc")).cast("long")).alias("places"))
    window = stored(windows(found.join(owned, "doc"), least), "passage-windows")
    each = window.select("doc", F.explode(F.arrays_zip("digest", "start", "shared")).alias("w")).select("doc", "w.digest", "w.start", "w.shared")
    holder = each.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("doc").alias("last"), F.max("shared").alias("shared"), F.count("*").alias("n"))
    holder = stored(holder.where((F.col("first.doc") < F.col("last")) | (F.col("shared") & (F.col("n") > 1))).select("digest", "first"), "passage-holders")
    more = each.join(holder, "digest").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    more = more.select("doc", F.col("first.doc").alias("first_doc"), packed)
    pairs = stored(known.union(more).groupBy("doc", "first_doc").agg(F.collect_list("anchor").alias("anchors")), "passage-pairs")
    both = pairs.join(found, "doc").join(found.select(F.col("doc").alias("first_doc"), F.col("text").alias("first_text")), "first_doc")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, (doc, first, text, first_text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                near = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                near = list(zip((near >> 32).tolist(), (near & 0xFFFFFFFF).tolist(), strict=True))
                shared = own_passages(normal(text), near, least) if doc == first else common_passages(normal(text), normal(first_text), near, least)
                if shared:
                    here, there = ([m.span() for m in _WORD.finditer(t)] for t in (text, first_text))
                for i, j, words in shared:
                    out.append((doc, *_span(here, i, words), words, first))
                    out.append((first, *_span(there, j, words), words, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*set(out), strict=True), [pa.binary(), *[pa.int64()] * 3, pa.binary()], strict=True)], names=["doc", "start", "end", "n_words", "first"])

    grown = both.select("doc", "first_doc", "anchors", "text", "first_text").mapInArrow(grow, "doc binary, start long, end long, n_words long, first binary")
    return grown.groupBy("doc", "start", "end").agg(F.max("n_words").alias("n_words"), F.min("first").alias("first"))


def id_of(doc: str):
    """The doc_id in a document's key."""
    return F.conv(F.hex(F.substring(doc, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def repeated_passages(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """A row for each passage of `least` words or more that a document shares with the first document that holds it.

    doc_id, start and end (code points, end exclusive), n_words, first_doc_id. The first document
    has rows of its own, with first_doc_id its doc_id; documents that share nothing have none.
    Null and empty texts share nothing; rows with a null doc_id take no part. Rows of one doc_id
    with different texts are documents of their own, in the order of their texts' digests; rows
    that repeat both are one document. Other columns are not read; an empty table gives no row.
    """
    found = result(docs.sparkSession, "passages", lambda: passages(docs, least))
    return found.select(id_of("doc").alias("doc_id"), "start", "end", "n_words", id_of("first").alias("first_doc_id"))


def without_repeats(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """docs with all its columns, the passages cut out of every text but that of the first document.

    Rows that repeat a doc_id and a text are cut alike; rows with a null doc_id stay as they are.
    """
    owner, cuts_ = fresh(docs, "cut_doc"), fresh(docs, "cut_spans")
    found = result(docs.sparkSession, "passages", lambda: passages(docs, least))
    spans = found.where(F.col("doc") != F.col("first")).groupBy(F.col("doc").alias(owner)).agg(F.collect_list(F.struct("start", "end")).alias(cuts_))

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        def one(t, s):
            if t is None or s is None:
                return t
            out, at = [], 0
            for x in sorted((x["start"], x["end"]) for x in s):
                out.append(t[at : max(at, x[0])])
                at = max(at, x[1])
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)])

    keyed = docs.withColumn(owner, F.when(F.col("doc_id").isNotNull(), doc_key("doc_id", "text")))
    return keyed.join(spans, owner, "left").withColumn("text", cut("text", cuts_)).select(*docs.columns)
