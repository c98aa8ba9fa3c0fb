"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Pieces of one length are alike to best fit, so the algorithm runs over the histogram of lengths
and over classes of bins with the same room left: at most `capacity` entries each, whatever the
size of the corpus. A segment tree over the remaining capacities finds the tightest open class.
What comes out is the packing that best fit decreasing gives piece by piece; the pieces get
their places by their rank within their length, which Spark counts in salted windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts
from .tokenize import END, encoder, vocabulary_path

CAPACITY = 4096
#: Rows of a window task at most, about: lengths with more pieces are split by a hash.
WINDOW_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenClasses:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [False] * (2 * self.leaves)

    def set(self, room: int, full: bool) -> None:
        at = room + self.leaves
        self.tree[at] = full
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least `need` that has an open bin."""
        at = need + self.leaves
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, count, first bin, offset): where the pieces of each length go.

    The pieces of `length` with ranks first..first+count-1 go one each to consecutive bins, at
    the same offset. Bins are numbered from 0 in the order in which they are opened.
    """
    open_bins: dict[int, list[list[int]]] = {}  # room left: runs [first bin, count]
    tree, rows, bins = OpenClasses(capacity), [], 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            open_bins.setdefault(room, []).append([first, count])
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # a new bin takes as many as it holds before the next is opened; the ranks of a layer go to consecutive bins
                full, rest = divmod(left, capacity // length)
                for count, layers in ((full, capacity // length), (1, rest)):
                    if count and layers:
                        for k in range(layers):
                            rows.append((length, rank, count, bins, k * length))
                            rank += count
                        put(capacity - layers * length, bins, count)
                        bins += count
                break
            run = open_bins[room][-1]
            first, here = run[0], min(left, run[1])
            rows.append((length, rank, here, first, capacity - room))
            run[0], run[1] = first + here, run[1] - here
            if not run[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    tree.set(room, False)
            put(room - length, first, here)
            rank, left = rank + here, left - here
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids cut into pieces of `capacity`, the last maybe shorter: PIECES.

    A document's ids are those of its whole text and the end id; a null or empty text is the end
    id alone. Repeated rows and null ids give pieces like any other row.
    """
    path = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                out = ([], [], [], [], [])
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset: the pieces of a sequence follow each other without a gap.

    cut is a stored table with doc_id, piece, start, length (1..capacity) and ids_crc32. Pieces
    alike in all columns are exchanged freely. The driver gets one row for each length.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    moves = plan(histogram, capacity)
    spark = cut.sparkSession
    salts = spark.createDataFrame([(n, -(-c // WINDOW_ROWS)) for n, c in histogram.items()], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(within)).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("n") - 1).alias("rank"))
    order = np.lexsort((moves[:, 1], moves[:, 0]))
    moves = moves[order]
    keys = moves[:, 0] * (1 << 48) + moves[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            bins = moves[at, 3] + rank - moves[at, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(bins), pa.array(moves[at, 4])], names=[*(b.schema.names[:5]), "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents and their places in as few sequences as best fit decreasing needs."""
    return pack(stored(pieces(docs, capacity, vocabulary), "pieces"), capacity)
