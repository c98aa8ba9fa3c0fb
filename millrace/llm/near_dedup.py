"""Near-duplicate classes by BagMinHash signatures, banding, and exact multiset overlap.

A document is the multiset of its five-word shingles. Its signature comes from Poisson processes
over discretised weights: the weights of a shingle are halved into dyadic intervals, each with a
process of its own whose points fall to random components and to random levels within the
interval; a point counts if its level is within the shingle's weight. A component keeps its first
point, so two documents agree in it with the probability of their weighted Jaccard similarity.
Points are drawn in ascending order and no further than the signature needs.

Texts that are the same are one node of the graph from the start. Within a band's bucket every
node is first compared with the bucket's least node alone. Then rounds verify a forest of the
likeliest links between a bucket's components. At last all pairs of nodes of
different components that wide signatures tell as likely are verified. So a large group of copies costs a few comparisons a
member, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, gathered, parted, result, sized, slices, stored, texts
from .shingles import bags, mix, units

#: Bands and their components, and components in all: those beyond the bands sharpen the estimate.
BANDS, ROWS, COMPONENTS = 26, 5, 260
#: The similarity that links, and the estimate below which a pair is not verified (four deviations under it).
SIMILARITY, ESTIMATE = 0.8, 0.70
#: Components of the wide signatures of the last round, and the estimate from them below which a pair is not verified.
WIDE, WIDE_ESTIMATE = 1024, 0.75
#: Nodes of a block of a bucket, and rounds of forests before all likely pairs are verified.
BLOCK, FORESTS = 1000, 1
_STEP, _SIZE = 400, 1 << 20  # texts hashed at once, and their bytes unless one alone is longer

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(texts_: list[str], size: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """A row of `size` point ids for each text; and which texts have a word at all."""
    sh, weight, n = bags(texts_)
    out = np.zeros((len(texts_), size), np.uint64)
    some = n > 0
    if not some.any():
        return out, some
    of = np.repeat(np.arange(len(n)), n)
    total = np.bincount(of, weights=weight, minlength=len(n))
    # dyadic intervals (0,1], (1,2], (2,4], (4,8] ... as far as the weight reaches
    element, low, length = [np.arange(len(sh))], [np.zeros(len(sh))], [np.ones(len(sh))]
    reach = 1
    while (more := np.flatnonzero(weight > reach)).size:
        element.append(more)
        low.append(np.full(more.size, float(reach)))
        length.append(np.full(more.size, float(reach)))
        reach *= 2
    element, low, length = map(np.concatenate, (element, low, length))
    seed = mix(sh[element] + low.astype(np.uint64) * _GOLD + np.uint64(0x51ED))
    text, most = of[element], weight[element]
    todo, margin = some.copy(), 1.5
    while todo.any():
        limit = np.where(todo, (np.log(size) + margin) / np.maximum(total, 1), 0.0)
        live = np.flatnonzero(todo[text])
        filled = _points(seed[live], text[live], low[live], length[live], most[live], limit, out)
        todo &= filled.reshape(len(n), size).sum(axis=1) < size
        margin = 2 * margin + 2
    return out, some


def _points(seed, text, low, length, most, limit, out) -> np.ndarray:
    """Draws the points of each process up to the text's limit; writes each component's first point's id."""
    components_ = out.shape[1]
    rate, until = length * components_, limit[text]
    time, number = np.zeros(len(seed)), 0
    kept: list[tuple] = []
    alive = np.arange(len(seed))
    while alive.size:
        number += 1
        draw = mix(seed[alive] + np.uint64(number * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        # the next point is within the limit if u is above exp(-rate (limit - time)): no logarithm for the rest
        near = u > np.exp(-rate[alive] * (until[alive] - time))
        alive, draw, u, time = alive[near], draw[near], u[near], time[near]
        time = time - np.log(u) / rate[alive]
        other = mix(draw + np.uint64(0xA5A5))
        level = low[alive] + (other >> np.uint64(40)).astype(np.float64) * 2.0**-24 * length[alive]
        counts = np.floor(level) + 1 <= most[alive]
        component = (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % components_
        kept.append((time[counts], text[alive][counts] * components_ + component[counts], draw[counts]))
    time, slot, point = map(np.concatenate, zip(*kept, strict=True))
    order = np.argsort(-time)  # the first point is written last
    flat = out.reshape(-1)
    flat[slot[order]] = point[order]
    filled = np.zeros(flat.size, bool)
    filled[slot] = True
    return filled


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(sig), 1))
    for r in range(ROWS):
        keys = mix(keys + sig[:, r : BANDS * ROWS : ROWS])
    return keys.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """For every document its text's digest, band keys and signature at one byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, _STEP, _SIZE):
            sig, some = signatures(b.column(2).to_pylist())
            keys, small = band_keys(sig), (sig & np.uint64(255)).astype(np.uint8)
            ends = np.append(0, np.cumsum(some * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array([small[i].tobytes() if some[i] else None for i in range(len(some))], pa.binary())], names=["doc_id", "node", "bands", "sig"])

    addressed = texts(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    return addressed.mapInArrow(run, "doc_id long, node binary, bands array<long>, sig binary")


def fetched(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """node and text of the rows that have the doc_id and the node of a row in wanted; repeated rows stay."""
    addressed = texts(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    chosen = wanted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    return addressed.join(sized(chosen, rows), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("node", "text")


def bag_arrays(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """node and bag (its units' hashes) for the nodes in wanted: node and one doc_id that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, _STEP, _SIZE):
            sh, weight, n = bags(b.column(1).to_pylist())
            u, of = units(sh, weight)
            owner = np.repeat(np.arange(len(n)), n)[of]
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(u.view(np.int64)))], names=["node", "bag"])

    return fetched(docs, wanted, rows).mapInArrow(run, "node binary, bag array<long>").groupBy("node").agg(F.first("bag").alias("bag"))


def wide_signatures(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """node and sig, a signature of WIDE components at one byte each."""

    step = _STEP * COMPONENTS // WIDE  # as many points at once as for the first signatures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, step, _SIZE * COMPONENTS // WIDE):
            small = (signatures(b.column(1).to_pylist(), WIDE)[0] & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in small], pa.binary())], names=["node", "sig"])

    return fetched(docs, wanted, rows).mapInArrow(run, "node binary, sig binary").groupBy("node").agg(F.first("sig").alias("sig"))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap by `similarity` of their union."""
    wanted = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes.select("node", "doc_id"), "node"), "wanted")
    bag = stored(bag_arrays(docs, wanted, wanted.count()), "bags")
    both = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")).join(sized(pairs, pairs.count()), "b").join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.where(common >= similarity * (F.size("bag_a") + F.size("bag_b") - common)).select("a", "b")


def _unbiased(share):
    """Similarity from the share of equal bytes, one in 256 of which agree by chance."""
    return (share - 1 / 256) / (1 - 1 / 256)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimated similarity of each row of x with each row of y, from signatures of one byte a component."""
    same = np.zeros((len(x), len(y)), np.int32)
    for i in range(0, len(x), 64):
        same[i : i + 64] = (x[i : i + 64, None, :] == y[None, :, :]).sum(axis=2)
    return _unbiased(same / x.shape[1])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are not too far apart."""
    sig, pairs = nodes.select("node", "sig"), stored(pairs, "pairs")
    n = pairs.count()
    half = stored(gathered(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")).join(sized(pairs, n), "b"), n), "pairs")
    both = sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")).join(sized(half, n), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for i in (2, 3))
                good = _unbiased((x == y).mean(axis=1)) >= ESTIMATE
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (a, b).

    With labels from before, their components are joined by the new edges alone. Each round takes
    the least label of the neighbours, then the label of the label; sides of counted few rows are
    broadcast.
    """
    if before is not None:
        named = lambda c, to: sized(before.select(F.col("node").alias(c), F.col("label").alias(to)), before.count())
        old = edges.join(named("a", "x"), "a", "left").join(named("b", "y"), "b", "left")
        edges = old.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
    links = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    links = stored(gathered(links, 2 * edges.count()), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    n = labels.count()
    while True:
        near = links.join(sized(labels.select(F.col("node").alias("b"), "label"), n), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        onward = sized(labels.select(F.col("node").alias("near"), F.col("label").alias("further")), n)
        step = near.join(onward, "near").join(sized(labels, n), "node").select("node", F.col("label").alias("was"), F.least("label", "near", "further").alias("label"))
        step = stored(gathered(step, n), "labels")
        labels = step.select("node", "label")
        if step.where(F.col("was") != F.col("label")).isEmpty():
            break
    if before is None:
        return labels
    moved = sized(labels.select(F.col("node").alias("label"), F.col("label").alias("to")), n)
    kept = before.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh_ = labels.join(sized(before.select("node"), before.count()), "node", "left_anti")
    return kept.unionByName(fresh_)


def across(docs: DataFrame, members: DataFrame, labels: DataFrame, nodes: DataFrame, tested: DataFrame, forest: bool) -> DataFrame:
    """Likely pairs (a, b) of nodes that share a bucket but not a component, but for those tested
    before: all of them, told by wide signatures and each in the first bucket that the two share;
    or with `forest` only those of greatest estimate that join a group's components into trees.

    In a bucket, the members of its largest component are compared with the others only. Members
    are dealt into blocks of about BLOCK; a group is two blocks, so that no group grows with a
    bucket.
    """
    told = members.select("key", "node").join(sized(labels, labels.count()), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = told.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    mixed = stored(mixed.select("key", "main", blocks(F.col("n_main")).alias("d"), blocks(F.col("n") - F.col("n_main")).alias("o")), "mixed")
    rows = told.join(sized(mixed, mixed.count()), "key").withColumn("first", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("d")).otherwise(F.col("o")))
    # groups (i, j): of others i <= j; of others i and the main component's block j as (i, -1 - j)
    main_groups = F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), F.when(F.col("own") > k, 1).otherwise(0).alias("side")))
    rows = rows.withColumn("own", own).withColumn("g", F.explode(F.when(F.col("first"), main_groups).otherwise(F.concat(with_main, with_others))))
    rows = rows.select("key", "g.i", "g.j", "g.side", "node", "label")
    wanted = stored(rows.select("node").distinct(), "wanted")
    n = wanted.count()
    wanted = stored(gathered(nodes.select("node", "doc_id", "bands", "sig").join(sized(wanted, n), "node"), n, 2000), "wanted")
    signed = wanted.select("node", "bands", "sig")
    if not forest:
        signed = stored(wide_signatures(docs, wanted.select("node", "doc_id"), n).join(sized(wanted.select("node", "bands"), n, 20_000), "node"), "wide")
    rows = rows.join(sized(signed, n, 20_000), "node")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "side", "node", "label", "sig", "bands")

    def group(rows_: list[tuple]) -> tuple[list, list]:
        a, b = [], []
        same_block = rows_[0][1] == rows_[0][2]
        left = [r for r in rows_ if r[3] == 0]
        right = left if same_block else [r for r in rows_ if r[3] == 1]
        if not left or not right:
            return a, b
        x, y = (np.frombuffer(b"".join(r[6] for r in s), np.uint8).reshape(len(s), -1) for s in (left, right))
        likeness = alike(x[:, :COMPONENTS], y[:, :COMPONENTS])
        at, to = np.nonzero(likeness >= ESTIMATE)
        if forest:
            order = np.argsort(-likeness[at, to], kind="stable")
            at, to = at[order], to[order]
        elif at.size:
            p, q = (np.array([r[7] for r in s], np.int64) for s in (left, right))
            good = np.zeros(at.size, bool)
            for lo in range(0, at.size, 20_000):
                u, v = at[lo : lo + 20_000], to[lo : lo + 20_000]
                same = p[u] == q[v]
                here = p[u, same.argmax(axis=1)] == rows_[0][0]  # the first band that they share is this bucket's
                u, v = u[here], v[here]
                sure = np.zeros(here.size, bool)
                sure[here] = _unbiased((x[u] == y[v]).mean(axis=1)) >= WIDE_ESTIMATE
                good[lo : lo + 20_000] = sure
            at, to = at[good], to[good]
        tree: dict[bytes, bytes] = {}

        def root(label: bytes) -> bytes:
            while tree.get(label, label) != label:
                label = tree[label]
            return label

        for i, j in zip(at.tolist(), to.tolist(), strict=True):
            p, q = left[i], right[j]
            if p[5] == q[5] or (same_block and p[4] >= q[4]):
                continue
            if forest:
                u, v = root(p[5]), root(q[5])
                if u == v:
                    continue
                tree[u] = v
            a.append(min(p[4], q[4]))
            b.append(max(p[4], q[4]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    a, b = group(held)
                    out[0].extend(a)
                    out[1].extend(b)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in group(held)], names=["a", "b"])

    pairs = rows.mapInArrow(run, "a binary, b binary").distinct()
    return pairs.join(sized(tested, tested.count()), ["a", "b"], "left_anti")


def classified(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, node, class_id and class_size for every document, and `first`: whether its class is named after a row of this id and text."""
    spark = docs.sparkSession
    sketched = stored(sketch(docs), "sketches")
    nodes = stored(sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    members = stored(keyed.join(buckets, "key"), "members")
    tested = star = result(spark, "star", lambda: likely(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), nodes))
    found = result(spark, "edges", lambda: verified(docs, nodes, star, similarity))
    labels = result(spark, "labels", lambda: components(found))
    for forest in (*[True] * FORESTS, False):
        more = result(spark, "across", lambda: across(docs, members, labels, nodes, tested, forest))  # noqa: B023  run at once
        if not more.isEmpty():
            found = result(spark, "edges", lambda: verified(docs, nodes, more, similarity))  # noqa: B023
            labels, tested = result(spark, "labels", lambda: components(found, labels)), tested.unionByName(more)  # noqa: B023
    labelled = nodes.select("node", "doc_id", "copies").join(sized(labels, labels.count()), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("named")
    classes = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), named)
    of_node = labelled.select("node", "label").join(classes, "label").select("node", "class_id", "class_size", (F.col("node") == F.col("named.node")).alias("first"))
    rows = sketched.select("doc_id", "node").join(stored(of_node, "classes"), "node")
    return rows.select("doc_id", "node", "class_id", "class_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for every document: doc_id, class_id (the class's least doc_id) and class_size (its rows).

    Classes are the components of the links between documents whose five-word multisets overlap by
    `similarity` or more; the same texts are always in one class. Words are runs of letters and
    digits, in lower case; a text of 1 to 4 words is one shingle. Texts without a word, null texts
    counting as empty, are alike only if they are the same. Null ids keep a row and never name a
    class unless it has no other. Other columns are not read. An empty table gives no row.
    """
    return result(docs.sparkSession, "document-classes", lambda: classified(docs, similarity).select("doc_id", "class_id", "class_size"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with all its columns, one row of each class: of its least doc_id, and there of the least digest of the text.

    Rows are told apart by doc_id and text: of rows that repeat both, one stays. Rows with a null
    doc_id stay only if their class has no other. Only rows that may go meet in a shuffle; the
    others are told by a broadcast filter of bounded size and stay where they are.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    row_key = lambda node: F.concat(node, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    key = fresh(docs, "row_key")

    def told() -> DataFrame:
        rows = classified(docs, similarity).groupBy(row_key(F.col("node")).alias(key)).agg(F.first("first").alias("first"), F.count("*").alias("n"))
        return rows.where("n > 1 or not first").select(key, "first")

    special = result(docs.sparkSession, "special-rows", told)
    n = special.count()
    if not n:
        return docs
    alone, rest = parted(docs.withColumn(key, row_key(digest)), key, special.select(key), n)
    rest = rest.dropDuplicates([key]).join(special.where("not first").select(key), key, "left_anti").select(*alone.columns)
    return alone.unionByName(rest).drop(key)
