"""Versions, snapshot and read-atomic reads, quorum votes, replica comparison and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, key: str, stamp: str, at, values: list[str]) -> DataFrame:
    """The latest version of each key whose stamp is `at` or earlier."""
    seen = versions.where(F.col(stamp) <= F.lit(at))
    return seen.groupBy(key).agg(F.max(stamp).alias(stamp), *(F.max_by(v, stamp).alias(v) for v in values))


def fractured(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """Read-atomic check: keys for which a transaction that another read saw wrote a later version.

    reads: key, ts, siblings (the keys that its transaction wrote), value. Returns each key with
    the ts to fetch, and the value that versions (key, ts, value) has for it.
    """
    needed = reads.select(F.explode("siblings").alias("key"), "ts").groupBy("key").agg(F.max("ts").alias("needed"))
    stale = reads.select("key", "ts").join(needed, "key").where(F.col("needed") > F.col("ts"))
    return stale.join(versions.select("key", F.col("ts").alias("needed"), "value"), ["key", "needed"], "left").select("key", F.col("ts").alias("read_ts"), "needed", "value")


def _voters(replies: DataFrame, request: str, dc: str, local: str) -> DataFrame:
    """The replies of the local datacenter; of all, for requests that have no target there."""
    here = (F.col(dc) == local).cast("int")
    return replies.withColumn("_local", F.max(here).over(Window.partitionBy(request))).where((here == 1) | (F.col("_local") == 0)).drop("_local")


def quorum(replies: DataFrame, request: str, reply: str, dc: str, local: str, arrival: str) -> DataFrame:
    """For each request the reply that a majority of the local peers gave, else the one that most of them gave.

    A row of replies is a target; a null reply has not come. Ties go to the reply that arrived
    first. votes says how many gave it, of how many local targets (peers). Without a local target
    all targets vote. Requests without a reply among the voters have none.
    """
    voters = _voters(replies, request, dc, local)
    votes = voters.groupBy(request, reply).agg(F.count("*").alias("votes"), F.min(arrival).alias("first"))
    w = Window.partitionBy(request)
    came = F.col(reply).isNotNull()
    ranked = votes.withColumn("peers", F.sum("votes").over(w)).withColumn("n", F.row_number().over(w.orderBy(came.desc(), F.col("votes").desc(), "first", reply)))
    return ranked.where((F.col("n") == 1) & came).select(request, reply, "votes", "peers", (F.col("votes") >= F.floor(F.col("peers") / 2) + 1).alias("majority"))


def first_reply(replies: DataFrame, request: str, reply: str, arrival: str) -> DataFrame:
    return replies.groupBy(request).agg(F.min_by(reply, arrival).alias(reply))


def all_agree(replies: DataFrame, request: str, reply: str, dc: str, local: str) -> DataFrame:
    """The reply on which all local peers agree, once all have come; null where they do not. Without a local target all targets count."""
    voters = _voters(replies, request, dc, local)
    one = (F.count_distinct(reply) == 1) & (F.count(reply) == F.count("*"))
    return voters.groupBy(request).agg(one.alias("agreed"), F.min(reply).alias("reply")).select(request, "agreed", F.when(F.col("agreed"), F.col("reply")).alias(reply))


def agree_by_datacenter(replies: DataFrame, request: str, dc: str, reply: str, local: str) -> DataFrame:
    """Whether each datacenter agrees in itself, and the local datacenter's reply if all do."""
    per_dc = replies.groupBy(request, dc).agg((F.count_distinct(reply) == 1).alias("one"), F.min(reply).alias("reply"))
    return per_dc.groupBy(request).agg(F.bool_and("one").alias("agreed"), F.max(F.when(F.col(dc) == local, F.col("reply"))).alias("local_reply")).select(request, "agreed", F.when(F.col("agreed"), F.col("local_reply")).alias(reply))


def divergent(replies: DataFrame, winners: DataFrame, request: str, reply: str) -> DataFrame:
    """Replies that differ from their request's winner."""
    return replies.join(winners.select(request, F.col(reply).alias("_won")), request).where(~F.col(reply).eqNullSafe(F.col("_won"))).drop("_won")


def entry_hash(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns' text, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 15), 16, 10).cast("long")


def xor_tree(entries: DataFrame, key: Column, version: Column, seconds: Column, window_s: int = 3600, time_buckets: int = 24, segments: int = 1024) -> DataFrame:
    """XOR of entry hashes by rolling time bucket and key segment; equal entries count once."""
    rows = entries.select((F.floor(seconds / window_s) % time_buckets).cast("int").alias("bucket"), F.pmod(entry_hash(key), F.lit(segments)).cast("int").alias("segment"), entry_hash(key, version).alias("h")).distinct()
    return rows.groupBy("bucket", "segment").agg(F.bit_xor("h").alias("hash"))


def roots(tree: DataFrame) -> DataFrame:
    return tree.groupBy("bucket").agg(F.bit_xor("hash").alias("hash"))


def diverging(ours: DataFrame, theirs: DataFrame, by: list[str]) -> DataFrame:
    """Places of the tree whose hashes differ, on either side."""
    joined = ours.withColumnRenamed("hash", "a").join(theirs.withColumnRenamed("hash", "b"), by, "full_outer")
    return joined.where(~F.col("a").eqNullSafe(F.col("b"))).select(*by)


def symmetric_difference(ours: DataFrame, theirs: DataFrame, key: str, version: str) -> DataFrame:
    """Keys that one side lacks or has in another version: key, ours, theirs, side."""
    joined = ours.select(key, F.col(version).alias("ours")).join(theirs.select(key, F.col(version).alias("theirs")), key, "full_outer")
    side = F.when(F.col("theirs").isNull(), "missing_theirs").when(F.col("ours").isNull(), "missing_ours").otherwise("different")
    return joined.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select(key, "ours", "theirs", side.alias("side"))


def exchange(ours: DataFrame, theirs: DataFrame, key: str, version: str, segments: int = 1024) -> DataFrame:
    """The same difference, narrowed first: only rows of segments whose XOR differs meet in the join."""
    place = F.pmod(entry_hash(F.col(key)), F.lit(segments)).cast("int")
    sums = lambda t: t.groupBy(place.alias("segment")).agg(F.bit_xor(entry_hash(F.col(key), F.col(version))).alias("hash"))
    wrong = F.broadcast(diverging(sums(ours), sums(theirs), ["segment"]))  # at most `segments` rows
    narrow = lambda t: t.withColumn("segment", place).join(wrong, "segment", "left_semi").drop("segment")
    return symmetric_difference(narrow(ours), narrow(theirs), key, version)


def clock_order(ours: Column, theirs: Column) -> Column:
    """`equal`, `after`, `before` or `concurrent` for two version vectors (maps of actor to counter); a missing actor counts as 0."""
    actors = F.array_union(F.map_keys(ours), F.map_keys(theirs))
    at = lambda clock, a: F.coalesce(clock[a], F.lit(0))
    ahead, behind = F.exists(actors, lambda a: at(ours, a) > at(theirs, a)), F.exists(actors, lambda a: at(ours, a) < at(theirs, a))
    return F.when(ahead & behind, "concurrent").when(ahead, "after").when(behind, "before").otherwise("equal")


def repairs_by_clock(ours: DataFrame, theirs: DataFrame, key: str, clock: str, value: str) -> DataFrame:
    """What to do for each key (key, clock, value on both sides) that differs: push or pull the later one; ambiguous where neither clock is later."""
    a, b = (t.select(key, F.col(clock).alias(f"{n}_clock"), F.col(value).alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs")))
    both = a.join(b, key, "full_outer")
    order = clock_order(F.col("ours_clock"), F.col("theirs_clock"))
    action = F.when(F.col("theirs_clock").isNull(), "push").when(F.col("ours_clock").isNull(), "pull").when(order == "after", "push").when(order == "before", "pull")
    differs = F.col("ours_clock").isNull() | F.col("theirs_clock").isNull() | (order != "equal") | ~F.col("ours").eqNullSafe(F.col("theirs"))
    return both.where(differs).select(key, F.coalesce(action, F.lit("ambiguous")).alias("action"), F.when(action == "push", F.col("ours")).when(action == "pull", F.col("theirs")).alias("winner"))


def repairs(difference: DataFrame, key: str) -> DataFrame:
    """What to do for each difference of versions that are ordered: push, pull, or take the greater version. See repairs_by_clock for clocks."""
    action = F.when(F.col("side") == "missing_theirs", "push").when(F.col("side") == "missing_ours", "pull").when(F.col("ours") > F.col("theirs"), "push").otherwise("pull")
    return difference.select(key, action.alias("action"), F.greatest("ours", "theirs").alias("winner"))


def pruned_difference(ours: DataFrame, theirs: DataFrame, key: str, version: str, levels: tuple[int, ...] = (16, 256, 4096)) -> DataFrame:
    """The same difference by a tree of key segments, coarse to fine: a segment is opened only where its parent's hashes differ.

    Each of `levels` must divide the next. What is broadcast is at most one row for each segment of the last level.
    """
    place = F.pmod(entry_hash(F.col(key)), F.lit(levels[-1])).cast("int")
    sums = [t.groupBy(place.alias("segment")).agg(F.bit_xor(entry_hash(F.col(key), F.col(version))).alias("hash")) for t in (ours, theirs)]
    open_ = None
    for n in levels:
        parts = [t.groupBy((F.col("segment") % n).alias("part")).agg(F.bit_xor("hash").alias("hash")) for t in sums]
        wrong = F.broadcast(diverging(*parts, ["part"]))
        sums = [t.withColumn("part", F.col("segment") % n).join(wrong, "part", "left_semi").drop("part") for t in sums]
        open_ = wrong
    narrow = lambda t: t.withColumn("part", place).join(open_, "part", "left_semi").drop("part")
    return symmetric_difference(narrow(ours), narrow(theirs), key, version)


def reconcile(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Our rows and those that we lack."""
    return ours.unionByName(theirs.join(ours.select(key), key, "left_anti"))


def merkle_segments(rows: DataFrame, key: str, version: str, segments: int) -> DataFrame:
    """A hash for each segment of keys, the XOR of its entries' hashes, in one level; and how many keys it has."""
    place = F.pmod(entry_hash(F.col(key)), F.lit(segments)).cast("int")
    return rows.groupBy(place.alias("segment")).agg(F.bit_xor(entry_hash(F.col(key), F.col(version))).alias("hash"), F.count("*").alias("keys"))


def ship(states: DataFrame, acknowledged: DataFrame, replica: str, seq: str, size: str) -> DataFrame:
    """For each replica the bytes of its delta and of the full state, and which to send: a delta if it acknowledged any."""
    total = states.agg(F.sum(size).alias("full_bytes"))
    delta = acknowledged.join(states, states[seq] > acknowledged["acked"], "left").groupBy(replica, "acked").agg(F.coalesce(F.sum(size), F.lit(0)).alias("delta_bytes"))
    return delta.crossJoin(F.broadcast(total)).select(replica, "delta_bytes", "full_bytes", F.when(F.col("acked") >= 0, "delta").otherwise("full").alias("plan"))


def written_together(writes: DataFrame, txn: str, key: str, value: str) -> DataFrame:
    """Versions (key, ts, siblings, value) of read-atomic writes: ts is the transaction, siblings its other keys in order.

    Of a key written twice in a transaction the greatest value stays. A transaction's keys are
    gathered in one row, as each of its versions carries them.
    """
    once = writes.groupBy(F.col(txn).alias("ts"), F.col(key).alias("key")).agg(F.max(value).alias("value"))
    keys = once.groupBy("ts").agg(F.sort_array(F.collect_list("key")).alias("siblings"))
    return once.join(keys, "ts").select("key", "ts", F.array_remove("siblings", F.col("key")).alias("siblings"), "value")
