"""Commands over key-value data as relational operations on long tables.

Tables: strings (key, value, expire_at), hashes (key, field, value), lists (key, pos, value),
sets (key, member), sorted sets (key, member, score), places (key, member, lon, lat) and JSON
documents (key, doc). Reads give rows; writes give the new table. A write is an operation on the
whole table, so many commands of one kind run as one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import great_circle_m, slice_bounds


# strings


def live(strings: DataFrame, now: Column) -> DataFrame:
    return strings.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def mget(keys: DataFrame, strings: DataFrame) -> DataFrame:
    """keys (pos, key) with their values, null where there is none."""
    return keys.join(strings.select("key", "value"), "key", "left").select("pos", "key", "value")


def exists_count(keys: DataFrame, strings: DataFrame) -> DataFrame:
    """How many of the keys exist; a key asked twice counts twice."""
    return keys.join(strings.select("key"), "key", "left_semi").agg(F.count("*").alias("n"))


def upsert(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """new rows, and the old ones whose key is not among them (SET, MSET, HSET, ZADD)."""
    return table.join(new.select(*by), by, "left_anti").unionByName(new, allowMissingColumns=True)


def set_if_absent(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """SETNX, HSETNX, add: only new keys."""
    return table.unionByName(new.join(table.select(*by), by, "left_anti"), allowMissingColumns=True)


def replace_existing(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """replace, LPUSHX and the like: only keys that exist."""
    return upsert(table, new.join(table.select(*by).distinct(), by, "left_semi"), by)


def delete(table: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """DEL, UNLINK, HDEL, SREM, ZREM."""
    return table.join(gone.select(*by).distinct(), by, "left_anti")


def increment(table: DataFrame, ops: DataFrame, by: list[str], value: str = "value", delta: str = "delta", kind: str = "bigint") -> DataFrame:
    """INCR, DECR, INCRBY, INCRBYFLOAT, HINCRBY, ZINCRBY: sums of deltas added to what is there or to 0."""
    d = ops.groupBy(*by).agg(F.sum(delta).alias("_d"))
    old = table.select(*by, F.col(value).cast(kind).alias("_v"))
    return old.join(d, by, "full_outer").select(*by, (F.coalesce("_v", F.lit(0)) + F.coalesce("_d", F.lit(0))).cast(kind).alias(value))


def decrement_to_zero(table: DataFrame, ops: DataFrame) -> DataFrame:
    """memcache decr: never below 0."""
    return increment(table, ops.withColumn("delta", -F.col("delta")), ["key"]).withColumn("value", F.greatest("value", F.lit(0)))


def append(table: DataFrame, parts: DataFrame, before: bool = False) -> DataFrame:
    """APPEND, prepend."""
    both = [F.coalesce("part", F.lit("")), F.coalesce("value", F.lit(""))]
    return table.select("key", "value").join(parts.select("key", "part"), "key", "full_outer").select("key", F.concat(*(both if before else both[::-1])).alias("value"))


def compare_and_set(table: DataFrame, new: DataFrame) -> DataFrame:
    """cas: new (key, value, version) replaces a row only if it has that version; the version then rises."""
    j = table.join(new.select("key", F.col("value").alias("_v"), F.col("version").alias("_n")), "key", "left")
    hit = F.coalesce(F.col("_n") == F.col("version"), F.lit(False))
    return j.select("key", F.when(hit, F.col("_v")).otherwise(F.col("value")).alias("value"), (F.col("version") + hit.cast("int")).alias("version"))


def expire(table: DataFrame, ops: DataFrame) -> DataFrame:
    """EXPIRE, EXPIREAT, PERSIST, touch: ops (key, at), at null for no expiry."""
    return table.join(ops.withColumn("_o", F.lit(True)), "key", "left").select("key", "value", F.when(F.col("_o"), F.col("at")).otherwise(F.col("expire_at")).alias("expire_at"))


def ttl(table: DataFrame, now: Column) -> DataFrame:
    """Seconds left; -1 without expiry."""
    return table.select("key", F.when(F.col("expire_at").isNull(), -1).otherwise(F.unix_seconds("expire_at") - F.unix_seconds(now)).alias("ttl"))


def get_range(value: Column, start: int, stop: int) -> Column:
    first, n = slice_bounds(start, stop, F.length(value))
    return F.substring(value, first + 1, n)


def set_range(value: Column, offset: int, part: str) -> Column:
    return F.overlay(value, F.lit(part), F.lit(offset + 1), F.lit(len(part)))


def bit_count(value: Column) -> Column:
    digits = F.split(F.hex(value.cast("binary")), "")
    ones = F.lit("0112122312232334")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, d: s + F.when(d == "", 0).otherwise(F.substring(ones, F.conv(d, 16, 10).cast("int") + 1, F.lit(1)).cast("bigint")))


def get_bit(value: Column, offset: int) -> Column:
    byte = F.conv(F.substring(F.hex(value.cast("binary")), 2 * (offset // 8) + 1, 2), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(1), F.lit(0))


def set_bit(value: Column, offset: int, bit: int) -> Column:
    """SETBIT as binary: the value with zero bytes up to the bit's, and the bit set."""
    at = offset // 8
    raw = F.coalesce(F.hex(value.cast("binary")), F.lit(""))
    raw = F.rpad(raw, F.greatest(F.length(raw), F.lit(2 * at + 2)), F.lit("0"))
    mask = 1 << (7 - offset % 8)
    old = F.conv(F.substring(raw, 2 * at + 1, 2), 16, 10).cast("int")
    new = old.bitwiseOR(mask) if bit else old.bitwiseAND(255 - mask)
    return F.unhex(F.concat(F.substring(raw, 1, 2 * at), F.lpad(F.hex(new), 2, "0"), F.substring(raw, F.lit(2 * at + 3), F.length(raw))))


def bit_position(value: Column, bit: int) -> Column:
    """BITPOS: the first place of a bit, -1 if there is none."""
    bits = F.aggregate(F.split(F.hex(value.cast("binary")), ""), F.lit(""), lambda s, d: F.concat(s, F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))))
    return F.instr(bits, str(bit)) - 1


def keys_like(table: DataFrame, glob: str) -> DataFrame:
    """KEYS: * and ? as in file names."""
    import re

    pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
    return table.where(F.col("key").rlike(f"^(?s:{pattern})$")).select("key")


def scan(table: DataFrame, cursor: str, count: int) -> DataFrame:
    """SCAN, HSCAN, SSCAN: the next rows in key order after the cursor."""
    return table.where(F.col("key") > cursor).orderBy("key").limit(count)


# hashes


def hgetall(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("n"))


def hmget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    return hashes.where(F.col("field").isin(fields)).groupBy("key").pivot("field", fields).agg(F.first("value"))


# lists


def _numbered(lists: DataFrame) -> DataFrame:
    w = Window.partitionBy("key")
    return lists.withColumn("_i", F.row_number().over(w.orderBy("pos")) - 1).withColumn("_n", F.count("*").over(w))


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """key, idx, value of the places start..stop, which may count from the end."""
    first, n = slice_bounds(start, stop, F.col("_n"))
    return _numbered(lists).where((F.col("_i") >= first) & (F.col("_i") < first + n)).select("key", F.col("_i").alias("idx"), "value")


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    first, n = slice_bounds(start, stop, F.col("_n"))
    return _numbered(lists).where((F.col("_i") >= first) & (F.col("_i") < first + n)).drop("_i", "_n")


def lindex(lists: DataFrame, i: int) -> DataFrame:
    at = F.lit(i) if i >= 0 else F.col("_n") + i
    return _numbered(lists).where(F.col("_i") == at).select("key", "value")


def push(lists: DataFrame, new: DataFrame, left: bool = False) -> DataFrame:
    """RPUSH and LPUSH of new (key, n, value), n the order of the pushes."""
    ends = lists.groupBy("key").agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    pos = F.coalesce("_a", F.lit(0)) - F.col("n") - 1 if left else F.coalesce("_b", F.lit(-1)) + F.col("n") + 1
    return lists.select("key", "pos", "value").unionByName(new.join(ends, "key", "left").select("key", pos.alias("pos"), "value"))


def pop(lists: DataFrame, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """The popped values and the lists without them."""
    n = _numbered(lists)
    at = F.col("_n") - 1 if right else F.lit(0)
    return n.where(F.col("_i") == at).select("key", "value"), n.where(F.col("_i") != at).drop("_i", "_n")


def lrem(lists: DataFrame, value, count: int) -> DataFrame:
    """The first (count > 0), last (count < 0) or all (0) equal values go."""
    order = F.col("pos") if count >= 0 else F.col("pos").desc()
    hit = F.col("value") == value
    k = F.sum(hit.cast("int")).over(Window.partitionBy("key").orderBy(order))
    return lists.withColumn("_k", k).where(~hit | (F.col("_k") > abs(count) if count else F.lit(False))).drop("_k")


# sets


def sunion(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def sinter(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(set(keys))).select("member")


def sdiff(sets: DataFrame, key: str, others: list[str]) -> DataFrame:
    return sets.where(F.col("key") == key).select("member").distinct().join(sets.where(F.col("key").isin(others)).select("member"), "member", "left_anti")


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count_distinct("member").alias("n"))


def smove(sets: DataFrame, source: str, target: str, member) -> DataFrame:
    hit = (F.col("key") == source) & (F.col("member") == member)
    return sets.withColumn("key", F.when(hit, target).otherwise(F.col("key"))).distinct()


# sorted sets


def ranked(zsets: DataFrame, descending: bool = False) -> DataFrame:
    """ZRANK and ZREVRANK: rank from 0 by score, then member."""
    order = [F.col("score").desc(), F.col("member").desc()] if descending else [F.col("score"), F.col("member")]
    return zsets.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)


def zrange(zsets: DataFrame, start: int, stop: int, descending: bool = False) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("key"))
    first, length = slice_bounds(start, stop, F.col("_n"))
    return ranked(zsets, descending).withColumn("_n", n).where((F.col("rank") >= first) & (F.col("rank") < first + length)).drop("_n")


def zrange_by_score(zsets: DataFrame, low: float, high: float, offset: int = 0, limit: int | None = None, descending: bool = False) -> DataFrame:
    """ZRANGEBYSCORE and, descending, ZREVRANGEBYSCORE; rank counts the members in the range."""
    found = ranked(zsets.where(F.col("score").between(low, high)), descending)
    return found if limit is None and not offset else found.where((F.col("rank") >= offset) & (F.col("rank") < offset + (limit if limit is not None else 1 << 60)))


def zscore(asked: DataFrame, zsets: DataFrame) -> DataFrame:
    """asked (key, member) with their scores, null where there is none."""
    return asked.join(zsets.select("key", "member", "score"), ["key", "member"], "left")


def zremove_by_score(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.where(~F.coalesce(F.col("score").between(low, high), F.lit(False)))


def zcount(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.where(F.col("score").between(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def _within(low: str, high: str) -> Column:
    """Members between two bounds: [x with x, (x without, - and + for none; a bare bound counts as [."""
    m, bare = F.col("member"), lambda x: x[1:] if x[:1] in "[(" else x
    above = F.lit(True) if low == "-" else m > bare(low) if low.startswith("(") else m >= bare(low)
    below = F.lit(True) if high == "+" else m < bare(high) if high.startswith("(") else m <= bare(high)
    return above & below


def zrange_by_lex(zsets: DataFrame, low: str, high: str, descending: bool = False) -> DataFrame:
    """ZRANGEBYLEX; descending, ZREVRANGEBYLEX with each member's rank in the range."""
    found = zsets.where(_within(low, high))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("member").desc())) - 1) if descending else found


def zlexcount(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(_within(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def zremove_by_lex(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(~_within(low, high))


def zremove_by_rank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return zsets.join(zrange(zsets, start, stop).select("key", "member"), ["key", "member"], "left_anti")


def zunion(zsets: DataFrame, weights: dict[str, float], how: str = "sum", every: bool = False) -> DataFrame:
    """ZUNIONSTORE, or with `every` ZINTERSTORE: weighted scores of the keys' members, by sum, min or max."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = zsets.where(F.col("key").isin(list(weights))).withColumn("score", F.col("score") * w[F.col("key")])
    out = rows.groupBy("member").agg({"sum": F.sum, "min": F.min, "max": F.max}[how]("score").alias("score"), F.count_distinct("key").alias("_n"))
    return (out.where(F.col("_n") == len(weights)) if every else out).drop("_n")


# places


def geo_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metres between places of a and b with the same key: (key, lon, lat) each."""
    j = a.select("key", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")).join(b.select("key", "lon", "lat"), "key")
    return j.select("key", great_circle_m(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat")).alias("metres"))


def geo_radius(places: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Members within the radius, nearest first; a box goes ahead of the exact distance."""
    box = metres / 111_000 + 0.01
    near = places.where(F.col("lat").between(lat - box, lat + box))
    d = great_circle_m(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    return near.withColumn("metres", d).where(F.col("metres") <= metres).orderBy("metres", "member")


def geo_positions(asked: DataFrame, places: DataFrame) -> DataFrame:
    """GEOPOS: the asked members with lon and lat, null where there is none."""
    return asked.join(places.select("member", "lon", "lat"), "member", "left")


def geo_radius_by_member(places: DataFrame, member, metres: float) -> DataFrame:
    """GEORADIUSBYMEMBER: members within the radius of one of them; none if there is no such member."""
    at = places.where(F.col("member") == member).first()
    return geo_radius(places, at["lon"], at["lat"], metres) if at else places.withColumn("metres", F.lit(0.0)).limit(0)


def geohash(lon: Column, lat: Column, length: int = 11) -> Column:
    """Base-32 geohash by interleaving 5 bits a character."""
    bits = length * 5
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, low, high, n: F.least(F.floor((v - low) / (high - low) * float(1 << n)), F.lit((1 << n) - 1)).cast("bigint")
    x, y = cell(lon, -180.0, 180.0, x_bits), cell(lat, -90.0, 90.0, y_bits)
    bit = lambda i: F.shiftright(x, x_bits - 1 - i // 2).bitwiseAND(1) if i % 2 == 0 else F.shiftright(y, y_bits - 1 - i // 2).bitwiseAND(1)
    chars = []
    for c in range(length):
        value = F.lit(0)
        for i in range(5 * c, 5 * c + 5):
            value = value * 2 + bit(i)
        chars.append(F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


# JSON documents


def json_type(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json(doc), path, "variant"))


def json_mget(asked: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """JSON.MGET: asked (key) with the value at the path of each key's document, null where either lacks."""
    return asked.join(docs.select("key", F.get_json_object("doc", path).alias("value")), "key", "left")


def json_length(doc: Column, path: str) -> Column:
    """JSON.OBJLEN: how many members the object at the path has; null if it is none."""
    return F.size(F.json_object_keys(F.get_json_object(doc, path)))


def _steps(path: str) -> list[str]:
    if path != "$" and not path.startswith("$."):
        raise ValueError(f"a path begins with $, not {path}")
    return path.split(".")[1:]


def _members(doc: Column) -> Column:
    """name and value (as JSON text) of an object's members, in their order."""
    # a value stands as JSON text: strings keep their quotes, numbers and inner documents their form
    names = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
    parsed = F.from_json(doc, "map<string,variant>")
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.to_json(F.struct(parsed[n].alias("v"))).alias("v")))


def _inner(boxed: Column) -> Column:
    """What stands in {"v":...}; null for {}."""
    return F.when(F.length(boxed) > 5, F.substring(boxed, F.lit(6), F.length(boxed) - 6)).otherwise(F.lit("null"))


def _object(members: Column) -> Column:
    quoted = lambda n: F.concat(_inner(F.to_json(F.struct(n.alias("v")))), F.lit(":"))
    return F.concat(F.lit("{"), F.array_join(F.transform(members, lambda m: F.concat(quoted(m["name"]), _inner(m["v"]))), ","), F.lit("}"))


def _bound(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _changed(doc: Column, steps: list[str], change) -> Column:
    """The document with `change` (of the JSON text, or null, to JSON text, or null to remove) made at the steps below it."""
    if not steps:
        return change(doc)
    name, rest = steps[0], steps[1:]

    def within(members: Column) -> Column:
        old = F.get(F.filter(members, lambda m: m["name"] == name), F.lit(0))

        def put(new: Column) -> Column:
            box = F.struct(F.lit(name).alias("name"), F.concat(F.lit('{"v":'), new, F.lit("}")).alias("v"))
            kept = F.when(new.isNull(), F.filter(members, lambda m: m["name"] != name)).when(old.isNull(), F.array_append(members, box))
            return _object(kept.otherwise(F.transform(members, lambda m: F.when(m["name"] == name, box).otherwise(m))))

        return _bound(_changed(F.when(old.isNotNull(), _inner(old["v"])), rest, change), put)

    return _bound(doc, lambda d: _bound(_members(d), within))


def json_set(doc: Column, path: str, value: Column) -> Column:
    """JSON.SET: the JSON text `value` at a path of member names; objects on the way must be there. Types and nesting stay."""
    return _changed(doc, _steps(path), lambda _: value)


def json_remove(doc: Column, path: str) -> Column:
    """JSON.DEL: the document without what stands at the path; null for the whole document."""
    return _changed(doc, _steps(path), lambda _: F.lit(None).cast("string"))


def json_array_insert(doc: Column, path: str, at: int | None, boxed: Column) -> Column:
    """JSON.ARRINSERT, and JSON.ARRAPPEND where `at` is None: an item, given as {"v": item}, in the array at the path."""

    def put(array: Column) -> Column:
        items = F.transform(F.from_json(array, "array<variant>"), lambda x: _inner(F.to_json(F.struct(x.alias("v")))))
        return F.concat(F.lit("["), F.array_join(F.array_append(items, _inner(boxed)) if at is None else F.array_insert(items, at + 1 if at >= 0 else at, _inner(boxed)), ","), F.lit("]"))

    return _changed(doc, _steps(path), put)


def json_set_field(doc: Column, name: str, value: Column) -> Column:
    """JSON.SET of a top-level field to a column's value, with its type."""
    return json_set(doc, f"$.{name}", _inner(F.to_json(F.struct(value.alias("v")))))


def json_delete_field(doc: Column, name: str) -> Column:
    return json_remove(doc, f"$.{name}")


# the rest of the commands


def hash_exists(keys: DataFrame, hashes: DataFrame) -> DataFrame:
    """HEXISTS, SISMEMBER and the like: keys (any columns) with whether the table has them."""
    by = keys.columns
    return keys.join(hashes.select(*by).distinct().withColumn("found", F.lit(True)), by, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def hstrlen(hashes: DataFrame) -> DataFrame:
    """HSTRLEN: the bytes of each field's value."""
    return hashes.select("key", "field", F.octet_length("value").alias("n"))


def hkeys(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.sort_array(F.collect_list("field")).alias("fields"))


def hvals(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("values"))


def smembers(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.sort_array(F.collect_set("member")).alias("members"))


def random_members(sets: DataFrame, n: int, seed: int) -> DataFrame:
    """SRANDMEMBER and SPOP: n members of each key, drawn by a hash with a seed, so that a task run again draws the same."""
    w = Window.partitionBy("key").orderBy(F.xxhash64("member", F.lit(seed)), "member")
    return sets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sort_values(lists: DataFrame, alpha: bool = False, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SORT: each key's values in numeric or text order, with their place."""
    v = F.col("value") if alpha else F.col("value").try_cast("double")
    w = Window.partitionBy("key").orderBy(v.desc() if descending else v, "value")
    out = lists.withColumn("place", F.row_number().over(w) - 1)
    return out.where((F.col("place") >= offset) & (F.col("place") < offset + (limit if limit is not None else 1 << 30))).select("key", "place", "value")


def lset(lists: DataFrame, i: int, value) -> DataFrame:
    at = F.lit(i) if i >= 0 else F.col("_n") + i
    return _numbered(lists).withColumn("value", F.when(F.col("_i") == at, F.lit(value)).otherwise(F.col("value"))).drop("_i", "_n")


def linsert(lists: DataFrame, pivot, value, before: bool = True) -> DataFrame:
    """The value beside the first pivot of each key; places are numbered anew."""
    n = _numbered(lists)
    first = n.where(F.col("value") == pivot).groupBy("key").agg(F.min("_i").alias("_at"))
    new = first.select("key", (F.col("_at") * 2 + (-1 if before else 1)).alias("_o"), F.lit(value).alias("value"))
    both = n.select("key", (F.col("_i") * 2).alias("_o"), "value").unionByName(new)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("_o")) - 1).select("key", "pos", "value")


def move_last(lists: DataFrame, source, target) -> DataFrame:
    """RPOPLPUSH: the source's last value becomes the target's first."""
    n = _numbered(lists)
    last = (F.col("key") == source) & (F.col("_i") == F.col("_n") - 1)
    moved = n.where(last).select(F.lit(target).alias("key"), F.lit(0).alias("n"), "value")
    return push(n.where(~last).drop("_i", "_n"), moved, left=True)


def previous_values(writes: DataFrame) -> DataFrame:
    """GETSET: what each write of (key, at, value) replaced."""
    return writes.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("at")))


def types(tables: dict[str, DataFrame]) -> DataFrame:
    """TYPE of every key, by the table that it is in."""
    out = None
    for kind, t in tables.items():
        part = t.select(F.col("key").cast("string").alias("key")).distinct().withColumn("type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def dump(rows: DataFrame, by: str = "key") -> DataFrame:
    return rows.select(by, F.to_json(F.struct(*rows.columns)).alias("payload"))


def restore(dumps: DataFrame, schema: str) -> DataFrame:
    return dumps.select(F.from_json("payload", schema).alias("r")).select("r.*")


def cardinality(sets: DataFrame) -> DataFrame:
    """PFADD and PFCOUNT: the estimate of a 14-bit sketch beside nothing else."""
    return sets.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("member", 14)).alias("n"))
