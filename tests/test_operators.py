import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import consistency, crdt, index2i, keyvalue, metrics, placement
from millrace.operators import mapreduce as M
from millrace.sources import generators, objects


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def states(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randrange(3), str(rng.randrange(3)), rng.randrange(50), rng.randrange(20)) for _ in range(60)], "key int, actor string, pos int, neg int")


def test_counter_merge_laws(states):
    a, b, c = (states.where(F.col("pos") % 3 == i) for i in range(3))
    merged = lambda *parts: values(crdt.counter_value(M_union(parts)), "key", "value")
    assert merged(a, b, c) == merged(c, a, b) == merged(a, b, c, a, a)
    half = crdt.counter_merge(a.unionByName(b)).select(*a.columns)
    assert merged(half, c) == merged(a, b, c)


def M_union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_set_add_wins_over_an_unseen_removal(spark):
    ops = [("k", "x", "a", "add", 1), ("k", "x", "b", "remove", 2), ("k", "x", "a", "add", 3), ("k", "y", "a", "add", 1), ("k", "y", "b", "remove", 2), ("k", "z", "b", "remove", 1)]
    s = crdt.set_states(spark.createDataFrame(ops, "key string, element string, actor string, kind string, at int"), ["at"])
    assert values(crdt.set_value(s), "element") == [("x",)]
    assert values(crdt.set_value(s.unionByName(s)), "element") == [("x",)]


def test_register_order(spark):
    rows = [("k", "old", 1, "a"), ("k", "new", 2, None), ("k", "tie", 2, "a"), ("k", "win", 2, "b")]
    assert crdt.register_value(spark.createDataFrame(rows, "key string, v string, ts int, actor string"), "key", "v", "ts", ["actor"]).first().value == "win"


def test_symmetric_difference_both_ways(spark):
    rng = random.Random(2)
    a = {i: rng.randrange(5) for i in range(300)}
    b = {i: (v + (rng.random() < 0.05)) for i, v in a.items() if rng.random() > 0.05} | {i: 1 for i in range(300, 310)}
    x, y = (spark.createDataFrame(list(d.items()), "k int, v int") for d in (a, b))
    want = sorted(k for k in {*a, *b} if a.get(k) != b.get(k))
    assert [r.k for r in consistency.symmetric_difference(x, y, "k", "v").orderBy("k").collect()] == want
    assert [r.k for r in consistency.exchange(x, y, "k", "v", 16).orderBy("k").collect()] == want
    assert consistency.reconcile(x, y, "k").count() == len({*a, *b})


def test_xor_tree_is_idempotent(spark):
    rows = spark.createDataFrame([(i, i % 3, i * 1000) for i in range(50)], "k int, v int, s long")
    tree = lambda d: values(consistency.xor_tree(d, F.col("k"), F.col("v"), F.col("s")), "bucket", "segment", "hash")
    assert tree(rows) == tree(rows.unionByName(rows))


def test_as_of(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, at int, v string")
    assert values(consistency.as_of(v, "k", "at", 5, ["v"]), "k", "v") == [("a", "y")]


def test_quorum(spark):
    """Only replies of the local datacenter vote; of all, where it has no target."""
    r = [(1, "p", "x", "a", 3), (1, "q", "x", "b", 1), (1, "r", "x", "a", 2), (1, "s", "y", "b", 0), (1, "t", "y", "b", 0), (2, "p", "x", "a", 2), (2, "q", "x", "b", 1), (2, "s", "y", "a", 0)]
    r += [(3, "s", "y", "c", 1), (4, "p", "x", None, 0), (4, "q", "x", "d", 1), (4, "r", "x", "d", 2), (5, "p", "x", None, 0)]
    r = spark.createDataFrame(r, "req int, peer string, dc string, reply string, at int")
    q = consistency.quorum(r, "req", "reply", "dc", "x", "at")
    assert values(q, "req", "reply", "votes", "peers", "majority") == [(1, "a", 2, 3, True), (2, "b", 1, 2, False), (3, "c", 1, 1, True), (4, "d", 2, 3, True)]
    assert values(consistency.divergent(r.where("req < 3"), q, "req", "reply"), "req", "peer") == [(1, "q"), (1, "s"), (1, "t"), (2, "p"), (2, "s")]
    agreed = {k: v for k, v in values(consistency.all_agree(r, "req", "reply", "dc", "x"), "req", "reply")}
    assert agreed == {1: None, 2: None, 3: "c", 4: None, 5: None}


def test_repair_by_clock(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, clock map<string,int>, v string")
    ours = side([(1, {"a": 2}, "x"), (2, {"a": 1}, "x"), (3, {"a": 2, "b": 1}, "x"), (4, {"a": 1}, "x"), (5, {"a": 1}, "x"), (6, {"a": 1}, "x")])
    theirs = side([(1, {"a": 1}, "y"), (2, {"a": 1, "b": 1}, "y"), (3, {"a": 1, "b": 2}, "y"), (4, {"a": 1}, "x"), (5, {"a": 1}, "y"), (7, {"c": 1}, "y")])
    got = values(consistency.repairs_by_clock(ours, theirs, "k", "clock", "v"), "k", "action", "winner")
    assert got == [(1, "push", "x"), (2, "pull", "y"), (3, "ambiguous", None), (5, "ambiguous", None), (6, "push", "x"), (7, "pull", "y")]


def test_ring(spark):
    ring = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "peer string, token long")
    keys = spark.createDataFrame([(1, 15), (2, 35), (3, 10), (4, 30), (5, 0)], "k int, h long")
    assert values(placement.owner(keys, "h", ring), "k", "peer") == [(1, "b"), (2, "a"), (3, "a"), (4, "c"), (5, "a")]
    assert values(placement.replicas(keys.where("k = 4"), "k", "h", ring, 2), "replica", "peer") == [(0, "c"), (1, "a")]
    assert values(placement.preference(keys.where("k = 4"), "k", "h", ring, ["a", "b"], 2), "place", "peer", "role") == [(0, "a", "primary"), (1, "b", "fallback")]


def test_histogram_offsets():
    o = metrics.offsets()
    assert len(o) == 94 and o[:8] == [1, 2, 3, 4, 5, 6, 7, 8] and all(b > a for a, b in zip(o, o[1:], strict=False))


def test_mapreduce(spark):
    d = spark.createDataFrame([('{"a": 3}',), ('{"a": 4}',), ("[1, 2]",), ("null",), (None,)], "value string")
    assert values(M.extract_field("a")(d), "value") == [("3",), ("4",), (None,), (None,), (None,)]
    assert values(M.object_value_list(d.where("value like '[%' or value = 'null' or value is null")), "value") == [("1",), ("2",)]
    numbers = lambda *v: M.reduce_sum(spark.createDataFrame([(x,) for x in v], "value string")).first().value
    assert numbers("1", "2", "null") == "3" and numbers("1", "2.5") == "3.5" and numbers("null") == "0"
    with pytest.raises(Exception, match="not a number"):
        numbers("1", '"x"')
    with pytest.raises(Exception, match="(?i)overflow"):
        numbers(str(2**63 - 1), "1")
    order = [r.value for r in M.reduce_sort(spark.createDataFrame([(x,) for x in ('"b"', "10", "9", "true", "null", "[1]", "{}", '"a"')], "value string")).collect()]
    assert order == ["null", "true", "9", "10", '"a"', '"b"', "[1]", "{}"]


def test_link_walk(spark):
    links = [[("people", "b", "friend"), ("people", "c", "friend"), ("people", "d", "other"), ("people", "gone", "friend")]]
    d = spark.createDataFrame([(x,) for x in links], "links array<struct<bucket:string,key:string,tag:string>>")
    people = spark.createDataFrame([("people", k) for k in "bcd"], "bucket string, key string")
    assert values(M.link_walk(d, people, tag="friend"), "key") == [("b",), ("c",)]
    assert values(M.link_walk(d, people), "key") == [("b",), ("c",), ("d",)]


def test_secondary_index(spark):
    people = spark.createDataFrame([("alice", "10"), ("bob", "15"), ("carol", "20"), ("dave", "25"), ("erin", "30"), ("frank", "-1"), ("gina", "x")], "k string, age string")
    table = index2i.entries(people, "p", "k", {"age_int": "age", "age_bin": "age"})
    assert [r.key for r in index2i.between(table, "age_int", 15, 25).collect()] == ["bob", "carol", "dave"]
    assert [r.key for r in index2i.between(table, "age_int", 0, 99, 2).collect()] == ["alice", "bob"]
    assert [r.key for r in index2i.equal(table, "age_bin", "x").collect()] == ["gina"]
    assert table.where("index = 'age_int'").count() == 5


def test_lists(spark):
    lists = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcab")], "key string, pos int, value string")
    assert [r.value for r in keyvalue.lrange(lists, -2, -1).orderBy("idx").collect()] == ["a", "b"]
    assert [r.value for r in keyvalue.lrange(lists, 1, 99).orderBy("idx").collect()] == list("bcab")
    assert keyvalue.lrange(lists, 3, 1).collect() == []
    assert [r.value for r in keyvalue.lrem(lists, "a", 1).orderBy("pos").collect()] == list("bcab")
    assert [r.value for r in keyvalue.lrem(lists, "a", -1).orderBy("pos").collect()] == list("abcb")
    assert [r.value for r in keyvalue.lrem(lists, "a", 0).orderBy("pos").collect()] == list("bcb")
    new = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y"), ("n", 0, "z")], "key string, n int, value string")
    assert [r.value for r in keyvalue.push(lists, new, left=True).where("key = 'k'").orderBy("pos").collect()] == list("yxabcab")
    assert keyvalue.lindex(lists, -1).first().value == "b" and keyvalue.pop(lists, right=True)[0].first().value == "b"


def test_geohash_and_distance(spark):
    df = spark.createDataFrame([("k", 13.361389, 38.115556)], "key string, lon double, lat double")
    other = spark.createDataFrame([("k", 15.087269, 37.502669)], "key string, lon double, lat double")
    assert df.select(keyvalue.geohash(F.col("lon"), F.col("lat"))).first()[0].startswith("sqc8b49rn")
    assert abs(keyvalue.geo_distance(df, other).first().metres - 166274.1516) < 0.5


def test_bits(spark):
    df = spark.createDataFrame([("foobar",)], "v string")
    assert df.select(keyvalue.bit_count(F.col("v")), keyvalue.get_bit(F.col("v"), 1), keyvalue.bit_position(F.col("v"), 0)).first() == (26, 1, 0)


def test_transactions(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    ops = [(1, "put", "a", 9, False, 1), (1, "delete", "b", None, False, 2), (2, "put", "c", 5, False, 3), (2, "put", "d", 6, True, 4)]
    batches = spark.createDataFrame(ops, "txn int, kind string, key string, value int, abort boolean, at int")
    assert values(objects.apply_batches(base, batches, ["at"]), "key", "value") == [("a", 9)]


def test_generators(spark):
    for kind in ("sequential", "uniform", "pareto", "normal", "fixed"):
        k = generators.keys(spark, 2000, kind, 100).agg(F.min("key"), F.max("key"), F.count("*")).first()
        assert 0 <= k[0] and k[1] <= 100 and k[2] == 2000
    v = generators.values(spark.range(500), "uniform", 20).agg(F.min(F.length("value")), F.max(F.length("value"))).first()
    assert 1 <= v[0] and v[1] <= 20


def test_save_load_report(spark, tmp_path):
    df = spark.createDataFrame([("b1", "k1", '{"x": 1}'), ("b1", "k2", "no json"), ("b2", "k1", "[1]")], "bucket string, key string, value string")
    objects.save(df, f"{tmp_path}/o", ["bucket"])
    back = objects.load(spark, f"{tmp_path}/o")
    assert values(objects.scan_prefix(back, "b1", "k"), "key") == [("k1",), ("k2",)] and values(objects.buckets(back), "bucket") == [("b1",), ("b2",)]
    assert values(objects.fields(back, "value", "x int"), "key", "x") == [("k1", 1)]
    objects.report(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3


def test_clock_update(spark):
    rows = spark.createDataFrame([(5, 2, 5, 7, 5), (5, 2, 4, 7, 5), (4, 2, 5, 7, 5), (4, 2, 5, 7, 6)], "l int, c int, rl int, rc int, ms int")
    l, c = crdt.clock_update(F.col("l"), F.col("c"), F.col("rl"), F.col("rc"), F.col("ms"))  # noqa: E741
    assert [tuple(r) for r in rows.select(l, c).collect()] == [(5, 8), (5, 3), (5, 8), (6, 0)]


def test_histogram_beyond_its_last_bucket(spark):
    rows = spark.createDataFrame([("a", 7.5), ("a", 3.0), ("b", 1e18), ("c", None)], "k string, v double")
    assert {tuple(r) for r in metrics.maximum(rows, "v", ["k"]).collect()} == {("a", 7), ("b", 2**63 - 1)}
    assert {r["k"]: r["mean"] for r in metrics.mean(metrics.histogram(rows, "v", ["k"]), ["k"]).collect()} == {"a": 5.0, "b": float("inf")}


def test_written_together(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "a", 9)], "t int, k string, v int")
    assert {(r["key"], r["ts"], tuple(r["siblings"]), r["value"]) for r in consistency.written_together(rows, "t", "k", "v").collect()} == {("a", 1, ("b",), 1), ("b", 1, ("a",), 3), ("a", 2, (), 9)}
