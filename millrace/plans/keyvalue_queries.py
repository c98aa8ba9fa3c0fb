"""Queries of the key-value commands over the tables in key-value shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import great_circle_m
from ..operators import keyvalue as K
from .registry import query, table


def nation_strings(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))


def customer_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in ("c_name", "c_mktsegment", "c_nationkey")))
    return c.select(F.col("c_custkey").alias("key"), F.explode(fields).alias("f")).select("key", "f.*")


def turn_lists(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.md5(F.concat_ws("|", "role", F.col("turn").cast("string"))).alias("value"))


_LISTS = "l AS (SELECT conv_id AS key, turn AS pos, md5(concat_ws('|', role, turn)) AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def supplier_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_partkey").alias("member")).distinct()


_SETS = "s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS key, l_partkey AS member FROM lineitem)"


def part_zsets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").cast("string").alias("member"), F.col("p_retailprice").alias("score"))


_ZSETS = "z AS (SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS member, p_retailprice AS score FROM part)"


@query("SELECT k.pos, k.key, n_name AS value FROM (VALUES (0,'3'),(1,'99'),(2,'7'),(3,'3')) k(pos,key) LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = k.key")
def kv_mget(spark, sf_dir):
    return K.mget(spark.createDataFrame([(0, "3"), (1, "99"), (2, "7"), (3, "3")], "pos int, key string"), nation_strings(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (VALUES ('3'),('99'),('7'),('3')) k(key) WHERE key IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def kv_exists_count(spark, sf_dir):
    return K.exists_count(spark.createDataFrame([("3",), ("99",), ("7",), ("3",)], "key string"), nation_strings(spark, sf_dir))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS value FROM nation UNION ALL SELECT '77', 'new'")
def kv_set(spark, sf_dir):
    return K.upsert(nation_strings(spark, sf_dir), spark.createDataFrame([("3", "three"), ("77", "new")], "key string, value string"), ["key"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation UNION ALL SELECT '77', 'new'")
def kv_setnx(spark, sf_dir):
    return K.set_if_absent(nation_strings(spark, sf_dir), spark.createDataFrame([("3", "three"), ("77", "new")], "key string, value string"), ["key"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS value FROM nation")
def kv_replace(spark, sf_dir):
    return K.replace_existing(nation_strings(spark, sf_dir), spark.createDataFrame([("3", "three"), ("77", "new")], "key string, value string"), ["key"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey >= 10")
def kv_del(spark, sf_dir):
    return K.delete(nation_strings(spark, sf_dir), spark.range(10).select(F.col("id").cast("string").alias("key")), ["key"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, concat(n_name, CASE WHEN n_regionkey = 1 THEN '!' ELSE '' END) AS value FROM nation")
def kv_append(spark, sf_dir):
    parts = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("!").alias("part"))
    return K.append(nation_strings(spark, sf_dir), parts)


@query("SELECT user_id AS key, CAST(sum(CASE WHEN event_type = 'error' THEN -2 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY 1")
def kv_incrby(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ops = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", -2).otherwise(1).alias("delta"))
    return K.increment(e.select(F.col("user_id").alias("key"), F.lit(0).alias("value")).distinct(), ops, ["key"])


@query("SELECT user_id AS key, CAST(greatest(100 - count(*), 0) AS BIGINT) AS value FROM events GROUP BY 1")
def kv_memcache_decr(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    return K.decrement_to_zero(e.distinct().withColumn("value", F.lit(100)), e.withColumn("delta", F.lit(1)))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE n_name END AS value, CAST(n_nationkey % 2 AS INTEGER) + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS version FROM nation")
def kv_cas(spark, sf_dir):
    rows = nation_strings(spark, sf_dir).withColumn("version", (F.col("key").cast("int") % 2).cast("int"))
    return K.compare_and_set(rows, rows.select("key", F.lit("x").alias("value"), F.lit(0).alias("version")))


@query("SELECT n_nationkey AS key, CAST(CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE n_nationkey * 60 END AS BIGINT) AS ttl FROM nation")
def kv_ttl(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.timestamp_seconds(F.unix_seconds(now) + F.col("n_nationkey") * 60)).alias("expire_at"))
    return K.ttl(rows, now)


@query("SELECT n_nationkey AS key, substr(n_name, 2, 3) AS head, right(n_name, 3) AS tail, octet_length(CAST(n_name AS BLOB)) AS length FROM nation")
def kv_getrange(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("key"), K.get_range(F.col("n_name"), 1, 3).alias("head"), K.get_range(F.col("n_name"), -3, -1).alias("tail"), F.octet_length("n_name").cast("bigint").alias("length"))


@query("SELECT n_nationkey AS key, concat('AB', substr(n_name, 3)) AS value FROM nation")
def kv_setrange(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), K.set_range(F.col("n_name"), 0, "AB").alias("value"))


@query("SELECT n_nationkey AS key, CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: bit_count(ascii(c)))) AS BIGINT) AS ones FROM nation")
def kv_bitcount(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), K.bit_count(F.col("n_name")).alias("ones"))


@query("SELECT n_nationkey AS key, (ascii(n_name) >> 5) & 1 AS bit, 1 AS first_one FROM nation")
def kv_getbit(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), K.get_bit(F.col("n_name"), 2).alias("bit"), K.bit_position(F.col("n_name"), 1).alias("first_one"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1_'")
def kv_keys(spark, sf_dir):
    return K.keys_like(nation_strings(spark, sf_dir), "1?")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE CAST(n_nationkey AS VARCHAR) > '14' ORDER BY 1 LIMIT 5")
def kv_scan(spark, sf_dir):
    return K.scan(nation_strings(spark, sf_dir), "14", 5)


@query("SELECT c_custkey AS key, c_mktsegment AS seg, c_name AS name, CAST(3 AS BIGINT) AS n FROM customer")
def kv_hgetall(spark, sf_dir):
    h = customer_hashes(spark, sf_dir)
    return K.hgetall(h).join(K.hlen(h), "key").select("key", F.col("fields")["c_mktsegment"].alias("seg"), F.col("fields")["c_name"].alias("name"), "n")


@query("SELECT c_custkey AS key, c_name, c_mktsegment FROM customer")
def kv_hmget(spark, sf_dir):
    return K.hmget(customer_hashes(spark, sf_dir), ["c_name", "c_mktsegment"])


@query(f"WITH {_LISTS} SELECT key, CAST(i AS INTEGER) AS idx, value FROM l WHERE i >= greatest(n - 3, 0)")
def kv_lrange(spark, sf_dir):
    return K.lrange(turn_lists(spark, sf_dir), -3, -1)


@query(f"WITH {_LISTS} SELECT key, pos, value FROM l WHERE i BETWEEN 1 AND n - 2")
def kv_ltrim(spark, sf_dir):
    return K.ltrim(turn_lists(spark, sf_dir), 1, -2)


@query(f"WITH {_LISTS} SELECT key, value FROM l WHERE i = n - 1")
def kv_lindex(spark, sf_dir):
    return K.lindex(turn_lists(spark, sf_dir), -1)


@query(f"WITH {_LISTS} SELECT key, pos, value FROM l WHERE i > 0")
def kv_lpop(spark, sf_dir):
    return K.pop(turn_lists(spark, sf_dir))[1]


@query(f"WITH {_LISTS}, e AS (SELECT key, max(pos) AS b FROM l GROUP BY 1) SELECT key, pos, value FROM l UNION ALL SELECT key, b + 1 + m, concat('new', m) FROM e, (VALUES (0),(1)) t(m)")
def kv_rpush(spark, sf_dir):
    lists = turn_lists(spark, sf_dir)
    new = lists.select("key").distinct().select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).withColumn("value", F.concat(F.lit("new"), F.col("n").cast("string")))
    return K.push(lists, new)


@query(f"WITH {_SETS} SELECT member FROM s WHERE key = '1' INTERSECT SELECT member FROM s WHERE key = '2'")
def kv_sinter(spark, sf_dir):
    return K.sinter(supplier_sets(spark, sf_dir), ["1", "2"])


@query(f"WITH {_SETS} SELECT DISTINCT member FROM s WHERE key IN ('1','2','3')")
def kv_sunion(spark, sf_dir):
    return K.sunion(supplier_sets(spark, sf_dir), ["1", "2", "3"])


@query(f"WITH {_SETS} SELECT member FROM s WHERE key = '1' EXCEPT SELECT member FROM s WHERE key IN ('2','3')")
def kv_sdiff(spark, sf_dir):
    return K.sdiff(supplier_sets(spark, sf_dir), "1", ["2", "3"])


@query(f"WITH {_SETS} SELECT key, count(*) AS n FROM s GROUP BY 1")
def kv_scard(spark, sf_dir):
    return K.scard(supplier_sets(spark, sf_dir))


@query(f"WITH {_ZSETS} SELECT key, member, score, CAST(row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS INTEGER) AS rank FROM z WHERE score BETWEEN 905 AND 950")
def kv_zrangebyscore(spark, sf_dir):
    return K.zrange_by_score(part_zsets(spark, sf_dir), 905, 950)


@query(f"WITH {_ZSETS} SELECT key, member, CAST(row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS INTEGER) AS rank FROM z")
def kv_zrank(spark, sf_dir):
    return K.ranked(part_zsets(spark, sf_dir)).select("key", "member", "rank")


@query(f"WITH {_ZSETS} SELECT key, member, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM z) WHERE r < 3")
def kv_zrevrange(spark, sf_dir):
    return K.zrange(part_zsets(spark, sf_dir), 0, 2, descending=True)


@query(f"WITH {_ZSETS} SELECT key, count(*) AS n FROM z WHERE score BETWEEN 920 AND 960 GROUP BY 1")
def kv_zcount(spark, sf_dir):
    return K.zcount(part_zsets(spark, sf_dir), 920, 960)


def _brand_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_size").cast("string").alias("member")).agg(F.count("*").cast("double").alias("score"))


_BRANDS = "b AS (SELECT p_brand AS key, CAST(p_size AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM part GROUP BY 1,2), two AS (SELECT min(key) AS lo, max(key) AS hi FROM b)"


@query(f"WITH {_BRANDS} SELECT member, sum(CASE WHEN key = lo THEN 2*score ELSE 3*score END) AS score FROM b, two WHERE key IN (lo, hi) GROUP BY 1")
def kv_zunion(spark, sf_dir):
    z = _brand_scores(spark, sf_dir)
    lo, hi = z.agg(F.min("key"), F.max("key")).first()
    return K.zunion(z, {lo: 2.0, hi: 3.0})


@query(f"WITH {_BRANDS} SELECT member, max(score) AS score FROM b, two WHERE key IN (lo, hi) GROUP BY 1 HAVING count(DISTINCT key) = 2")
def kv_zinter(spark, sf_dir):
    z = _brand_scores(spark, sf_dir)
    lo, hi = z.agg(F.min("key"), F.max("key")).first()
    return K.zunion(z, {lo: 1.0, hi: 1.0}, "max", every=True)


_PLACES = "p AS (SELECT s_suppkey AS member, CAST((s_suppkey * 7919) % 36000 AS DOUBLE)/100 - 180 AS lon, CAST((s_suppkey * 104729) % 17000 AS DOUBLE)/100 - 85 AS lat FROM supplier)"
_METRES = "2*6372797.560856*asin(sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2)))"


def places(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("member"), (((s * 7919) % 36000).cast("double") / 100 - 180).alias("lon"), (((s * 104729) % 17000).cast("double") / 100 - 85).alias("lat"))


@query(f"WITH {_PLACES} SELECT b.member, round({_METRES}, 1) AS metres FROM p b, (SELECT * FROM p WHERE member = 1) a")
def kv_geodist(spark, sf_dir):
    p = places(spark, sf_dir)
    one = p.where("member = 1").first()
    return p.select("member", F.round(great_circle_m(F.lit(one.lon), F.lit(one.lat), F.col("lon"), F.col("lat")), 1).alias("metres"))


@query(f"WITH {_PLACES} SELECT b.member, round({_METRES}, 1) AS metres FROM p b, (SELECT 10.0 AS lon, 20.0 AS lat) a WHERE {_METRES} <= 5000000")
def kv_georadius(spark, sf_dir):
    return K.geo_radius(places(spark, sf_dir), 10.0, 20.0, 5_000_000).select("member", F.round("metres", 1).alias("metres"))


@query(f"WITH {_PLACES} SELECT member, lon, lat FROM p WHERE member % 2 = 0 UNION ALL SELECT -s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey > 0")
def kv_geopos(spark, sf_dir):
    p = places(spark, sf_dir).where("member % 2 = 0")
    return K.geo_positions(p.select("member").union(p.where("member > 0").select(-F.col("member"))), p)


@query(f"WITH {_PLACES} SELECT b.member, round({_METRES}, 1) AS metres FROM p b, (SELECT * FROM p WHERE member = 1) a WHERE {_METRES} <= 6000000")
def kv_georadiusbymember(spark, sf_dir):
    return K.geo_radius_by_member(places(spark, sf_dir), 1, 6_000_000).select("member", F.round("metres", 1).alias("metres"))


_CELLS = "CAST(least(floor((lon + 180) / 360 * 268435456), 268435455) AS BIGINT) AS x, CAST(least(floor((lat + 90) / 180 * 134217728), 134217727) AS BIGINT) AS y"


@query(f"""WITH {_PLACES}, c AS (SELECT member, {_CELLS} FROM p), b AS (SELECT member, k, CASE WHEN k % 2 = 0 THEN (x >> (27 - k // 2)) & 1 ELSE (y >> (26 - k // 2)) & 1 END AS bit FROM c, range(55) t(k)),
  v AS (SELECT member, k // 5 AS place, CAST(sum(bit << (4 - k % 5)) AS BIGINT) AS v FROM b GROUP BY 1, 2)
  SELECT member, string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', v + 1, 1), '' ORDER BY place) AS geohash FROM v GROUP BY 1""")
def kv_geohash(spark, sf_dir):
    return places(spark, sf_dir).select("member", K.geohash(F.col("lon"), F.col("lat")).alias("geohash"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def kv_json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT o_orderkey, CAST(1 + o_orderkey % 3 AS INTEGER) AS n FROM orders")
def kv_json_arrlen(spark, sf_dir):
    a = F.to_json(F.slice(F.array(F.col("o_orderkey"), F.col("o_custkey"), F.lit(1)), 1, (1 + F.col("o_orderkey") % 3).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.json_array_length(a).alias("n"))


@query("SELECT event_id, 1 AS n, 'k' AS first FROM events")
def kv_json_objkeys(spark, sf_dir):
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).alias("n"), keys[0].alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t FROM events")
def kv_json_set(spark, sf_dir):
    doc = K.json_set_field(F.col("props"), "t", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", doc.alias("d")).select("event_id", F.get_json_object("d", "$.k").alias("k"), F.get_json_object("d", "$.t").alias("t"))
