"""Further queries: the catalog, vector tables, object scans, generators and the remaining commands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import keyvalue as K
from ..operators import search as S
from ..sources import generators, objects
from .keyvalue_queries import _LISTS, _SETS, _ZSETS, customer_hashes, part_zsets, supplier_sets, turn_lists
from .registry import query, table
from .search_queries import docs_index, vec_index


@query("SELECT 'rows' AS property, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT * FROM (VALUES ('index','docs'),('key','doc_id'),('vector',''),('metric','L2'),('prefixes',''),('field:labels','TAG'),('field:lang','TAG'),('field:n_chars','NUMERIC'),('field:text','TEXT'))")
def ft_info(spark, sf_dir):
    return docs_index(spark, sf_dir).info()


@query("SELECT * FROM (VALUES ('docs'),('vecs')) t(name)")
def ft_list(spark, sf_dir):
    catalog = S.Catalog()
    for index in (vec_index(spark, sf_dir, "L2"), docs_index(spark, sf_dir)):
        catalog.create(index)
    return spark.createDataFrame([(n,) for n in catalog.names()], "name string")


@query("SELECT doc_id FROM documents")
def ft_dropindex_dd(spark, sf_dir):
    catalog = S.Catalog()
    catalog.create(docs_index(spark, sf_dir))
    return catalog.drop("docs", with_rows=True)


@query("SELECT '(NUMERIC n_chars [500 2000] AND NOT TAG lang {en})' AS plan")
def ft_explain(spark, sf_dir):
    return spark.createDataFrame([(S.explain(docs_index(spark, sf_dir), S.num("n_chars", 500, 2000) & ~S.tag("lang", ("en",))),)], "plan string")


@query("SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS event_id, min(ts) AS created, max(ts) AS updated FROM events GROUP BY 1")
def vec_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", F.col("user_id"))
    w = Window.partitionBy("key")
    rows = rows.withColumn("created", F.min("ts").over(w)).withColumn("updated", F.max("ts").over(w))
    return S.latest(rows, "key", ["ts", "event_id"]).select("key", "event_id", "created", "updated")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def vec_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return K.delete(rows.select("vec_id"), rows.where("vec_id % 7 = 0"), ["vec_id"])


def order_objects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bucket"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))


@query("SELECT o_orderstatus AS bucket, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F' AND starts_with(CAST(o_orderkey AS VARCHAR), '12')")
def obj_prefix_scan(spark, sf_dir):
    return objects.scan_prefix(order_objects(spark, sf_dir), "F", "12")


@query("SELECT DISTINCT o_orderstatus AS bucket FROM orders")
def obj_list_buckets(spark, sf_dir):
    return objects.buckets(order_objects(spark, sf_dir))


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderstatus = 'O'")
def obj_list_keys(spark, sf_dir):
    return objects.keys(order_objects(spark, sf_dir), "O")


@query("SELECT i AS id, i % 100 AS key FROM range(1000) t(i)")
def gen_sequential(spark, sf_dir):
    return generators.keys(spark, 1000, "sequential", 100)


@query()
def gen_pareto(spark, sf_dir):
    return generators.keys(spark, 1000, "pareto", 100)


@query()
def gen_values(spark, sf_dir):
    return generators.values(generators.keys(spark, 1000, "normal", 100), "exponential", 20)


@query("WITH a AS (SELECT DISTINCT o_custkey AS key, CASE WHEN o_custkey % 3 = 0 THEN 'nope' ELSE 'c_name' END AS field FROM orders UNION SELECT -n_nationkey, 'c_name' FROM nation) SELECT key, field, field = 'c_name' AND key IN (SELECT c_custkey FROM customer) AS found FROM a")
def kv_hexists(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 3 == 0, "nope").otherwise("c_name").alias("field"))
    asked = asked.union(table(spark, sf_dir, "nation").select(-F.col("n_nationkey"), F.lit("c_name"))).distinct()
    return K.hash_exists(asked, customer_hashes(spark, sf_dir))


@query("SELECT c_custkey AS key, 'c_mktsegment,c_name,c_nationkey' AS fields FROM customer")
def kv_hkeys(spark, sf_dir):
    return K.hkeys(customer_hashes(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query(f"WITH {_SETS} SELECT key, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members FROM s GROUP BY 1")
def kv_smembers(spark, sf_dir):
    return K.smembers(supplier_sets(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query()
def kv_srandmember(spark, sf_dir):
    return K.random_members(supplier_sets(spark, sf_dir), 2, 7)


@query(f"WITH {_SETS}, m AS (SELECT min(member) AS x FROM s WHERE key = '1') SELECT DISTINCT CASE WHEN key = '1' AND member = x THEN '2' ELSE key END AS key, member FROM s, m")
def kv_smove(spark, sf_dir):
    sets = supplier_sets(spark, sf_dir)
    return K.smove(sets, "1", "2", sets.where("key = '1'").agg(F.min("member")).first()[0])


@query(f"WITH {_LISTS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY value) - 1 AS INTEGER) AS place, value FROM l QUALIFY place < 2")
def kv_sort(spark, sf_dir):
    return K.sort_values(turn_lists(spark, sf_dir), alpha=True, limit=2)


@query(f"WITH {_LISTS} SELECT key, pos, CASE WHEN i = n - 1 THEN 'last' ELSE value END AS value FROM l")
def kv_lset(spark, sf_dir):
    return K.lset(turn_lists(spark, sf_dir), -1, "last")


@query(f"WITH {_LISTS}, x AS (SELECT key, CAST(i * 2 AS BIGINT) AS o, CASE WHEN i = 1 THEN 'pivot' ELSE value END AS value FROM l UNION ALL SELECT key, 1, 'new' FROM l WHERE i = 1) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS INTEGER) AS pos, value FROM x")
def kv_linsert(spark, sf_dir):
    return K.linsert(K.lset(turn_lists(spark, sf_dir), 1, "pivot"), "pivot", "new")


@query(f"WITH {_LISTS}, two AS (SELECT min(key) AS a, max(key) AS b FROM l), m AS (SELECT l.value FROM l, two WHERE key = a AND i = n - 1), p AS (SELECT min(pos) AS p FROM l, two WHERE key = b) SELECT key, pos, value FROM l, two WHERE NOT (key = a AND i = n - 1) UNION ALL SELECT b, p - 1, value FROM two, m, p")
def kv_rpoplpush(spark, sf_dir):
    lists = turn_lists(spark, sf_dir)
    a, b = lists.agg(F.min("key"), F.max("key")).first()
    return K.move_last(lists, a, b)


@query("SELECT user_id AS key, event_id AS at, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def kv_getset(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("value"))
    return K.previous_values(writes)


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key, 'hash' AS type FROM customer UNION ALL SELECT DISTINCT p_brand, 'zset' FROM part")
def kv_type(spark, sf_dir):
    return K.types({"hash": customer_hashes(spark, sf_dir), "zset": part_zsets(spark, sf_dir)})


@query("SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS member, p_retailprice AS score FROM part")
def kv_dump_restore(spark, sf_dir):
    return K.restore(K.dump(part_zsets(spark, sf_dir)), "key string, member string, score double")


@query(f"WITH {_ZSETS} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM z) WHERE r > 2")
def kv_zremrangebyrank(spark, sf_dir):
    return K.zremove_by_rank(part_zsets(spark, sf_dir), 0, 1)


@query(f"WITH {_ZSETS} SELECT key, member, score FROM z WHERE member BETWEEN '10' AND '20'")
def kv_zrangebylex(spark, sf_dir):
    return K.zrange_by_lex(part_zsets(spark, sf_dir), "10", "20")


@query(f"WITH {_SETS} SELECT key, count(*) AS exact, true AS near FROM s GROUP BY 1")
def kv_pfcount(spark, sf_dir):
    sets = supplier_sets(spark, sf_dir)
    both = K.cardinality(sets).join(K.scard(sets).withColumnRenamed("n", "exact"), "key")
    return both.select("key", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("near"))


@query("SELECT event_id, event_type = 'error' AS removed FROM events")
def kv_json_del(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.when(F.col("event_type") == "error", K.json_delete_field(F.col("props"), "k")).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object(doc, "$.k").isNull().alias("removed"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'STRING' WHEN 1 THEN 'BOOLEAN' WHEN 2 THEN 'BIGINT' ELSE 'ARRAY<BIGINT>' END AS type FROM orders")
def kv_json_type(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))).when(k == 1, "true").when(k == 2, F.col("o_custkey").cast("string")).otherwise("[1,2]")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.json_type(F.concat(F.lit('{"k":'), value, F.lit("}")), "$.k").alias("type"))


@query("SELECT o_orderkey, '[' || o_custkey || ',' || o_orderkey % 10 || ',\"' || o_orderstatus || '\"]' AS doc FROM orders")
def kv_json_arrappend(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = F.to_json(F.array(F.col("o_custkey"), F.col("o_orderkey") % 10))
    return o.select("o_orderkey", K.json_array_insert(a, "$", None, F.to_json(F.struct(F.col("o_orderstatus").alias("v")))).alias("doc"))


# further commands


@query(f"WITH {_ZSETS} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS r FROM z WHERE score BETWEEN 950 AND 1400) WHERE r >= 1 AND r < 4")
def kv_zrevrangebyscore(spark, sf_dir):
    return K.zrange_by_score(part_zsets(spark, sf_dir), 950.0, 1400.0, 1, 3, descending=True).select("key", "member", "score")


@query(f"WITH {_ZSETS} SELECT key, member, score, CAST(row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS INTEGER) AS rank FROM z WHERE member > '10' AND member <= '20'")
def kv_zrevrangebylex(spark, sf_dir):
    return K.zrange_by_lex(part_zsets(spark, sf_dir), "(10", "[20", descending=True)


@query(f"WITH {_ZSETS} SELECT key, count(*) AS n FROM z WHERE member >= '10' AND member < '20' GROUP BY 1")
def kv_zlexcount(spark, sf_dir):
    return K.zlexcount(part_zsets(spark, sf_dir), "[10", "(20")


@query(f"WITH {_ZSETS} SELECT key, member, score FROM z WHERE NOT score BETWEEN 950 AND 1400")
def kv_zremrangebyscore(spark, sf_dir):
    return K.zremove_by_score(part_zsets(spark, sf_dir), 950.0, 1400.0)


@query(f"WITH {_ZSETS} SELECT key, member, score FROM z WHERE NOT (member >= '10' AND member < '20')")
def kv_zremrangebylex(spark, sf_dir):
    return K.zremove_by_lex(part_zsets(spark, sf_dir), "[10", "(20")


@query(f"WITH {_ZSETS}, a AS (SELECT key, member FROM z UNION ALL SELECT DISTINCT key, 'nobody' FROM z) SELECT a.key, a.member, z.score FROM a LEFT JOIN z USING (key, member)")
def kv_zscore(spark, sf_dir):
    z = part_zsets(spark, sf_dir)
    return K.zscore(z.select("key", "member").union(z.select("key", F.lit("nobody")).distinct()), z)


@query("SELECT c_custkey AS key, 'c_name' AS field, CAST(octet_length(CAST(c_name AS BLOB)) AS INTEGER) AS n FROM customer")
def kv_hstrlen(spark, sf_dir):
    return K.hstrlen(customer_hashes(spark, sf_dir).where("field = 'c_name'"))


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS was, upper(hex(CAST(chr(CAST(ascii(n_name) - CASE WHEN (ascii(n_name) // 1) % 2 = 1 THEN 1 ELSE 0 END + 1 AS INTEGER)) || substr(n_name, 2) AS BLOB))) AS value FROM nation".replace("CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS was", "CAST(ascii(n_name) % 2 AS INTEGER) AS was"))
def kv_setbit(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("key"), K.get_bit(F.col("n_name"), 7).alias("was"), F.hex(K.set_bit(F.col("n_name"), 7, 1)).alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
def kv_json_mget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    docs = e.where("event_type <> 'error'").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))
    return K.json_mget(e.select(F.col("event_id").alias("key")), docs, "$.k").select(F.col("key").alias("event_id"), F.col("value").alias("k"))


@query("SELECT event_id, CAST(1 + event_id % 2 AS INTEGER) AS n FROM events")
def kv_json_objlen(spark, sf_dir):
    doc = F.when(F.col("event_id") % 2 == 1, K.json_set(F.col("props"), "$.deep", F.lit('{"x":[1,{"y":2.5}]}'))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", K.json_length(doc, "$").alias("n"))


@query("SELECT o_orderkey, '{\"a\":{\"b\":[' || o_custkey || ',\"new\",true]},\"n\":' || o_orderkey || '}' AS doc FROM orders")
def kv_json_nested(spark, sf_dir):
    """JSON.SET below the top level, JSON.ARRINSERT and JSON.DEL; numbers stay numbers."""
    doc = F.concat(F.lit('{"a":{"b":['), F.col("o_custkey"), F.lit(',true],"gone":1},"n":0}'))
    doc = K.json_set(doc, "$.n", F.col("o_orderkey").cast("string"))
    doc = K.json_array_insert(doc, "$.a.b", 1, F.to_json(F.struct(F.lit("new").alias("v"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.json_remove(doc, "$.a.gone").alias("doc"))
