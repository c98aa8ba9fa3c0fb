"""Queries of MapReduce, secondary indexes, mergeable types, versions and transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import epoch, pack_clock
from ..operators import consistency, crdt, index2i
from ..operators import mapreduce as M
from ..sources import objects
from .registry import query, table


def event_objects(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.lit("events").alias("bucket"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"))


@query("SELECT props AS value, count(*) AS n FROM events GROUP BY 1")
def mr_object_value(spark, sf_dir):
    return M.object_value(event_objects(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1")
def mr_extract_field(spark, sf_dir):
    return M.extract_field("k")(event_objects(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(v AS VARCHAR) AS value, count(*) AS n FROM (SELECT unnest([o_orderkey % 7, o_custkey % 5]) AS v FROM orders) GROUP BY 1")
def mr_value_list(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_json(F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 5)).alias("value"))
    return M.object_value_list(d).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) AS VARCHAR) AS value, 1 AS phase FROM events")
def mr_count(spark, sf_dir):
    return M.job(event_objects(spark, sf_dir), [M.Step(M.identity), M.Step(M.reduce_count)])


@query("SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR) AS value FROM events")
def mr_sum(spark, sf_dir):
    return M.reduce_sum(M.extract_field("k")(event_objects(spark, sf_dir)))


@query("SELECT value, CAST(row_number() OVER (ORDER BY CAST(value AS DOUBLE)) AS INTEGER) AS pos FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS value FROM events)")
def mr_sort(spark, sf_dir):
    d = M.extract_field("k")(event_objects(spark, sf_dir)).distinct()
    return M.numbered(M.reduce_sort(d).withColumn("_n", F.col("value").cast("double")), ["_n"]).select("value", "pos")


@query("SELECT json_extract_string(props, '$.k') AS value, min(event_id) AS first_event_id FROM events GROUP BY 1")
def mr_set_union(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("value"), "event_id")
    return M.reduce_set_union(["event_id"])(d)


def customer_objects(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.lit("customer").alias("bucket"), F.col("c_custkey").cast("string").alias("key"), "c_name", "c_mktsegment")


@query("SELECT c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def mr_link(spark, sf_dir):
    link = F.struct(F.lit("customer").alias("bucket"), F.col("o_custkey").cast("string").alias("key"), F.lit("placed_by").alias("tag"))
    d = table(spark, sf_dir, "orders").select(F.array(link).alias("links"))
    return M.link_walk(d, customer_objects(spark, sf_dir)).select("c_name", "c_mktsegment")


@query("SELECT s_name AS name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def mr_link_tag(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edge = lambda tag, c: lines.select(F.lit(tag[0]).alias("bucket"), F.col(c).cast("string").alias("key"), F.lit(tag[1]).alias("tag"))
    edges = edge(("part", "contains"), "l_partkey").unionByName(edge(("supplier", "shipped_by"), "l_suppkey"))
    named = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("bucket"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
    return M.walk_edges(edges, named, "shipped_by").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT 0 AS phase, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT 1, CAST(count(*) AS VARCHAR) FROM events")
def mr_pipeline_keep(spark, sf_dir):
    return M.job(event_objects(spark, sf_dir), [M.Step(M.extract_field("k"), keep=True), M.Step(M.reduce_count)])


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def mr_user_function(spark, sf_dir):
    functions = M.Functions()
    functions.register_map("large", lambda f: f[f["value"] > 50][["event_type"]], "event_type string")
    return functions["large"](table(spark, sf_dir, "events").select("event_type", "value")).groupBy("event_type").agg(F.count("*").alias("n"))


def customer_index(spark, sf_dir):
    return index2i.entries(table(spark, sf_dir, "customer"), "customer", "c_custkey", {"c_nationkey_int": "c_nationkey", "c_mktsegment_bin": "c_mktsegment"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def idx2i_eq_bin(spark, sf_dir):
    return index2i.equal(customer_index(spark, sf_dir), "c_mktsegment_bin", "BUILDING")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
def idx2i_range_bin(spark, sf_dir):
    return index2i.between(customer_index(spark, sf_dir), "c_mktsegment_bin", "B", "G")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_nationkey BETWEEN 5 AND 9")
def idx2i_range_int(spark, sf_dir):
    return index2i.between(customer_index(spark, sf_dir), "c_nationkey_int", 5, 9).withColumn("value", F.col("value").cast("bigint"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_nationkey BETWEEN 5 AND 9 ORDER BY c_nationkey, key LIMIT 25")
def idx2i_max_results(spark, sf_dir):
    return index2i.between(customer_index(spark, sf_dir), "c_nationkey_int", 5, 9, 25).withColumn("value", F.col("value").cast("bigint"))


def op_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("key"), (F.col("user_id") % 3).cast("string").alias("actor"), (F.col("event_id") % 50).alias("element"), F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("add").alias("kind"), "ts", "event_id", "event_type", F.when(F.col("event_type") == "purchase", -1).otherwise(1).cast("bigint").alias("delta"), "props")


_OPS = """ops AS (SELECT user_id % 20 AS key, CAST(user_id % 3 AS VARCHAR) AS actor, event_id % 50 AS element, CASE WHEN event_type IN ('error','signup') THEN 'remove' ELSE 'add' END AS kind, ts, event_id, event_type, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS delta, props FROM events)"""


@query(f"WITH {_OPS} SELECT key, CAST(sum(delta) AS BIGINT) AS value FROM ops GROUP BY 1")
def crdt_counter(spark, sf_dir):
    ops = op_log(spark, sf_dir)
    states = crdt.counter_states(ops, "key", "actor", "delta")
    early = crdt.counter_states(ops.where("event_id % 2 = 0"), "key", "actor", "delta")  # an older state changes nothing
    return crdt.counter_value(states.unionByName(early))


@query(f"WITH {_OPS} SELECT DISTINCT o.key, o.element FROM ops o WHERE kind = 'add' AND NOT EXISTS (SELECT 1 FROM ops r WHERE r.kind = 'remove' AND r.key = o.key AND r.element = o.element AND (r.ts, r.event_id) > (o.ts, o.event_id))")
def crdt_orset(spark, sf_dir):
    return crdt.set_value(crdt.set_states(op_log(spark, sf_dir), ["ts", "event_id"]))


@query(f"WITH {_OPS} SELECT key, arg_max(props, (ts, actor, props)) AS value, max(ts) AS ts FROM ops GROUP BY 1")
def crdt_lww(spark, sf_dir):
    return crdt.register_value(op_log(spark, sf_dir), "key", "props", "ts", ["actor"])


@query(f"WITH {_OPS}, t AS (SELECT key, element, bool_or(kind = 'remove') AS gone FROM ops GROUP BY 1, 2) SELECT key, bool_or(NOT gone) AS value FROM t GROUP BY 1")
def crdt_flag(spark, sf_dir):
    states = op_log(spark, sf_dir).select("key", F.col("element").alias("tag"), F.when(F.col("kind") == "remove", "disable").otherwise("enable").alias("kind"))
    return crdt.flag_value(states)


@query(f"""WITH {_OPS}, c AS (SELECT key, event_type AS field, 'counter' AS type, CAST(CAST(sum(delta) AS BIGINT) AS VARCHAR) AS value FROM ops WHERE element % 2 = 0 GROUP BY 1, 2),
  r AS (SELECT key, event_type AS field, 'register' AS type, arg_max(props, (ts, actor, props)) AS value FROM ops WHERE element % 2 = 1 GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT * FROM r""")
def crdt_map(spark, sf_dir):
    ops = op_log(spark, sf_dir).withColumn("field", F.col("event_type"))
    fields = ops.select("key", "field", F.when(F.col("element") % 2 == 0, "counter").otherwise("register").alias("type")).distinct()
    at = F.struct("key", "field")
    flat = lambda d: d.select("key.key", "key.field", "value")
    counters = flat(crdt.counter_value(crdt.counter_states(ops.where("element % 2 = 0").withColumn("key", at), "key", "actor", "delta")))
    registers = flat(crdt.register_value(ops.where("element % 2 = 1").withColumn("key", at), "key", "props", "ts", ["actor"]))
    return crdt.map_value(fields, {"counter": counters, "register": registers})


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1")
def crdt_hll(spark, sf_dir):
    found = crdt.cardinality(table(spark, sf_dir, "events"), ["event_type"], "user_id")
    return found.select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("near"))


@query(f"WITH {_OPS} SELECT key, actor, element FROM ops WHERE event_id > 5000")
def crdt_delta(spark, sf_dir):
    return crdt.delta_since(op_log(spark, sf_dir), "event_id", 5000).select("key", "actor", "element")


@query("""WITH s AS (SELECT user_id, event_id, ts, CAST(epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) // 1000 AS BIGINT) AS l FROM events)
  SELECT user_id, event_id, l, CAST(row_number() OVER (PARTITION BY user_id, l ORDER BY event_id) - 1 AS INTEGER) AS c, l * 65536 + row_number() OVER (PARTITION BY user_id, l ORDER BY event_id) - 1 AS stamp FROM s""")
def hlc_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", epoch("ts", "MILLISECOND").alias("ms"))
    return crdt.clock(e, "user_id", "ms", ["event_id"]).select("user_id", "event_id", "l", "c", pack_clock(F.col("l"), F.col("c")).alias("stamp"))


@query("SELECT user_id, max((ts, event_id))[1] AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def asof_snapshot(spark, sf_dir):
    v = table(spark, sf_dir, "events").withColumn("stamp", F.struct("ts", "event_id"))
    found = v.where(F.col("ts") <= F.to_timestamp(F.lit("2024-01-15 00:00:00"))).groupBy("user_id").agg(F.max("stamp.ts").alias("ts"), F.max_by("event_type", "stamp").alias("event_type"))
    return found


@query("""WITH v AS (SELECT o_custkey % 200 AS key, o_orderkey AS ts, o_orderstatus AS value, [o_custkey % 200, (o_custkey + 1) % 200] AS sib FROM orders),
  r AS (SELECT key, max(ts) AS ts, arg_max(sib, ts) AS sib FROM v WHERE key % 2 = 0 OR ts % 3 = 0 GROUP BY 1),
  n AS (SELECT s AS key, max(ts) AS needed FROM (SELECT unnest(sib) AS s, ts FROM r) GROUP BY 1)
  SELECT r.key, r.ts AS read_ts, n.needed, v.value FROM r JOIN n USING (key) LEFT JOIN v ON v.key = r.key AND v.ts = n.needed WHERE n.needed > r.ts""")
def ramp_fractured(spark, sf_dir):
    k = F.col("o_custkey") % 200
    v = table(spark, sf_dir, "orders").select(k.alias("key"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("value"), F.array(k, (F.col("o_custkey") + 1) % 200).alias("siblings"))
    reads = v.where("key % 2 = 0 or ts % 3 = 0").groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("siblings", "ts").alias("siblings"))
    return consistency.fractured(reads, v)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def put_latest(spark, sf_dir):
    v = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
    return objects.put_latest(v, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def tombstone_reap(spark, sf_dir):
    old, _ = objects.reap(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", F.to_timestamp(F.lit("2024-01-30 00:00:00")), "7 days")
    return old.select("event_id")


@query("""WITH b AS (SELECT user_id % 40 AS txn, user_id AS key, CASE WHEN event_type = 'signup' THEN 'delete' ELSE 'put' END AS kind, event_id AS value, ts FROM events),
  g AS (SELECT * FROM b WHERE txn NOT IN (SELECT txn FROM b WHERE value % 1000 = 0)),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, value DESC) AS n FROM g) WHERE n = 1)
  SELECT c_custkey AS key, CAST(0 AS BIGINT) AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM l) UNION ALL SELECT key, value FROM l WHERE kind = 'put'""")
def txn_atomic_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    batches = e.select((F.col("user_id") % 40).alias("txn"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "signup", "delete").otherwise("put").alias("kind"), F.col("event_id").alias("value"), (F.col("event_id") % 1000 == 0).alias("abort"), "ts")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("value"))
    return objects.apply_batches(base, batches, ["ts", "value"])


@query("SELECT page_id FROM pages WHERE contains(url, 'a')")
def bucket_text_search(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").contains("a")).select("page_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def object_fields(spark, sf_dir):
    return objects.fields(table(spark, sf_dir, "events"), "props", "k bigint").select("event_id", "k")


@query(f"WITH {_OPS} SELECT DISTINCT o.key, o.element FROM ops o WHERE kind = 'add' AND NOT EXISTS (SELECT 1 FROM ops r WHERE r.kind = 'remove' AND r.key = o.key AND r.element = o.element AND (r.ts, r.event_id) > (o.ts, o.event_id))")
def crdt_delta_join(spark, sf_dir):
    states = crdt.set_states(op_log(spark, sf_dir), ["ts", "event_id"])
    known, delta = states.where("kind = 'add'"), states.where("kind = 'remove' or pmod(hash(tag), 2) = 0")
    return crdt.set_value(crdt.delta_join(crdt.delta_join(known, delta), delta))


@query("""WITH s AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) // 1000 AS BIGINT) AS l FROM events),
  h AS (SELECT *, row_number() OVER (PARTITION BY user_id, l ORDER BY event_id) - 1 AS c FROM s), r AS (SELECT user_id - 1 AS user_id, max((l, c))[1] AS rl, max((l, c))[2] AS rc FROM h GROUP BY 1),
  n AS (SELECT h.*, rl, rc, greatest(l, rl, ms) AS nl FROM h JOIN r USING (user_id))
  SELECT user_id, event_id, nl AS l, CAST(CASE WHEN nl = l AND nl = rl THEN greatest(c, rc) + 1 WHEN nl = l THEN c + 1 WHEN nl = rl THEN rc + 1 ELSE 0 END AS INTEGER) AS c FROM n""")
def hlc_update(spark, sf_dir):
    """Each event's stamp after a message that bears the last stamp of the next user."""
    stamps = crdt.clock(table(spark, sf_dir, "events").select("user_id", "event_id", epoch("ts", "MILLISECOND").alias("ms")), "user_id", "ms", ["event_id"])
    last = stamps.groupBy((F.col("user_id") - 1).alias("user_id")).agg(F.max(F.struct("l", "c")).alias("r"))
    l, c = crdt.clock_update(F.col("l"), F.col("c"), F.col("r.l"), F.col("r.c"), F.col("ms"))  # noqa: E741
    return stamps.join(last, "user_id").select("user_id", "event_id", l.alias("l"), c.alias("c"))


@query("""WITH w AS (SELECT l_orderkey AS ts, l_partkey AS key, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2), k AS (SELECT ts, list_sort(list(key)) AS keys FROM w GROUP BY 1)
  SELECT key, ts, array_to_string(list_filter(keys, lambda x: x <> key), ',') AS siblings, value FROM w JOIN k USING (ts)""")
def ramp_write(spark, sf_dir):
    versions = consistency.written_together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")
    return versions.withColumn("siblings", F.array_join("siblings", ","))
