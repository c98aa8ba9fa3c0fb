"""Queries of quorum, replica comparison, placement, hashes and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import hashes
from ..functions.scalars import epoch
from ..operators import consistency as C
from ..operators import metrics, placement
from ..operators.metrics import offsets
from .registry import query, table


def replies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    peers = o.select(F.col("o_orderkey").alias("request"), "o_totalprice", F.explode(F.array(*map(F.lit, range(5)))).alias("peer"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    wrong = ((F.col("request") % 97 == 0) & (F.col("peer") >= 3)) | ((F.col("request") % 194 == 0) & (F.col("peer") == 1))
    return peers.select("request", F.when(F.col("peer") < 3, "east").otherwise("west").alias("dc"), "peer", ((F.col("peer") * 7 + F.col("request")) % 11).alias("arrival"), (cents + F.when(wrong, F.col("peer")).otherwise(0)).alias("reply"))


_REPLIES = """p AS (SELECT o_orderkey AS request, unnest([0,1,2,3,4]) AS peer, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders),
  r AS (SELECT request, CASE WHEN peer < 3 THEN 'east' ELSE 'west' END AS dc, peer, (peer*7 + request) % 11 AS arrival, cents + CASE WHEN (request % 97 = 0 AND peer >= 3) OR (request % 194 = 0 AND peer = 1) THEN peer ELSE 0 END AS reply FROM p)"""
_QUORUM = f"""{_REPLIES}, v AS (SELECT request, reply, count(*) AS votes, min(arrival) AS f FROM r WHERE dc = 'west' OR request NOT IN (SELECT request FROM r WHERE dc = 'west') GROUP BY 1,2),
  q AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY votes DESC, f, reply) AS n, CAST(sum(votes) OVER (PARTITION BY request) AS BIGINT) AS peers FROM v)"""


@query(f"WITH {_QUORUM} SELECT request, reply, votes, peers, votes >= peers // 2 + 1 AS majority FROM q WHERE n = 1")
def quorum_majority(spark, sf_dir):
    return C.quorum(replies(spark, sf_dir), "request", "reply", "dc", "west", "arrival")


@query(f"WITH {_REPLIES} SELECT request, arg_min(reply, (arrival, peer)) AS reply FROM r GROUP BY 1")
def quorum_first(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("arrival", F.struct("arrival", "peer"))
    return C.first_reply(r, "request", "reply", "arrival")


@query(f"WITH {_REPLIES} SELECT request, count(DISTINCT reply) = 1 AS agreed, CASE WHEN count(DISTINCT reply) = 1 THEN min(reply) END AS reply FROM r WHERE dc = 'west' GROUP BY 1")
def quorum_all_agree(spark, sf_dir):
    return C.all_agree(replies(spark, sf_dir), "request", "reply", "dc", "west")


@query(f"WITH {_REPLIES}, d AS (SELECT request, dc, count(DISTINCT reply) = 1 AS one, min(reply) AS reply FROM r GROUP BY 1,2) SELECT request, bool_and(one) AS agreed, CASE WHEN bool_and(one) THEN max(CASE WHEN dc = 'east' THEN reply END) END AS reply FROM d GROUP BY 1")
def quorum_per_dc(spark, sf_dir):
    return C.agree_by_datacenter(replies(spark, sf_dir), "request", "dc", "reply", "east")


@query(f"WITH {_QUORUM} SELECT r.request, r.peer, r.reply FROM r JOIN q ON q.request = r.request AND q.n = 1 WHERE r.reply <> q.reply")
def divergent_replicas(spark, sf_dir):
    r = replies(spark, sf_dir)
    return C.divergent(r, C.quorum(r, "request", "reply", "dc", "west", "arrival"), "request", "reply").select("request", "peer", "reply")


def sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("version"), "o_orderdate")
    return o.where("key % 89 <> 0"), o.where("key % 83 <> 0").withColumn("version", F.col("version") + F.when(F.col("key") % 97 == 0, 1).otherwise(0))


_SIDES = """o AS (SELECT o_orderkey AS key, CAST(round(o_totalprice*100) AS BIGINT) AS version, o_orderdate FROM orders),
  a AS (SELECT * FROM o WHERE key % 89 <> 0), b AS (SELECT key, version + CASE WHEN key % 97 = 0 THEN 1 ELSE 0 END AS version, o_orderdate FROM o WHERE key % 83 <> 0)"""


def _hash(*columns: str) -> str:
    return "('0x' || substr(md5(concat_ws('|'," + ",".join(columns) + ")),1,15))::BIGINT"


_TREE = f"""{_SIDES}, t AS (SELECT DISTINCT CAST(floor(epoch(o_orderdate) / 3600) % 24 AS INTEGER) AS bucket, CAST({_hash('key')} % 1024 AS INTEGER) AS segment, {_hash('key', 'version')} AS h FROM a)"""


def _tree(rows):
    return C.xor_tree(rows, F.col("key"), F.col("version"), epoch("o_orderdate", "SECOND"))


@query(f"WITH {_TREE} SELECT bucket, bit_xor(h) AS hash FROM t GROUP BY 1")
def aae_roots(spark, sf_dir):
    return C.roots(_tree(sides(spark, sf_dir)[0]))


@query(f"WITH {_TREE} SELECT bucket, segment, bit_xor(h) AS hash FROM t GROUP BY 1,2")
def aae_segments(spark, sf_dir):
    return _tree(sides(spark, sf_dir)[0])


_DIFFERENCE = "SELECT coalesce(a.key,b.key) AS key, a.version AS ours, b.version AS theirs, CASE WHEN b.key IS NULL THEN 'missing_theirs' WHEN a.key IS NULL THEN 'missing_ours' ELSE 'different' END AS side FROM a FULL JOIN b ON a.key = b.key WHERE a.version IS DISTINCT FROM b.version"


@query(f"WITH {_SIDES} {_DIFFERENCE}")
def aae_diff(spark, sf_dir):
    return C.exchange(*sides(spark, sf_dir), "key", "version")


@query(f"WITH {_SIDES} {_DIFFERENCE}")
def symmetric_diff(spark, sf_dir):
    return C.symmetric_difference(*sides(spark, sf_dir), "key", "version")


@query(f"WITH {_SIDES}, d AS ({_DIFFERENCE}) SELECT key, CASE WHEN side = 'missing_theirs' THEN 'push' WHEN side = 'missing_ours' THEN 'pull' WHEN ours > theirs THEN 'push' ELSE 'pull' END AS action, greatest(ours, theirs) AS winner FROM d")
def repair_plan(spark, sf_dir):
    return C.repairs(C.symmetric_difference(*sides(spark, sf_dir), "key", "version"), "key")


@query(f"WITH {_SIDES} SELECT key, version FROM a UNION ALL SELECT key, version FROM b WHERE key NOT IN (SELECT key FROM a)")
def mst_reconcile(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return C.reconcile(a.select("key", "version"), b.select("key", "version"), "key")


@query(f"WITH {_SIDES} {_DIFFERENCE}")
def mst_diff(spark, sf_dir):
    return C.pruned_difference(*sides(spark, sf_dir), "key", "version")


def clocked(spark, sf_dir):
    """Two replicas of customers with version vectors of three actors: some behind, some ahead, some written on both sides."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    actor = lambda n, d: (k % n == 0).cast("int") + d
    clock = lambda x, y: F.map_from_arrays(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(x, y, F.lit(1)))
    ours = c.where("c_custkey % 89 <> 0").select(k.alias("key"), clock(actor(7, 1), F.lit(1)).alias("clock"), F.concat(F.col("c_name"), F.when(k % 7 == 0, "~").otherwise("")).alias("value"))
    theirs = c.where("c_custkey % 83 <> 0").select(k.alias("key"), clock(F.lit(1), actor(5, 1)).alias("clock"), F.concat(F.col("c_name"), F.when(k % 5 == 0, "^").otherwise("")).alias("value"))
    return ours, theirs


@query("""WITH k AS (SELECT c_custkey AS key, c_name AS n, c_custkey % 89 <> 0 AS o, c_custkey % 83 <> 0 AS t, c_custkey % 7 = 0 AS a, c_custkey % 5 = 0 AS b FROM customer)
  SELECT key, CASE WHEN NOT t THEN 'push' WHEN NOT o THEN 'pull' WHEN a AND b THEN 'ambiguous' WHEN a THEN 'push' ELSE 'pull' END AS action,
    CASE WHEN NOT t OR (o AND a AND NOT b) THEN n || CASE WHEN a THEN '~' ELSE '' END WHEN NOT o OR (b AND NOT a) THEN n || CASE WHEN b THEN '^' ELSE '' END END AS winner
  FROM k WHERE (o OR t) AND (NOT o OR NOT t OR a OR b)""")
def repair_by_clock(spark, sf_dir):
    return C.repairs_by_clock(*clocked(spark, sf_dir), "key", "clock", "value")


_MERKLE = "SELECT CAST({h} % 256 AS INTEGER) AS segment, bit_xor({v}) AS hash FROM {t} GROUP BY 1"


@query(f"WITH {_SIDES}, x AS ({_MERKLE.format(h=_hash('key'), v=_hash('key', 'version'), t='a')}), y AS ({_MERKLE.format(h=_hash('key'), v=_hash('key', 'version'), t='b')}) SELECT coalesce(x.segment, y.segment) AS segment FROM x FULL JOIN y ON x.segment = y.segment WHERE x.hash IS DISTINCT FROM y.hash")
def merkle_diff(spark, sf_dir):
    a, b = (C.merkle_segments(s, "key", "version", 256).drop("keys") for s in sides(spark, sf_dir))
    return C.diverging(a, b, ["segment"])


@query("""WITH s AS (SELECT event_id AS seq, octet_length(CAST(props AS BLOB)) AS size FROM events), a AS (SELECT * FROM (VALUES ('r1', 9900), ('r2', 5000), ('r3', -1)) t(replica, acked))
  SELECT replica, CAST(sum(CASE WHEN seq > acked THEN size ELSE 0 END) AS BIGINT) AS delta_bytes, CAST(sum(size) AS BIGINT) AS full_bytes, CASE WHEN acked >= 0 THEN 'delta' ELSE 'full' END AS plan FROM a, s GROUP BY replica, acked""")
def delta_ship(spark, sf_dir):
    states = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.octet_length("props").cast("bigint").alias("size"))
    return C.ship(states, spark.createDataFrame([("r1", 9900), ("r2", 5000), ("r3", -1)], "replica string, acked long"), "replica", "seq", "size")


RING = [(f"peer{i % 5}", (i * 104729 * 7919) % 1_000_000_007) for i in range(40)]
_RING = "ring AS (SELECT * FROM (VALUES " + ",".join(f"('{p}',{t})" for p, t in RING) + ") t(peer, token)), k AS (SELECT c_custkey, (c_custkey * 15485863) % 1000000007 AS h FROM customer)"


def ring_and_keys(spark, sf_dir):
    return spark.createDataFrame(RING, "peer string, token long"), table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 15485863) % 1_000_000_007).alias("h"))


@query(f"WITH {_RING} SELECT c_custkey, h, coalesce((SELECT arg_min(peer, token) FROM ring WHERE token >= h), (SELECT arg_min(peer, token) FROM ring)) AS peer FROM k")
def ring_lookup(spark, sf_dir):
    ring, keys = ring_and_keys(spark, sf_dir)
    return placement.owner(keys, "h", ring)


@query(f"""WITH {_RING}, o AS (SELECT c_custkey, peer, min((token < h, token)) AS place FROM k, ring GROUP BY 1,2),
  n AS (SELECT c_custkey, peer, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY place) - 1 AS INTEGER) AS replica FROM o) SELECT * FROM n WHERE replica < 3""")
def replica_plan(spark, sf_dir):
    ring, keys = ring_and_keys(spark, sf_dir)
    return placement.replicas(keys, "c_custkey", "h", ring, 3)


@query(f"""WITH {_RING}, o AS (SELECT c_custkey, peer, min((token < h, token)) AS place FROM k, ring GROUP BY 1,2),
  n AS (SELECT c_custkey, peer, row_number() OVER (PARTITION BY c_custkey ORDER BY place) - 1 AS replica FROM o),
  l AS (SELECT c_custkey, peer, replica, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY replica < 2 DESC, replica) - 1 AS INTEGER) AS place FROM n WHERE peer <> 'peer1')
  SELECT c_custkey, place, peer, CASE WHEN replica < 2 THEN 'primary' ELSE 'fallback' END AS role FROM l WHERE place < 2""")
def preference_list(spark, sf_dir):
    ring, keys = ring_and_keys(spark, sf_dir)
    return placement.preference(keys, "c_custkey", "h", ring, ["peer0", "peer2", "peer3", "peer4"], 2)


SLICES = placement.random_slices(["n0", "n1", "n2", "n3", "n4", "n5", "n6"], 1_000_000_007)


@query(f"WITH {_RING}, s AS (SELECT * FROM (VALUES " + ",".join(f"({a},{b},'{p}')" for a, b, p in SLICES) + ") t(low, high, peer)) SELECT c_custkey, h, peer FROM k JOIN s ON h >= low AND h < high")
def random_slicing(spark, sf_dir):
    return placement.slice_owner(ring_and_keys(spark, sf_dir)[1], "h", spark.createDataFrame(SLICES, "low long, high long, peer string"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS rack, s_suppkey % 13 AS token, count(DISTINCT s_name) AS peers FROM supplier GROUP BY 1, 2 HAVING count(DISTINCT s_name) > 1")
def ring_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return placement.coverage(s.select(F.col("s_nationkey").cast("string").alias("rack"), F.col("s_name").alias("peer"), (F.col("s_suppkey") % 13).alias("token")))


_WIDE = "ring AS (SELECT 'peer' || i % 97 AS peer, (i * 104729 * 7919) % 1000000007 AS token FROM range(10000) t(i)), k AS (SELECT o_orderkey, (o_orderkey * 15485863) % 1000000007 AS h FROM orders)"


@query(f"WITH {_WIDE}, f AS (SELECT arg_min(peer, token) AS first FROM ring) SELECT o_orderkey, h, coalesce(peer, first) AS peer FROM (SELECT * FROM k ASOF LEFT JOIN ring ON k.h <= ring.token), f")
def ring_of_many_points(spark, sf_dir):
    ring = spark.range(10_000).select(F.concat(F.lit("peer"), F.col("id") % 97).alias("peer"), ((F.col("id") * 104729 * 7919) % 1_000_000_007).alias("token"))
    keys = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 15485863) % 1_000_000_007).alias("h"))
    return placement.owner(keys, "h", ring)


@query("SELECT c_custkey, 'peer' || (c_custkey * 15485863) % 1000000007 % 5 AS peer FROM customer")
def modula_lookup(spark, sf_dir):
    _, keys = ring_and_keys(spark, sf_dir)
    return placement.modula(keys, "h", [f"peer{i}" for i in range(5)]).select("c_custkey", "peer")


_SERVERS = [("alpha:1", 2), ("beta:1", 1), ("gamma:1", 1)]
_WORD = "CAST('0x' || substr(m,{0}+7,2) || substr(m,{0}+5,2) || substr(m,{0}+3,2) || substr(m,{0}+1,2) AS BIGINT)"


@query(f"""WITH s AS (SELECT * FROM (VALUES ('alpha:1',60),('beta:1',30),('gamma:1',30)) t(peer, n)), d AS (SELECT peer, md5(peer || '-' || i) AS m FROM s, range(60) r(i) WHERE i < n),
  ring AS (SELECT peer, unnest([{", ".join(_WORD.format(8 * i) for i in range(4))}]) AS token FROM d), k AS (SELECT c_custkey, crc32 AS h FROM (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS crc32 FROM customer)),
  f AS (SELECT arg_min(peer, token) AS first FROM ring) SELECT c_custkey, coalesce(peer, first) AS peer FROM (SELECT * FROM k ASOF LEFT JOIN ring ON k.h <= ring.token), f""")
def ketama_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 2654435761) % 4294967296).alias("h"))
    return placement.owner(keys, "h", placement.ketama_points(spark, _SERVERS)).select("c_custkey", "peer")


@query("SELECT c_custkey, CAST(('0x' || substr(md5(c_name),7,2) || substr(md5(c_name),5,2) || substr(md5(c_name),3,2) || substr(md5(c_name),1,2)) AS BIGINT) AS md5 FROM customer")
def hash_md5(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashes.hashed("md5", F.col("c_name")).alias("md5"))


@query()
def hash_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *(hashes.hashed(n, F.col("c_name")).alias(n) for n in hashes.FUNCTIONS))


_OFFSETS = "[" + ",".join(map(str, offsets())) + "]"
_HISTOGRAM = f"h AS (SELECT event_type, CAST(greatest(len(list_filter({_OFFSETS}, lambda o: o <= value)) - 1, 0) AS INTEGER) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1,2), g AS (SELECT *, list_extract({_OFFSETS}, bucket + 1)::BIGINT AS off FROM h)"


@query(f'WITH {_HISTOGRAM} SELECT event_type, bucket, n, off AS "offset" FROM g')
def hist_buckets(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"])


@query(f"""WITH {_HISTOGRAM}, r AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS so_far FROM g)
  SELECT event_type, CAST(min(CASE WHEN so_far >= floor(total*0.5) THEN off END) AS BIGINT) AS p50, CAST(min(CASE WHEN so_far >= floor(total*0.95) THEN off END) AS BIGINT) AS p95, CAST(min(CASE WHEN so_far >= floor(total*0.999) THEN off END) AS BIGINT) AS p99_9 FROM r GROUP BY 1""")
def hist_percentile(spark, sf_dir):
    return metrics.percentiles(metrics.histogram(table(spark, sf_dir, "events"), "value", ["event_type"]), [0.5, 0.95, 0.999], ["event_type"])


@query(f"WITH {_HISTOGRAM} SELECT event_type, round(sum(n*off)/sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS count FROM g GROUP BY 1")
def hist_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = metrics.histogram(e.where("event_id % 2 = 0"), "value", ["event_type"]).unionByName(metrics.histogram(e.where("event_id % 2 = 1"), "value", ["event_type"]))
    return metrics.mean(metrics.merge(parts, ["event_type"]), ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("""SELECT date_trunc('day', ts) AS start, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.999), 6) AS p99_9, max(value) AS max FROM events GROUP BY 1""")
def window_latency(spark, sf_dir):
    found = metrics.windowed(table(spark, sf_dir, "events"), "ts", "value", "1 day", [0.5, 0.95, 0.999], F.col("event_type") == "error")
    return found.select("start", "n", "errors", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99_9")), "max")


@query(f"""WITH g AS (SELECT user_id, event_id, ts, CAST(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gap FROM events),
  m AS (SELECT *, greatest(avg(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 1000.0) AS mean_gap FROM g)
  SELECT user_id, event_id, round(CASE WHEN gap IS NULL OR mean_gap IS NULL THEN 0 ELSE gap / (mean_gap * {math.log(10)}) END, 6) AS phi FROM m""")
def phi_accrual(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", epoch("ts", "MILLISECOND"))
    return metrics.suspicion(e, "user_id", "ms", ["ts", "event_id"], 10, 1000.0).select("user_id", "event_id", F.round("phi", 6).alias("phi"))


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def stats_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT event_type, CAST(trunc(max(value)) AS BIGINT) AS max FROM events WHERE value IS NOT NULL GROUP BY 1")
def hist_max(spark, sf_dir):
    return metrics.maximum(table(spark, sf_dir, "events"), "value", ["event_type"])
