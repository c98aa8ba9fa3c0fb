"""Queries of the search operators: filters, sorting, aggregation, neighbours, text, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import search as S
from ..operators import suggest, text_search
from .registry import query, table

# A query vector for the nearest-neighbour queries, 64 numbers from a rule.
PROBE = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_PROBE_SQL = "[" + ",".join(map(str, PROBE)) + "]::DOUBLE[]"


def docs_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("labels", F.concat_ws("|", "lang", "source"))
    fields = {"text": S.Field("TEXT"), "lang": S.Field("TAG"), "labels": S.Field("TAG", "|"), "n_chars": S.Field("NUMERIC")}
    return S.SearchIndex("docs", rows, "doc_id", fields)


def vec_index(spark, sf_dir, metric):
    rows = table(spark, sf_dir, "embeddings")
    return S.SearchIndex("vecs", rows, "vec_id", {"label": S.Field("NUMERIC")}, vector="embedding", dim=64, metric=metric)


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 2000 AND lang IN ('en','fr') AND contains(text,'the') ORDER BY n_chars DESC, doc_id LIMIT 10""")
def ft_search_flagship(spark, sf_dir):
    where = S.num("n_chars", 500, 2000) & S.tag("lang", ("en", "fr")) & S.text("text", "the")
    return S.search(docs_index(spark, sf_dir), where, sort="n_chars", descending=True, limit=10, returns=["lang", "n_chars"])


@query("SELECT doc_id FROM documents WHERE contains(text,'ation')")
def ft_substring(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.text("text", "ation"), no_content=True)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 1000 AND 3000")
def ft_filter_numeric(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.num("n_chars", 1000, 3000), returns=["n_chars"])


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 416 AND n_chars < 3000")
def ft_filter_numeric_exclusive(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.num("n_chars", 416, 3000, True, True), returns=["n_chars"])


@query("SELECT doc_id, labels FROM (SELECT doc_id, concat_ws('|', lang, source) AS labels FROM documents) WHERE list_has_any(string_split(labels,'|'), ['fr','src7'])")
def ft_filter_tag(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.tag("labels", ("fr", "src7")), returns=["labels"])


@query("SELECT doc_id FROM documents WHERE n_chars >= 1000 AND lang = 'de'")
def ft_filter_and(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.num("n_chars", 1000) & S.tag("lang", ("de",)), no_content=True)


@query("SELECT doc_id FROM documents WHERE n_chars < 300 OR lang = 'es'")
def ft_filter_or(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.num("n_chars", high=300, open_high=True) | S.tag("lang", ("es",)), no_content=True)


@query("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en', false)")
def ft_filter_not(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), ~S.tag("lang", ("en",)), no_content=True)


@query("SELECT doc_id FROM documents WHERE (lang = 'de' OR lang = 'fr') AND NOT (n_chars > 1000 OR contains(text,'und'))")
def ft_filter_group(spark, sf_dir):
    where = (S.tag("lang", ("de",)) | S.tag("lang", ("fr",))) & ~(S.num("n_chars", 1000, open_low=True) | S.text("text", "und"))
    return S.search(docs_index(spark, sf_dir), where, no_content=True)


@query("SELECT doc_id, source, lang FROM documents WHERE n_chars > 5000")
def ft_return(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.num("n_chars", 5000, open_low=True), returns=["source", "lang", "no_such_field"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def ft_limit(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), offset=40, limit=20, returns=["lang"])


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars, doc_id LIMIT 50")
def ft_sortby(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), S.tag("lang", ("fr",)), sort="n_chars", limit=50, returns=["n_chars"])


@query("SELECT doc_id FROM documents")
def ft_nocontent(spark, sf_dir):
    return S.search(docs_index(spark, sf_dir), no_content=True)


def events_index(spark, sf_dir):
    return S.SearchIndex("events", table(spark, sf_dir, "events"), "event_id", {"event_type": S.Field("TAG"), "value": S.Field("NUMERIC")})


@query("SELECT coalesce(event_type,'') AS event_type, count(*) AS n FROM events GROUP BY 1")
def ft_aggregate_count(spark, sf_dir):
    return S.aggregate(events_index(spark, sf_dir), ["event_type"], [S.Reduce("COUNT", "n")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(coalesce(sum(o_totalprice),0),2) AS total FROM orders GROUP BY 1,2")
def ft_aggregate_sum(spark, sf_dir):
    index = S.SearchIndex("orders", table(spark, sf_dir, "orders"), "o_orderkey")
    return S.aggregate(index, ["o_orderstatus", "o_orderpriority"], [S.Reduce("COUNT", "n"), S.Reduce("SUM", "total", "o_totalprice")]).withColumn("total", F.round("total", 2))


@query("SELECT event_type, round(coalesce(sum(value),0)/count(*),6) AS mean FROM events GROUP BY 1")
def ft_aggregate_avg(spark, sf_dir):
    return S.aggregate(events_index(spark, sf_dir), ["event_type"], [S.Reduce("AVG", "mean", "value")]).withColumn("mean", F.round("mean", 6))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_quantity)/count(*),6) AS mean_quantity FROM lineitem GROUP BY 1,2")
def ft_aggregate_multi(spark, sf_dir):
    index = S.SearchIndex("lines", table(spark, sf_dir, "lineitem"), "l_orderkey")
    reduces = [S.Reduce("COUNT", "n"), S.Reduce("SUM", "quantity", "l_quantity"), S.Reduce("AVG", "mean_quantity", "l_quantity")]
    return S.aggregate(index, ["l_returnflag", "l_linestatus"], reduces).withColumn("mean_quantity", F.round("mean_quantity", 6))


@query("SELECT event_type, printf('%.6f', coalesce(sum(round(value)),0)) AS total FROM events GROUP BY 1")
def ft_aggregate_rendered(spark, sf_dir):
    index = S.SearchIndex("events", table(spark, sf_dir, "events").withColumn("value", F.round("value")), "event_id")
    return S.aggregate(index, ["event_type"], [S.Reduce("SUM", "total", "value")]).withColumn("total", scalars.six_places(F.col("total")))


@query("SELECT key, label FROM (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY user_id)")
def ft_ingest_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), "ts", "event_id")
    return S.latest(rows, "key", ["ts", "event_id"]).select("key", "label")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN starts_with(CAST(c_custkey AS VARCHAR),'1') THEN 'a' WHEN starts_with(CAST(c_custkey AS VARCHAR),'2') THEN 'b' END AS target FROM customer")
def ft_prefix_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    catalog = S.Catalog()
    for name, prefixes in (("b", ("1", "2")), ("a", ("1",))):
        catalog.create(S.SearchIndex(name, rows, "key", prefixes=prefixes))
    return rows.withColumn("target", catalog.route(F.col("key")))


@query("SELECT doc_id FROM documents WHERE contains(text,'the') AND doc_id >= 500")
def ft_alter_add_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("seq", F.col("doc_id"))
    index = S.SearchIndex("docs", rows, "doc_id", written="seq").add_field("text", "TEXT", since=500)
    return S.search(index, S.text("text", "the"), no_content=True)


def _knn_sql(distance: str, where: str = "true") -> str:
    return f"""SELECT vec_id, round(d, 4) AS score FROM (SELECT vec_id, {distance} AS d FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_PROBE_SQL} AS q FROM embeddings) WHERE {where} ORDER BY d, vec_id LIMIT 10)"""


_COSINE = "1 - list_inner_product(v,q)/sqrt(list_inner_product(v,v)*list_inner_product(q,q))"


def _knn(spark, sf_dir, metric, where=S.everything()):
    found = S.nearest(vec_index(spark, sf_dir, metric), PROBE, 10, where, returns=[])
    return found.select("vec_id", F.round("__vec_score", 4).alias("score"))


@query(_knn_sql(_COSINE))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "COSINE")


@query(_knn_sql("sqrt(list_inner_product(v,v) - 2*list_inner_product(v,q) + list_inner_product(q,q))"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, "L2")


@query(_knn_sql("-list_inner_product(v,q)"))
def knn_ip(spark, sf_dir):
    return _knn(spark, sf_dir, "IP")


@query(_knn_sql(_COSINE, "label BETWEEN 3 AND 6"))
def knn_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, "COSINE", S.num("label", 3, 6))


@query(_knn_sql(_COSINE, "label = 2"))
def knn_bucket_filter(spark, sf_dir):
    index = vec_index(spark, sf_dir, "COSINE")
    index = S.SearchIndex("vecs", index.rows.where("label = 2"), "vec_id", vector="embedding", dim=64, metric="COSINE")
    return S.nearest(index, PROBE, 10, returns=[]).select("vec_id", F.round("__vec_score", 4).alias("score"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, 1 - list_inner_product(v,q)/sqrt(list_inner_product(v,v)*list_inner_product(q,q)) AS d FROM v, q)
  SELECT query_id, vec_id, rank, round(d,4) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    index = vec_index(spark, sf_dir, "COSINE")
    queries = index.rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.nearest_batch(index, queries, "query_id", "q", 5).select("query_id", "vec_id", "rank", F.round("__vec_score", 4).alias("score"))


@query("""WITH v AS (SELECT vec_id, label, 1 - list_inner_product(v,q)/sqrt(list_inner_product(v,v)*list_inner_product(q,q)) AS d FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, """ + _PROBE_SQL + """ AS q FROM embeddings))
  SELECT vec_id, round(d,4) AS score FROM (SELECT vec_id, min(d) AS d FROM v WHERE label < 7 GROUP BY vec_id ORDER BY d, vec_id LIMIT 12)""")
def knn_merge_hits(spark, sf_dir):
    index = vec_index(spark, sf_dir, "COSINE")
    parts = [S.nearest(index, PROBE, 12, w, returns=[]) for w in (S.num("label", 0, 4), S.num("label", 3, 6))]
    return S.merge_hits(parts, "vec_id", "__vec_score", 12).select("vec_id", F.round("__vec_score", 4).alias("score"))


@query("SELECT vec_id, round(sqrt(list_inner_product(v,v)),6) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("""SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x - (lo + floor((x-lo)/st+0.5)*st)))) / st, 3) AS worst_step FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(list_min(embedding) AS DOUBLE) AS lo, (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE))/255.0 AS st FROM embeddings)""")
def vec_int8_roundtrip(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("e", vectors.int8_encode(F.col("embedding")))
    gap = F.array_max(F.zip_with("embedding", vectors.int8_decode(F.col("e")), lambda x, y: F.abs(x.cast("double") - y)))
    return v.select("vec_id", F.round(gap / F.col("e.step"), 3).alias("worst_step"))


@query("SELECT vec_id, true AS close FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) <= 1")
def vec_fp16_roundtrip(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.fp16_round_trip(F.col("embedding")).alias("half"))
    gap = F.array_max(F.zip_with("embedding", "half", lambda x, y: F.abs(x - y)))
    return v.select("vec_id", (gap <= 0.0005).alias("close"))


@query(_knn_sql("-list_inner_product(list_transform(v, lambda x: lo(v) + floor((x-lo(v))/st(v)+0.5)*st(v)), q)").replace("lo(v)", "list_min(v)").replace("st(v)", "((list_max(v)-list_min(v))/15.0)"))
def knn_four_bit(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("e", vectors.few_bit_encode(F.col("embedding"), 4))
    decoded = vectors.int8_decode(F.col("e"))
    return v.select("vec_id", vectors.distance("IP", decoded, vectors.constant(PROBE)).alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 4).alias("score"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'licen[sc]ed? under')")
def regex_exact(spark, sf_dir):
    return text_search.search_regex(table(spark, sf_dir, "documents"), "text", "licen[sc]ed? under").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '^The and [a-z]+')")
def regex_anchored(spark, sf_dir):
    return text_search.search_regex(table(spark, sf_dir, "documents"), "text", "^The and [a-z]+").select("doc_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<title>[^<]*</title>')")
def regex_prefiltered(spark, sf_dir):
    return text_search.search_regex(table(spark, sf_dir, "pages"), "html", "<title>[^<]*</title>").select("page_id")


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, 'tion')")
def text_substring(spark, sf_dir):
    return text_search.substring(table(spark, sf_dir, "conversations"), "text", "tion").select("conv_id", "turn")


@query()  # SQL has no edit distance of a text's parts; tests hold it against one
def regex_approx_k1(spark, sf_dir):
    return text_search.approximate(table(spark, sf_dir, "documents"), "text", "Released under the MIT License", 1).select("doc_id", "cost")


_TRIGRAMS = "SELECT DISTINCT p_partkey, substr(p_name, CAST(i AS BIGINT), 3) AS trigram FROM part, LATERAL (SELECT unnest(generate_series(1, length(p_name) - 2)) AS i)"


@query(f"SELECT trigram, count(*) AS documents FROM ({_TRIGRAMS}) GROUP BY 1")
def trigram_df(spark, sf_dir):
    return text_search.document_frequency(text_search.postings(table(spark, sf_dir, "part"), "p_partkey", "p_name"))


@query("SELECT p_partkey FROM part WHERE contains(p_name,'wid') AND contains(p_name,'idg') AND contains(p_name,'dge') AND contains(p_name,'get')")
def trigram_candidates(spark, sf_dir):
    return text_search.candidates(text_search.postings(table(spark, sf_dir, "part"), "p_partkey", "p_name"), "p_partkey", "widget")


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lit("parts").alias("dict"), F.col("p_name").alias("suggestion")).agg(F.max("p_retailprice").alias("score"), F.lit(None).cast("string").alias("payload"))


@query("SELECT suggestion, score FROM (SELECT p_name AS suggestion, max(p_retailprice) AS score FROM part GROUP BY 1) WHERE starts_with(suggestion, 're') ORDER BY score DESC, suggestion LIMIT 5")
def sug_prefix(spark, sf_dir):
    return suggest.get(names(spark, sf_dir), "re").select("suggestion", "score")


@query("""WITH p AS (SELECT p_name AS s, max(p_retailprice) AS score FROM part GROUP BY 1), f AS (SELECT * FROM (VALUES (0,2),(0,3),(0,4),(1,2),(1,3),(1,4)) t(a, e))
  SELECT s AS suggestion, score FROM p WHERE EXISTS (SELECT 1 FROM f WHERE length(s) >= e AND levenshtein(substr(s, a + 1, e - a), 'rde') <= 1) ORDER BY score DESC, s LIMIT 10""")
def sug_fuzzy(spark, sf_dir):
    return suggest.get(names(spark, sf_dir), "rde", fuzzy=True, most=10).select("suggestion", "score")


@query("SELECT CAST(count(DISTINCT p_name) AS BIGINT) AS n, 'parts' AS dict FROM part")
def sug_len(spark, sf_dir):
    return suggest.length(names(spark, sf_dir))


@query("SELECT DISTINCT p_name AS suggestion FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 48)")
def sug_del(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size > 48").select(F.lit("parts").alias("dict"), F.col("p_name").alias("suggestion"))
    return suggest.delete(names(spark, sf_dir), gone).select("suggestion")


@query("""WITH ops AS (SELECT user_id AS suggestion, event_id AS seq, event_type <> 'purchase' AS incr, round(value) AS score, CASE WHEN event_id % 3 = 0 THEN props END AS payload FROM events),
  base AS (SELECT suggestion, coalesce(max(CASE WHEN NOT incr THEN seq END), -1) AS f FROM ops GROUP BY 1)
  SELECT CAST(ops.suggestion AS VARCHAR) AS suggestion, sum(score) AS score, arg_max(payload, CASE WHEN payload IS NOT NULL THEN seq END) AS payload FROM ops JOIN base USING (suggestion) WHERE seq >= f GROUP BY 1""")
def sug_add_incr(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ops = e.select(F.lit("users").alias("dict"), F.col("user_id").cast("string").alias("suggestion"), F.col("event_id").alias("seq"), (F.col("event_type") != "purchase").alias("incr"), F.round("value").alias("score"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("payload"))
    return suggest.fold(ops).select("suggestion", "score", "payload")


@query("SELECT p_partkey FROM part WHERE contains(p_name,'wid') OR contains(p_name,'get')")
def trigram_union(spark, sf_dir):
    return text_search.any_of(text_search.postings(table(spark, sf_dir, "part"), "p_partkey", "p_name"), "p_partkey", ["wid", "get"])


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def vec_decode(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", vectors.float32_bytes("embedding").alias("payload"))
    v = packed.withColumn("v", vectors.from_float32_bytes(F.col("payload"), 64))
    return v.select("vec_id", F.size("v").cast("bigint").alias("n"), F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query(f"SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY 1 - list_dot_product(embedding::DOUBLE[], {_PROBE_SQL}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({_PROBE_SQL}, {_PROBE_SQL})), vec_id LIMIT 20) ORDER BY label DESC, vec_id LIMIT 10 OFFSET 3")
def knn_sortby(spark, sf_dir):
    return S.nearest(vec_index(spark, sf_dir, "COSINE"), PROBE, 20, sort="label", descending=True, offset=3, limit=10, returns=["label"]).drop("__vec_score")
