"""The queries of this package: one thin opN_<name> for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, license_scan, near_dedup, packing, secret_scan, substring_dedup, token_tables, toxicity, vector_topk
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.token_tables(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_by_document(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_license_scan, op4_best_fit_packing, op5_substring_dedup, op6_exact_topk, op7_token_tables, op8_secret_scan, op9_toxicity, op10_language_id)}

def _secret_sql() -> str:
    """op8 in SQL: the same patterns, with the places from what stands between the matches."""
    kinds, quote = secret_scan.BASE + secret_scan.MORE, lambda x: "'" + x.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, {quote(kind)} AS kind, string_split_regex(t, {quote(rx)}) AS gaps, regexp_extract_all(t, {quote(rx)}, 0) AS whole, regexp_extract_all(t, {quote(rx)}, {group}) AS part, {least} AS least FROM d"
        for k, (kind, rx, group, least) in enumerate(kinds)
    )
    base = f"k < {len(secret_scan.BASE)}"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(secret_scan.BASE))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({matches}),
        u AS (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM m WHERE len(whole) > 0),
        p AS (SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM u WHERE length(part[i]) >= least),
        w AS (SELECT rid, k, s, concat(kind, ':', s, ':', s + length(whole[i])) AS span FROM p),
        g AS (SELECT rid, {counts}, string_agg(span, ',' ORDER BY s, k) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM w GROUP BY rid)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)
    """


ORACLES: dict[str, str] = {
    "op6_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op8_secret_scan": _secret_sql(),
    # all pairs that share a shingle, and their components by reachability: for small tables
    "op1_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7f])+') AS w FROM documents),
        i AS (SELECT rid, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS k FROM d),
        b AS (SELECT rid, array_to_string(w[k:k+4], ' ') AS s, count(*) AS c FROM i GROUP BY 1, 2),
        n AS (SELECT rid, sum(c) AS n FROM b GROUP BY 1),
        p AS (SELECT x.rid AS a, y.rid AS b, sum(least(x.c, y.c)) AS common FROM b x JOIN b y ON x.s = y.s AND x.rid < y.rid GROUP BY 1, 2),
        e AS (
          SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE common >= CAST(0.8 AS DOUBLE) * (x.n + y.n - common)
          UNION SELECT x.rid, y.rid FROM d x JOIN d y ON x.t = y.t AND x.rid < y.rid
        ),
        l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT rid, rid AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rid),
        c AS (SELECT r.rid, min(r.root) AS root FROM r GROUP BY 1)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM d JOIN c USING (rid)
    """,
}
