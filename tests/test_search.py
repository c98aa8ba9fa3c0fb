"""Golden answers on the three-row index, and plans that reach the scan."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import search as S
from millrace.operators import text_search

ROWS = [("doc:1", "red apple", "red", "10", [0.0, 0.0]), ("doc:2", "green apple", "green", "20", [1.0, 1.0]), ("doc:3", "red berry", "red", "30", [2.0, 2.0]), ("doc:4", None, None, "x", [9.0, 9.0])]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(ROWS, "key string, body string, color string, price string, vec array<float>")
    return S.SearchIndex("idx", rows, "key", {"body": S.Field("TEXT"), "color": S.Field("TAG"), "price": S.Field("NUMERIC")}, vector="vec", dim=2, metric="L2", prefixes=("doc:",))


def keys(df):
    return [r.key for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (S.everything(), "1234"), (S.num("price", 10, 20), "12"), (S.num("price", 10, 20, open_low=True), "2"), (S.num("price", 15), "23"),
        (S.tag("color", ("red",)), "13"), (S.tag("color", ("RED",)), ""), (S.tag("color", ("red", "green")), "123"), (S.text("body", "apple"), "12"),
        (S.tag("color", ("red",)) & S.text("body", "apple"), "1"), (S.tag("color", ("green",)) | S.num("price", 30), "23"),
        (~S.tag("color", ("red",)), "24"), (~S.num("price"), "4"), (~(S.text("body", "apple") | S.text("body", "berry")), "4"),
    ],
)
def test_filters(index, where, want):
    assert keys(S.search(index, where)) == [f"doc:{c}" for c in want]


def test_tag_separator_and_trim(spark):
    rows = spark.createDataFrame([("a", "red| fruit "), ("b", "green|fruit"), ("c", "red")], "key string, t string")
    index = S.SearchIndex("i", rows, "key", {"t": S.Field("TAG", "|")})
    assert keys(S.search(index, S.tag("t", ("fruit",)))) == ["a", "b"]


def test_wrong_fields(index):
    with pytest.raises(S.UnknownField):
        S.search(index, S.num("nothing", 1))
    with pytest.raises(S.SearchError):
        S.search(index, S.text("price", "1"))
    with pytest.raises(S.SearchError):
        S.Field("GEO")
    with pytest.raises(S.DimensionMismatch):
        S.nearest(index, [1.0], 1)


def test_neighbours(index):
    near = S.nearest(index, [0.0, 0.1], 2, returns=["color"])
    assert near.columns == ["key", "__vec_score", "color"] and keys(near) == ["doc:1", "doc:2"]
    assert keys(S.nearest(index, [0.0, 0.0], 5, S.num("price", 15))) == ["doc:2", "doc:3"]  # as many as match
    assert keys(S.nearest(index, [1.0, 1.0], 1, metric="IP")) == ["doc:4"]


def test_distances(spark):
    from pyspark.sql import functions as F

    from millrace.functions import vectors

    d = lambda m, a, b: spark.range(1).select(vectors.distance(m, F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>"))).first()[0]
    assert d("L2", [0.0, 0.0], [3.0, 4.0]) == 5 and d("COSINE", [1.0, 0.0], [0.0, 1.0]) == 1 and d("COSINE", [1.0, 0.0], [-2.0, 0.0]) == 2
    assert d("COSINE", [0.0, 0.0], [1.0, 0.0]) == 1 and d("IP", [1.0, 2.0], [3.0, 4.0]) == -11 and d("L2", [1.0], [1.0, 2.0]) == float("inf")


def test_sort_limit_return(index):
    assert keys(S.search(index, sort="price", descending=True, limit=2)) == ["doc:4", "doc:3"]
    assert keys(S.search(index, sort="body")) == ["doc:2", "doc:1", "doc:3", "doc:4"]
    assert keys(S.search(index, sort="body", descending=True)) == ["doc:3", "doc:1", "doc:2", "doc:4"]  # missing last either way
    assert keys(S.search(index, offset=99, limit=5)) == []
    assert S.search(index, returns=["color", "nope"]).columns == ["key", "color"] and S.search(index, no_content=True).columns == ["key"]


def test_aggregate(index):
    got = S.aggregate(index, ["color"], [S.Reduce("COUNT", "n"), S.Reduce("SUM", "s", "price"), S.Reduce("AVG", "a", "price")])
    assert [tuple(r) for r in got.collect()] == [("", 1, 0.0, 0.0), ("green", 1, 20.0, 20.0), ("red", 2, 40.0, 20.0)]
    with pytest.raises(S.SearchError):
        S.aggregate(index, [], [])
    with pytest.raises(S.SearchError):
        S.aggregate(index, ["color"], [S.Reduce("MEDIAN", "m", "price")])


def test_catalog(index):
    catalog = S.Catalog()
    catalog.create(index)
    with pytest.raises(S.SearchError):
        catalog.create(index)
    assert catalog.names() == ["idx"] and keys(catalog.drop("idx", with_rows=True)) == [r[0] for r in ROWS] and catalog.names() == []
    assert {r.property: r.value for r in index.info().collect()}["rows"] == "4"
    assert "KNN 3 vec L2" in S.explain(index, S.num("price", 1, 2), 3) and "NUMERIC price" in S.explain(index, S.num("price", 1, 2))


def test_filter_reaches_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = S.SearchIndex("d", rows, "doc_id", {"n_chars": S.Field("NUMERIC")})
    plan = S.search(index, S.num("n_chars", 500, 900), returns=["n_chars"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars" in plan.replace("(cast(", "(") or "PushedFilters" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_batch_search_of_many_queries(spark):
    """More queries than are broadcast at once: each gets the same answer as over all pairs."""
    n, points = 10_050, [(i, [float(i * 37 % 101), float(i * 53 % 89)]) for i in range(20)]
    index = S.SearchIndex("many", spark.createDataFrame(points, "id long, v array<float>"), "id", vector="v", dim=2)
    queries = spark.range(n).selectExpr("id AS query_id", "array(CAST(id % 101 AS FLOAT), CAST(id % 89 AS FLOAT)) AS q")
    got = {}
    for r in S.nearest_batch(index, queries, "query_id", "q", 2).collect():
        got[r.query_id, r["rank"]] = r.id
    want = {}
    for d in range(n):
        best = sorted(((v[0] - d % 101) ** 2 + (v[1] - d % 89) ** 2, i) for i, v in points)[:2]
        want |= {(d, k + 1): i for k, (_, i) in enumerate(best)}
    assert got == want


def test_float32_payloads(spark):
    rows = spark.createDataFrame([(1, bytes.fromhex("0000803f000000c0")), (2, bytes(4)), (3, None)], "k int, p binary")
    got = {r["k"]: r["v"] for r in rows.select("k", vectors.from_float32_bytes(F.col("p"), 2).alias("v")).collect()}
    assert got == {1: [1.0, -2.0], 2: None, 3: None}


def test_preview():
    assert text_search.preview("ab") == "<short-circuit: scan>"
    assert text_search.preview("abcd") == '["abc", "bcd"]'
    assert text_search.preview("abcdefghijk").endswith('"hij", ...]')


def test_batch_search_is_the_plain_one(spark, monkeypatch):
    """Each metric beside `distance` over all pairs: ties, copies, zero and odd vectors, other lengths; and no join of all pairs."""
    import random

    from pyspark.sql import Window

    from millrace.operators import meeting

    rng, n = random.Random(4), float("nan")
    some = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    odd = [[0.0] * 6, [n] * 6, [None, *[1.0] * 5], None, [1.0, 2.0], [], [3e38] * 6, [1e-45] * 6, [float("inf"), *[0.0] * 5]]
    points = [(f"k{i}", rng.choice(some)) for i in range(150)] + [(f"odd{i}", v) for i, v in enumerate(odd)]
    rows = spark.createDataFrame(points, "id string, v array<float>").cache()
    queries = rows.where("id LIKE '%3' OR id LIKE 'odd%'").select(F.col("id").alias("q"), F.col("v").alias("w"))
    for name, value in (("BLOCK", 10), ("SHARE", 60), ("ROWS", 20)):
        monkeypatch.setattr(meeting, name, value)
    for metric in ("COSINE", "L2", "IP"):
        index = S.SearchIndex("odd", rows, "id", vector="v", metric=metric)
        got = S.nearest_batch(index, queries, "q", "w", 4)
        pairs = rows.crossJoin(queries).where(F.size("v") == F.size("w")).select("q", "id", vectors.distance(metric, F.col("v"), F.col("w")).alias("__vec_score"))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("__vec_score", "id"))).where("rank <= 4")
        shown = lambda df: sorted(str(r).replace("=-0.0)", "=0.0)") for r in df.select("q", "rank", "id", "__vec_score").collect())
        assert shown(got) == shown(want)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
