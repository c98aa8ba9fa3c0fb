import time

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id, toxicity

from .conftest import ODD

SMALL = "/root/testdata/sf0.01"


def test_network_gradient():
    """The gradient that fit() follows is that of the loss."""
    rng = np.random.default_rng(0)
    model = language_id.ByteCNN(["a", "b", "c"])
    for p in [*model.conv, model.out]:
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    x, y = rng.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        model._pairs = None
        return -np.log(model.probabilities(x)[np.arange(6), y].astype(np.float64)).mean()

    grads = model._grads(x, y, np.ones(6))
    for p, g in zip([*model.conv, model.out, model.bias], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_pair_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    model = language_id.ByteCNN(["a", "b"])
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    h = []
    for w, table in zip(language_id.WIDTHS, model.conv, strict=True):
        span = language_id.WINDOW - w + 1
        h.append(sum(table[j][x[:, j : j + span]] for j in range(w)).max(axis=1))
    z = np.maximum(np.concatenate(h, axis=1), 0) @ model.out + model.bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(p, model.probabilities(x), atol=1e-5)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_number_forms_are_no_letters():
    model = language_id.ByteCNN(["a"])
    assert model.predict(["½ ²", "Ⅷ 12", "_", None, "½ a"])[0] == ["und"] * 4 + ["a"]


def test_texts_of_no_learned_language_go(spark):
    """At the pipeline's threshold every labelled text stays; texts of other languages and scripts and of letters in any order go."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    assert language_id.keep_identified(docs, model).count() == docs.count()
    strange = ["Северный ветер и солнце поспорили кто из них сильнее", "北风与太阳争论谁更强大", "Az északi szél és a nap egyszer azon vitatkoztak", "qwrtz plkjh xcvbnm zzzxx qqqkkk wwwxxx jjjhhh", "Η βορινή αύρα και ο ήλιος μάλωναν"]
    assert language_id.keep_identified(spark.createDataFrame([(i, t) for i, t in enumerate(strange)], "doc_id long, text string"), model).count() == 0


def test_training_windows_come_from_whole_texts(spark):
    """A language told only by the ends of long texts is learned."""
    rows = [(i, "0123456789 " * 300 + (("the of and ing " if i % 2 else "der die und ich ") * 900), "en" if i % 2 else "de") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["the and of the ing", "die der ich und"])[0] == ["en", "de"]


def test_language_odd_documents(spark, odd_docs, no_docs):
    model = language_id.train(odd_docs)
    rows = {r.doc_id: r for r in language_id.identify(odd_docs, model).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {2, 3, 6}
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[None].held_out is False
    kept = language_id.keep_identified(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD) - 3
    empty = language_id.train(no_docs)
    assert language_id.identify(no_docs, empty).collect() == [] and language_id.keep_identified(no_docs, empty).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd_docs, empty).collect()} == {"und"}


def test_language_ignores_labels_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = (language_id.train(d) for d in (docs, wrong))
    assert a.classes == b.classes and all(np.array_equal(p, q) for p, q in zip(a.conv, b.conv, strict=True))


def grammar():
    return toxicity.Grammar(toxicity.Lexicon(["idiot", "vil*"]))


def test_grammar_readings():
    read = lambda t: dict(zip(toxicity.READINGS, np.round(np.expm1(grammar().read(t))).astype(int).tolist(), strict=True))
    only = lambda **k: {r: k.get(r, 0) for r in toxicity.READINGS}
    assert read("Clean words. Nothing here") == only()
    assert read("such an Idiot") == only(plain=1)
    assert read("you are an idiot. And vile, vilest") == only(targeted=1, plain=2)
    assert read("not an idiot; never") == only(negated=1)
    assert read("someone said idiot") == only(reported=1)
    assert read('the "idiot" word') == only(reported=1)
    assert read("they will kill you") == only(threat=1)
    assert read("kill the process") == only()
    assert read("evil devilish idiotic") == only()


def test_lexicon_set_cover(spark):
    docs = [({"good", "words", f"lowe{'abcdefgh'[i % 8]}x"}, 1) for i in range(24)] + [({"good", "words", "lowland"}, 0)] * 40 + [({"scumbag", "x"}, 1)] * 4
    df = spark.createDataFrame([(i, sorted(w), t) for i, (w, t) in enumerate(docs)], "row long, words array<string>, toxic int")
    lexicon = toxicity.learn_lexicon(df)
    assert "lowezz" in lexicon and "scumbag" in lexicon and "good" not in lexicon and "lowland" not in lexicon


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95
    told = found.groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in told}
    assert n.get((1, 1), 0) >= 0.8 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((1, 1), 0) >= 0.8 * (n.get((1, 1), 0) + n.get((0, 1), 0))


def test_toxicity_ignores_labels_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, wrong))
    assert a.lexicon.entries == b.lexicon.entries and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_grammar_reads_in_linear_time():
    grammar_, took = grammar(), []
    for n in (20_000, 80_000):
        text, began = "you are an idiot " * n, time.time()
        grammar_.read(text)
        grammar_.read("an idiot, " + "word " * 5 + ". ")
        took.append(time.time() - began)
    assert took[1] < 6 * took[0]


def test_toxicity_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (2, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels.limit(0))).collect() == []
