"""Near-dedup, decontamination, substring dedup and the pipeline against brute-force versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, near_dedup, shingles, substring_dedup

from .conftest import ODD

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def words(text):
    return WORD.findall((text or "").lower())


def bag(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def classes(docs):
    """doc_id to the least doc_id of its class, over all pairs."""
    bags, parent = [bag(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or overlap(bags[i], bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return [(d, ids.get(root(i))) for i, (d, _) in enumerate(docs)]


def corpus(seed=1, n=60):
    """Documents with exact copies, near copies of all degrees, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        kind, text = rng.random(), [word() for _ in range(rng.randint(3, 120))]
        if out and kind < 0.25:
            text = rng.choice(out)
        elif out and kind < 0.6:
            text = list(rng.choice(out))
            for _ in range(rng.randint(1, 5)):
                text[rng.randrange(len(text))] = word()
        elif kind < 0.75:
            text = text[:30] + shared + text[30:60]
        elif kind < 0.8:
            text = text[:9] * rng.randint(2, 9)
        out.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_word_and_shingle_hashes():
    texts = ["One two, three four FIVE six", "", "é x", "one two three four five", "!!"]
    h, n = shingles.word_hashes(texts)
    assert n.tolist() == [len(words(t)) for t in texts]
    by_word = {}
    for value, w in zip(h.tolist(), [w for t in texts for w in words(t)], strict=True):
        assert by_word.setdefault(w, value) == value
    sh, k = shingles.shingle_hashes(h, n)
    assert k.tolist() == [2, 0, 1, 1, 0] and sh[0] == sh[3]


def test_signatures_estimate_weighted_overlap():
    rng, gaps = random.Random(4), []
    for _ in range(40):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(150)]
        a, b = base * rng.randint(1, 3), list(base)
        for _ in range(rng.randint(0, 30)):
            b[rng.randrange(len(b))] = f"z{rng.random()}"
        a, b = " ".join(a), " ".join(b * rng.randint(1, 3))
        sig, _ = near_dedup.signatures([a, b])
        gaps.append((sig[0] == sig[1]).mean() - overlap(bag(a), bag(b)))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.07


def test_signature_of_a_text_does_not_depend_on_its_batch():
    texts = [t for _, t in corpus(3, 30)]
    together, _ = near_dedup.signatures(texts)
    for i in (0, 7, 29):
        assert np.array_equal(near_dedup.signatures([texts[i]])[0][0], together[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_by_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if seed == 2:
        monkeypatch.setattr(near_dedup, "BLOCK", 2)  # buckets in many blocks
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()) == classes(docs)


def test_pairs_across_components_are_found(spark):
    """A chain in which the bucket's least node is like neither end: only the comparison across components joins it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    docs, text = [], list(base)
    for i in range(25):
        docs.append((i, " ".join(text)))
        for _ in range(1):
            text[rng.randrange(100)] = f"x{rng.random()}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(df).collect()) == classes(docs)


def test_near_duplicates_odd_documents(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted(classes([(d, t) for d, t, _ in ODD]), key=str)
    assert near_dedup.near_duplicates(no_docs).collect() == [] and near_dedup.keep_one(no_docs).collect() == []
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, 6, 7, None]


def test_one_row_of_a_class_stays(spark):
    """Rows are told by id and text: (5, B) is a copy of (3, B) though (5, A) is kept; repeated rows and null ids go."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "some other words than those"
    docs = [(3, b), (5, a), (5, b), (7, c), (7, c), (None, a), (None, "alone"), (None, "alone"), (9, None), (8, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, row_key int")
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, b), (5, a), (7, c), (None, "alone"), (8, "")], key=str)


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    from millrace.llm import common

    made = iter(range(1000))
    monkeypatch.setattr(common, "scratch", lambda _, name: f"file://{tmp_path}/{name}-{next(made)}")
    df = spark.createDataFrame(corpus(3, 60), "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 60
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["document-classes"]
    near_dedup.keep_one(df).collect()
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["document-classes", "special-rows"]


def test_filter_loses_no_key(spark, monkeypatch):
    from millrace.llm import common

    df = spark.range(3000).withColumnRenamed("id", "k").withColumn("filter_page", F.lit("clash"))
    keys = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    for bits in (1 << 15, 1 << 28):  # full, and wide
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        alone, rest = common.parted(df, "k", keys, 429)
        got, more = {r.k for r in alone.collect()}, {r.k for r in rest.collect()}
        assert alone.columns == rest.columns == df.columns and not got & more and len(got) + len(more) == 3000
        assert set(range(0, 3000, 7)) <= more and len(more) < 600


def leaks(docs, items, least=0.8):
    out = set()
    for d, t in docs:
        w, mine = words(t), set(bag(t))
        for i, text in items:
            v = words(text)
            if len(v) >= 5:
                n = len(words(decontaminate.question_and_answer(text)[0]))
                there = [tuple(v[k : k + 5]) in mine for k in range(len(v) - 4)]
                parts = [there[: max(0, n - 4)], there[max(0, n - 4) :]]
                hit = sum(there) >= least * len(there) and all(sum(p) >= 0.5 * len(p) for p in parts)
            else:
                hit = bool(v) and any(w[k : k + len(v)] == v for k in range(len(w)))
            if hit:
                out.add((d, i))
    return out


def test_contaminated_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(n)) + ("? " + " ".join(word() for _ in range(3)) if i % 2 else ". One more.")) for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 20, 30, 45] * 3)]
    items = [(i, t if i >= 3 else " ".join(words(t)[: i + 2])) for i, t in items] + [(90, None), (91, ""), (None, "x y z"), (3, items[3][1])]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            _, t = rng.choice(items[:30])
            leak = words(t)
            for _ in range(rng.choice([0, 0, 1])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = leak[: rng.choice([len(leak), len(leak) - len(leak) // 10])]
        docs.append((d, " ".join(text)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, [(i, t) for i, t in items if i is not None and t])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "SHARD", 4)
    monkeypatch.setattr(decontaminate, "PASS", 13)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_question_and_answer():
    assert decontaminate.question_and_answer("What is it? A thing.") == ("What is it?", " A thing.")
    assert decontaminate.question_and_answer("First. Second one. Third.") == ("First. Second one.", "Third.")
    assert decontaminate.question_and_answer("Only one") == ("Only one", "")


def test_contaminated_odd_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "over the lazy dog by the river bank"), (2, "consectetur lorem ipsum dolor sit")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, bench).collect()} == {(1, 1), (4, 2)}
    assert decontaminate.contaminated(no_docs, bench).collect() == [] and decontaminate.contaminated(odd_docs, bench.limit(0)).collect() == []
    kept = decontaminate.keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD) - 2


def test_chunks_resist_insertions():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000))

    def digests(t):
        w = substring_dedup.Windows([t], 50)
        return set(w.hashes(w.at[w.first], w.size + 49).tolist())

    a, b = digests(text), digests(text[:5000] + " inserted words " + text[5000:])
    assert len(a) > 50 and len(a - b) <= 8 and len(b - a) <= 8
    data = np.frombuffer(text.encode(), np.uint8)
    h, rolled = 0, substring_dedup.rolled(data)
    for i, c in enumerate(data.tolist()):
        h = (h << 1) + int(substring_dedup.GEAR[c]) & 0xFFFFFFFFFFFFFFFF
        assert int(rolled[i]) == h  # as the rolling hash gives it, byte by byte


def test_every_window_lies_in_a_chunk_and_has_its_own_mark():
    """A window's mark is the same whatever stands around it, in texts of short and of long words."""
    rng = random.Random(5)
    for longest in (1, 2, 9):
        word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, longest)))  # noqa: B023, E731
        shared = [word() for _ in range(70)]
        a, b = ([word() for _ in range(rng.randint(3, 60))] + shared + [word() for _ in range(9)] for _ in range(2))
        x, y = (substring_dedup.Windows([" ".join(t)], 50) for t in (a, b))
        at = [next(i for i in range(len(t)) if t[i : i + 70] == shared) for t in (a, b)]
        assert x.key[at[0] : at[0] + 21].tolist() == y.key[at[1] : at[1] + 21].tolist()
        assert int(x.size.sum()) == len(x.at) == len(a) - 49


def test_repeated_passages_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    passages = [[word() for _ in range(n)] for n in (30, 45, 49, 58, 75, 120)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(0, 1)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(100, docs[7][1]), (101, docs[7][1].upper())]
    seen = {}
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(d)
    want = {d for s in seen.values() if len(s) > 1 for d in s}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == want
    text = dict(docs)
    for r in rows:
        span = words(text[r.doc_id][r.start : r.end])
        assert len(span) == r.n_words >= 50 and " ".join(span) in " ".join(words(text[r.first_doc_id]))
    cleaned = substring_dedup.without_repeats(df)
    again = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(again[d] == text[d] for d in text if d not in want) and words(again[101]) == []


def test_repeated_passages_odd_documents(spark, odd_docs, no_docs):
    assert substring_dedup.repeated_passages(odd_docs).collect() == []
    assert substring_dedup.repeated_passages(no_docs).collect() == []
    twice = odd_docs.unionByName(odd_docs.where("doc_id = 4").withColumn("doc_id", odd_docs.doc_id + 90))
    assert {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(twice).collect()} == {(4, 4), (94, 4)}
    assert substring_dedup.without_repeats(odd_docs).columns == odd_docs.columns


def test_rows_of_one_id_stay_apart(spark):
    """Two texts of one doc_id: what is cut out of one stays in the other, and a passage the two share counts."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(n))
    shared, alone, own, twice = text(60), text(90), text(20), text(70)
    docs = [(1, shared), (2, f"{own} {shared}"), (2, alone), (2, alone), (7, twice), (7, f"{twice} {own}"), (-5, f"{text(5)} {alone} x"), (None, shared)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert rows == {(1, 1), (2, 1), (-5, -5), (2, -5), (7, 7)}
    out = sorted(((r.doc_id, r.text.strip()) for r in substring_dedup.without_repeats(df).collect()), key=str)
    left = [t for d, t in out if d == 7]
    assert [t for d, t in out if d == 2] == sorted(["", "", own], key=str) and (None, shared) in out and (1, shared) in out
    assert sorted(left) in (sorted([twice, own]), sorted(["", f"{twice} {own}"]))


def test_pipeline_runs_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """run() over null, empty, long, repeated and clashing rows, and over no rows at all."""
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "over the lazy dog by the river bank")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r.doc_id for r in rows}
    assert kept <= {4, 5, 7, None} and {4, 5} <= kept  # the rest has no letter, or holds the item
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_pipeline_run_equals_its_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    told = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())  # noqa: E731  places of like pieces are free
    assert told(corpus_pipeline.run(spark, sf_dir)) == told(docs)


def test_pipeline_stages(spark, odd_docs, tmp_path):
    """Every stage on its own input against a brute-force version of its decision; the last as packing's tests have it."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: getattr(r, "text", None) for r in out.collect()}
        if name == "language_id":
            assert {d for d, t in before.items() if re.search(r"[^\W\d_]", t or "")} == set(after)
        if name == "near_dedup":
            assert set(after) == {c for _, c in classes(list(before.items()))}
        if name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in leaks(before.items(), bench)}
        if name == "secret_scan":
            from .test_scans import base_spans

            assert set(after) == set(before) and all((t == before[d]) or base_spans(before[d]) for d, t in after.items())
            assert not any(base_spans(t) for t in after.values())
        if name == "packing":
            assert set(after) == set(before)
        else:
            assert out.columns == docs.columns
        docs = out
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns
        out.collect()
