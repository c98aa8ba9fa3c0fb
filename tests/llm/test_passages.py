"""Substring dedup word by word against all windows of 50 words."""

import random
import time

from millrace.llm import substring_dedup

from .test_documents import WORD


def held(spark, docs):
    """Every document's words that stand in a passage reported, and those in a window of 50 words that two documents hold."""
    spans = {d: [m.span() for m in WORD.finditer(t.lower())] for d, t in docs}
    words = {d: [t.lower()[a:b] for a, b in spans[d]] for d, t in docs}
    holders = {}
    for d, w in words.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(d)
    want = {(d, k + i) for d, w in words.items() for k in range(len(w) - 49) if len(holders[tuple(w[k : k + 50])]) > 1 for i in range(50)}
    rows = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r.doc_id, i) for r in rows for i, (a, b) in enumerate(spans[r.doc_id]) if r.start <= a and b <= r.end}
    return got, want


def maker(seed):
    rng = random.Random(seed)
    return rng, lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_edits_of_equal_length(spark):
    """Behind a short run and a word swapped for one as long, the longer run on the same alignment counts."""
    _, words = maker(1)
    docs = []
    for k in range(20):
        text = words(400)
        docs.append((k, " ".join(text)))
        for at in (30, 70, 200, 240):
            text[at] = "z" * len(text[at])
        docs.append((100 + k, " ".join(text)))
    got, want = held(spark, docs)
    assert got == want and {d for d, _ in want} == {d for d, _ in docs}


def test_repetitive_passages(spark):
    """Passages of any period, among other words, in two documents each and of different lengths."""
    rng, words = maker(2)
    docs = []
    for k in range(40):
        unit = ["".join(rng.choice("abcdefgh") for _ in range(4)) + str(k)] if k % 2 else words(rng.randint(2, 12))
        for side in range(2):
            docs.append((k + 100 * side, " ".join(words(10) + (unit * 150)[: rng.randint(60, 150)] + words(10))))
    got, want = held(spark, docs)
    assert got == want and {d for d, _ in want} == {d for d, _ in docs}


def test_pieces_of_different_first_documents(spark):
    """Two lines of 30 words, each first in a document of its own, are one passage of the two documents that hold both."""
    _, words = maker(3)
    docs = []
    for k in range(40):
        one, two = words(30), words(30)
        docs += [(10 * k, " ".join(words(5) + one + words(5))), (10 * k + 1, " ".join(words(5) + two + words(5)))]
        docs += [(10 * k + 2 + i, " ".join(words(7) + one + two + words(7))) for i in range(2)]
    got, want = held(spark, docs)
    assert got == want and {d for d, _ in want} == {d for d, _ in docs if d % 10 > 1}


def test_parts_held_by_earlier_documents(spark):
    """A passage of 66 words whose first 45 and last 45 stand in earlier documents, under 50 words each."""
    _, words = maker(4)
    docs = []
    for k in range(20):
        passage = words(66)
        docs += [(10 * k + 1, " ".join(words(6) + passage[:45] + words(6))), (10 * k + 2, " ".join(words(6) + passage[-45:] + words(6)))]
        docs += [(10 * k + 3 + i, " ".join(words(8) + passage + words(8))) for i in range(2)]
    got, want = held(spark, docs)
    assert got == want and {d for d, _ in want} == {d for d, _ in docs if d % 10 > 2}


def test_short_words(spark):
    """Windows of fewer bytes than the rolling hash reaches."""
    rng, _ = maker(5)
    word = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)]
    docs = []
    for k in range(20):
        passage = word(rng.randint(50, 60)) if k % 2 else ["a"] * rng.randint(50, 90)
        docs += [(2 * k + i, " ".join(word(20) + passage + word(20))) for i in range(2)]
    got, want = held(spark, docs)
    assert got == want


def test_long_periodic_texts_in_linear_time(spark):
    took = []
    for n in (2_000, 20_000, 80_000):
        line = "an entry of a log that says the same thing over and over again "
        docs = spark.createDataFrame([(1, line * (n // 12)), (2, "x " + line * (n // 12))], "doc_id long, text string")
        began = time.time()
        assert {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()} == {1, 2}
        took.append(time.time() - began)
    assert took[2] < 6 * took[1]
