import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import license_scan, secret_scan

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(hits)


def test_license_base_places_by_brute_force():
    rng, scanner = random.Random(5), license_scan.Scanner()
    vocabulary = ["mit", "MIT", "license", "License", "apache", "general", "public", "GENERAL", "x", "é", "licenses", "2"]
    for _ in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", ", ", "  ", "."]) for _ in range(rng.randint(0, 25)))
        n, hits = base_places(text)
        got = scanner.scan(text)
        starts = [k for k, _ in hits]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (n, len(hits), min(starts, default=None), max(starts, default=None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(got["base_labels"].split(",")) <= set(got["labels"].split(",")) or not got["base_labels"]
        assert 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("expression", "names", "ways"),
    [
        ("MIT", {"mit"}, 1), ("MIT OR Apache-2.0", {"mit", "apache-2.0"}, 2), ("MIT AND (BSD-3-Clause OR ISC)", {"mit", "bsd-3-clause", "isc"}, 2),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only with classpath-exception-2.0"}, 1), ("MIT OR ISC AND Zlib", {"mit", "isc", "zlib"}, 2),
        ("(MIT OR ISC) AND (Zlib OR X11)", {"mit", "isc", "zlib", "x11"}, 4), ("MIT and more text", {"mit"}, 1), ("MIT OR", {"mit"}, 1),
    ],
)
def test_license_expressions(expression, names, ways):
    assert license_scan.evaluate(expression) == (names, ways)


@pytest.mark.parametrize("expression", ["", "OR MIT", "(MIT", "AND"])
def test_no_license_expression(expression):
    assert license_scan.evaluate(expression) is None


def test_license_tags_and_notices():
    got = license_scan.Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nRedistribution and use in source and binary forms")
    assert got["labels"] == "apache-2.0,bsd,mit" and got["alternatives"] == 2 and got["score"] > 0.9


def test_license_beginnings():
    """The longest valid beginning counts, prose words name nothing, and no expression is too long."""
    tell = license_scan.evaluate
    assert tell("MIT and is fine") == tell("MIT OR") == tell("MIT, see COPYING.") == tell("MIT AND (GPL-2.0-only") == ({"mit"}, 1)
    assert tell("MIT/Apache-2.0") == ({"mit", "apache-2.0"}, 2)
    assert tell("GPL-2.0-or-later WITH Classpath-exception-2.0 OR LicenseRef-own") == ({"gpl-2.0-or-later with classpath-exception-2.0", "licenseref-own"}, 2)
    assert tell("GPL-2.0+ with no exception") == ({"gpl-2.0+"}, 1)
    assert tell("see below") is tell("") is tell("OR MIT") is tell("(MIT") is tell("NONE") is None
    pairs = " AND ".join(f"(LicenseRef-a{i} OR LicenseRef-b{i})" for i in range(11))
    assert tell(pairs) == ({f"licenseref-{x}{i}" for x in "ab" for i in range(11)}, 2**11)
    assert tell(" AND ".join(["(MIT OR ISC)"] * 80)) == ({"mit", "isc"}, 2**63 - 1)
    got = license_scan.Scanner().scan("SPDX-License-Identifier: " + pairs)
    assert len(got["labels"].split(",")) == 22 and got["alternatives"] == 2**11
    assert license_scan.Scanner().scan("SPDX-License-Identifier: MIT and is fine")["labels"] == "mit"


def test_license_odd_documents(odd_docs, no_docs):
    rows = license_scan.scan_licenses(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((d or 0, base_places(t)[0]) for d, t, _ in ODD)
    assert license_scan.scan_licenses(no_docs).collect() == []


ASSIGN = re.compile(secret_scan.BASE[0][1].removeprefix("(?i)"), re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def written(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_texts(n=300):
    rng = random.Random(9)
    parts = ["token", "Password", "api_key", "APIKEY", "secret", "=", ": ", '"', "'", " ", "abc", "abcdef012", "AKIA", "Z" * 16, "0a" * 12, "0a" * 11, "😀", "é", "\n", "deadbeef", "token=token", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_secrets_by_brute_force(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.secrets_by_document(docs).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert {*filter(None, written(want).split(","))} <= {*filter(None, r.spans.split(","))}


def test_ledger_scans_a_blob_once(spark, tmp_path):
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean"), (3, "token=abcdefgh")], "doc_id long, text string")
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.unseen(first).count() == 2
    assert ledger.scan(first).where(F.size("spans") > 0).count() == 2
    assert ledger.unseen(first).count() == 0
    later = first.unionByName(spark.createDataFrame([(4, "clean"), (5, "AKIA" + "B" * 16)], "doc_id long, text string"))
    assert [r.text for r in ledger.unseen(later).collect()] == ["AKIA" + "B" * 16]
    assert ledger.scan(later).count() == 5 and ledger.seen().count() == 3
    assert secret_scan.BlobLedger(spark, ledger.path, rules="base-2").unseen(later).count() == 3


def test_secrets_odd_documents(odd_docs, no_docs):
    assert secret_scan.secrets_by_document(odd_docs).count() == len(ODD)
    assert secret_scan.secrets_by_document(no_docs).collect() == []


def test_redaction(spark, odd_docs):
    texts = secret_texts(150)
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string")
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if not base_spans(texts[r.doc_id]) and "BEGIN" not in texts[r.doc_id] and "ghp_" not in texts[r.doc_id]:
            assert r.text == texts[r.doc_id]
        assert not base_spans(r.text.replace("[SECRET]", "\n")) and r.n_chars == len(r.text)
    assert secret_scan.redacted(odd_docs).count() == len(ODD)


def test_redaction_of_overlapping_spans(spark):
    """Against a walk over the characters, in a text of several pieces."""
    rng = random.Random(4)
    text = "".join(rng.choice("ab😀é \n") for _ in range(5000))
    spans = sorted((a, rng.randrange(3), a + rng.randint(1, 1500)) for a in (rng.randrange(3400) for _ in range(9)))
    want, at = "", 0
    for a, _, b in spans:
        if a >= at:
            want += text[at:a] + "[SECRET]"
        at = max(at, b)
    df = spark.createDataFrame([(text, spans), (text, [(0, 0, 1024), (1024, 0, 2048), (4999, 0, 5000)]), ("abc", [(0, 0, 3)])], f"text string, spans {secret_scan.SPANS}")
    got = [r[0] for r in df.select(secret_scan.masked(F.col("text"), F.col("spans"), "[SECRET]")).collect()]
    assert got == [want + text[at:], "[SECRET][SECRET]" + text[2048:4999] + "[SECRET]", "[SECRET]"]


def test_secrets_in_linear_time(spark):
    """Four times the secrets in one text take less than six times as long."""
    took = []
    for n in (2000, 40_000, 160_000):
        docs = spark.createDataFrame([(1, " ".join(f"token={i:08d}abcd xyz" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        (row,) = secret_scan.secrets_by_document(docs).collect()
        (out,) = secret_scan.redacted(docs).collect()
        took.append(time.time() - began)
        assert row.n_assign == n and out.text == " ".join(["[SECRET] xyz"] * n)
    assert took[2] < 6 * took[1]


def test_updates_at_the_same_time_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean")], "doc_id long, text string")
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    ledger.update(docs)
    ledger.seen().write.mode("append").parquet(ledger.path)
    assert sorted((r.path, len(r.spans)) for r in ledger.by_path(docs).collect()) == [(1, 1), (2, 0)]


def test_native_plan(odd_docs):
    for out in (secret_scan.secrets_by_document(odd_docs), secret_scan.redacted(odd_docs), secret_scan.BlobLedger(odd_docs.sparkSession).unseen(odd_docs)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
