import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, token_tables, tokenize

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenize.vocabulary_path())


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library_on_any_text():
    rng, encoder = random.Random(3), tokenize.Encoder(tokenize.vocabulary_path())
    letters = [*"aAbB'sStT.,,..!?;09   \n\té́İΣßKﬁ中×÷ÀÿŠ\x1c\x85\x00\x7f", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", ", ", ". ", "É, ", "!. "]
    for _ in range(30):
        assert encoder.check(["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)])


def test_encoder_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(tokenize, "REMEMBERED", 5)
    encoder = tokenize.Encoder(tokenize.vocabulary_path())
    assert all(encoder.check([f"some words number {i}, and more of them."]) for i in range(20))


def best_fit(lengths, capacity):
    """Piece by piece: each to the open bin that it fills best."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 128])
    lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.randint(1, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins, placed = {}, {}
    for length, rank, count, first, offset in packing.plan(histogram, capacity).tolist():
        for k in range(count):
            assert (length, rank + k) not in placed
            placed[length, rank + k] = first + k
            bins.setdefault(first + k, []).append((offset, length))
    assert len(placed) == len(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == best_fit(lengths, capacity)


def test_pack_odd_documents(odd_docs, library):
    rows = packing.pack_documents(odd_docs).collect()
    want = []
    for doc_id, text, _ in ODD:
        ids = whole(library, text)
        want += [(doc_id, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_pack_salts_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_ROWS", 7)
    cut = spark.createDataFrame([(i, 0, 0, 3 if i % 4 else 5, i % 11) for i in range(200)], packing.PIECES)
    rows = packing.pack(cut, 10).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 200
    assert max(r.sequence_id for r in rows) + 1 == len(best_fit([3] * 150 + [5] * 50, 10))


def test_no_documents(no_docs):
    assert packing.pack_documents(no_docs).collect() == []
    assert token_tables.token_tables(no_docs).collect() == []


def test_token_tables_round_trip(odd_docs, library, tmp_path):
    spark, path = odd_docs.sparkSession, f"file://{tmp_path}/sst"
    manifest = token_tables.write_tables(odd_docs, path)
    rows = token_tables.read_tables(spark, path, manifest).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
    at = 0
    assert len(rows) == len(order)
    for row, (doc_id, text, _) in zip(rows, order, strict=True):
        ids = whole(library, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)
    found = {}
    for r in manifest.collect():
        with open(f"{tmp_path}/sst/{r.file}", "rb") as f:
            shard = token_tables.Shard(f, f.seek(0, 2))
            for doc_id in (None, 1, 4, 5, 6, 999):
                found.setdefault(doc_id, []).extend(x.tolist() for x in shard.get(doc_id))
    assert found[999] == []
    assert found[5] == [whole(library, ODD[5][1])] * 2
    assert found[None] == [whole(library, ODD[3][1])]
    assert found[4] == [whole(library, ODD[4][1])]


def test_shard_rejects_other_files(tmp_path):
    (tmp_path / "x").write_bytes(b"no shard" * 20)
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError):
        token_tables.Shard(f, 160)


def test_simple_texts_are_told_as_by_one_pattern():
    import random
    import re

    from millrace.llm import tokenize

    hard = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]|[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x7f][.,] |<\\|")
    rng, letters = random.Random(1), [*map(chr, range(0x120)), *"., " * 60, *"<|中"]
    for _ in range(50_000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 8)))
        assert tokenize._hard(text) == bool(hard.search(text))
