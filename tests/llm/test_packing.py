import functools
import zlib
from collections import defaultdict

import numpy as np

from runlens.llm.packing import best_fit, pack
from runlens.llm.tokens import ChunkEncoder, default_tokenizer

from .helpers import SF, awkward, empty


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def ids_of(text, end):
    t = library()
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def check(rows, texts, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    total = 0
    for d, text in texts.items():
        ids = ids_of(text, 0)
        total += len(ids)
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(i, at, len(ids[at : at + capacity])) for i, at in enumerate(range(0, len(ids), capacity))]
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin), -(-total // capacity)


def test_best_fit_is_tight():
    sizes = np.array([5, 5, 4, 3, 3, 2, 2, 1, 7])
    bins, place, room = best_fit(sizes, 8)
    assert room.sum() == len(room) * 8 - sizes.sum() and len(room) == 4


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bins, least = check(pack(docs).collect(), texts, 2048)
    assert bins <= least * 1.02 + 1


def test_many_rounds_with_small_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bins, least = check(pack(docs, max_rows=20).collect(), texts, 2048)
    assert bins <= least * 1.1 + 1


def test_awkward_rows(spark):
    texts = [None, "", "a b c", "x" * 3000, "word, word's " * 3000, "<|endoftext|> é ß　x \x1c \n\t ☃ y", "a b c"]
    check(pack(awkward(spark, texts), capacity=16).collect(), dict(enumerate(texts)), 16)
    assert pack(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = pack(twice).collect()
    crc = lambda t: zlib.crc32(np.array(ids_of(t, 0), dtype="<u4").tobytes())
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted([(1, 0, 0, 2, crc("a"))] * 2 + [(None, 0, 0, 2, crc("b"))], key=str)
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_encoder_equals_the_library():
    made = ChunkEncoder(default_tokenizer())
    texts = ["don't they're ΣΑΣ ΣΑΣ, x", "ǅ ﬁ é e ́x", "12 3.4% $5", "a\r\nb\x0bc d", "☃x ☃ ☃", "日本語 text", " lead  and   trail ", "İstanbul İ"]
    for _ in range(2):  # unknown chunks first, remembered ones then
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in made.encode_many(texts)] == [ids_of(t, 0)[:-1] for t in texts]


def test_rounds_that_stall_lose_nothing(spark, monkeypatch):
    """Texts of which no two fit together, and a few small ones; every round counts as stalled."""
    monkeypatch.setattr("runlens.llm.packing.STALLED", 0.0)
    texts = ["a " * (9 + i % 3) for i in range(150)] + ["b " * (1 + i % 5) for i in range(60)]
    bins, least = check(pack(awkward(spark, texts).repartition(6), capacity=16, max_rows=5).collect(), dict(enumerate(texts)), 16)
    assert bins <= 190


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    import json

    spec = json.load(open(default_tokenizer()))
    spec["normalizer"] = None  # does not lower-case any more
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    made, library = ChunkEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["Hello World, x", "don't", ""]
    assert not made.wordwise and ChunkEncoder(default_tokenizer()).wordwise
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in made.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
